import decimal
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stripewise.functions import encodings as E
from stripewise.operators import runs
from stripewise.operators.statistics import column_statistics


def h(text):
    return bytes.fromhex(text)


@pytest.mark.parametrize(
    ("data", "encoded"),
    [
        ("", ""),
        ("0a", "ff0a"),
        ("0a141e", "fd0a141e"),
        ("0a0a0a", "000a"),
        ("0a14141414", "ff0a0114"),
        ("0a0a0a0a0a141e", "020afe141e"),
        ("0a14141e", "fc0a14141e"),
        ("0a" * 131, "7f0aff0a"),
    ],
)
def test_byte_runs(data, encoded):
    assert runs.byte_rle(h(data)) == h(encoded)
    assert runs.byte_rle_decode(h(encoded)) == h(data)


def test_byte_literals_are_cut_at_128():
    data = bytes(range(140))
    assert runs.byte_rle(data) == b"\x80" + data[:128] + b"\xf4" + data[128:]


def test_run_after_a_full_literal_group_loses_what_the_group_took():
    data = bytes(range(127)) + b"\xff" * 6
    assert runs.byte_rle(data) == b"\x80" + data[:128] + b"\x02\xff"
    data = bytes(range(125)) + b"\xff" * 4
    assert runs.byte_rle(data) == b"\x83" + data[:125] + b"\x01\xff"


@given(st.lists(st.integers(0, 3), max_size=600))
@settings(max_examples=200, deadline=None)
def test_byte_runs_round_trip(values):
    assert runs.byte_rle_decode(runs.byte_rle(bytes(values))) == bytes(values)


def stepwise(values, run_at):
    """The groups by the format's rule, value by value."""
    place = pending = 0
    while place < len(values):
        run = min(run_at(place), 130)
        if run >= 3 and place - pending + 2 < 128:
            if place > pending:
                yield pending, place - pending, False
            yield place, run, True
            place = pending = place + run
        else:
            place += 1
            if place - pending == 128:
                yield pending, 128, False
                pending = place
    if pending < len(values):
        yield pending, len(values) - pending, False


@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([1, 1, 1, 2, 3, 4, 131, 260])), max_size=120))
@settings(max_examples=150, deadline=None)
def test_groups_are_those_of_the_stepwise_rule(parts):
    values = [x for x, n in parts for _ in range(n)] + list(range(126)) * (len(parts) % 2)

    def run_at(k):
        end = k + 1
        while end < len(values) and values[end] == values[k]:
            end += 1
        return end - k

    x = np.array(values, dtype=np.int64)
    assert not len(x) or list(runs._groups(runs._stretches(x[1:] == x[:-1]))) == list(stepwise(values, run_at))


@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-3, 3), max_size=300))
@settings(max_examples=100, deadline=None)
def test_integer_runs_keep_their_values(values):
    data, out, at = runs.int_rle(values), [], 0

    def number(at):
        x = shift = 0
        while True:
            x |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return (x >> 1) ^ -(x & 1), at

    while at < len(data):
        head = data[at]
        if head < 128:
            step = data[at + 1] - 256 if data[at + 1] > 127 else data[at + 1]
            first, at = number(at + 2)
            out += [(first + k * step + 2**63) % 2**64 - 2**63 for k in range(head + 3)]
        else:
            at += 1
            for _ in range(256 - head):
                x, at = number(at)
                out.append(x)
    assert out == values


def test_wide_decimals(spark):
    texts = {"38,0": ["99999999999999999999999999999999999999", "-99999999999999999999999999999999999999", "0"], "38,18": ["1234567890123456789.5", "99999999999999999999.999999999999999999", "-0.000000000000000001"], "38,38": ["0.99999999999999999999999999999999999999", "-0.00000000000000000000000000000000000001"]}
    for kind, values in texts.items():
        scale = int(kind.split(",")[1])
        df = spark.createDataFrame([(v,) for v in values], "t string").select("t", F.col("t").cast(f"decimal({kind})").alias("x"))
        said = {v: int(decimal.Decimal(v).scaleb(scale, decimal.Context(prec=60))) for v in values}
        assert {r.t: int(r.u) for r in df.select("t", E.decimal_unscaled(F.col("x"), scale).alias("u")).collect()} == said
        row = column_statistics(df.select("x")).filter("column = 'x'").first()
        assert (int(row.decimal_min), int(row.decimal_max)) == (min(said.values()), max(said.values()))
        total = sum(said.values())
        assert row.decimal_total is None or int(row.decimal_total) == total


def test_float_bytes(spark):
    values = [0.0, -0.0, 1.5, -2.75e-300, 5e-324, float("inf"), float("-inf"), 3.4e38]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", E.double_bytes(F.col("v")).alias("d"), E.float_bytes(F.col("v")).alias("f")).collect()
    for r in rows:
        assert bytes(r.d) == struct.pack("<d", r.v)
        assert bytes(r.f) == np.float32(r.v).tobytes()
    assert spark.sql("SELECT cast(null AS double) AS v").select(E.double_bytes(F.col("v")).alias("d")).first().d is None


def test_boolean_runs():
    assert runs.bool_rle([]) == b""
    assert runs.bool_rle([c == "T" for c in "TFTFTFFFT"]) == bytes((254, 0b10101000, 0b10000000))
    assert runs.bool_rle([False] * 80) == bytes((7, 0))


@pytest.mark.parametrize(
    ("values", "encoded"),
    [([], ""), ([10], "ff14"), ([0, -1, 1, -2, 2], "fb0001020304"), ([10] * 4, "010014"), ([10, 15, 20, 25], "010514"), ([10, 15, 20, 25, 0], "010514ff00")],
)
def test_integer_runs(values, encoded):
    assert runs.int_rle(values) == h(encoded)


def test_unsigned_integer_runs():
    assert runs.int_rle([7] * 100, signed=False) == bytes((97, 0, 7))


@pytest.mark.parametrize(("x", "encoded"), [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (129, "8101"), (16383, "ff7f"), (16384, "808001"), (16385, "818001"), (-1, "ff" * 9 + "01")])
def test_varints(spark, x, encoded):
    row = spark.createDataFrame([(x,)], "x long").select(E.varint(F.col("x")).alias("v"), E.varint_length(F.col("x")).alias("n")).first()
    assert bytes(row.v) == h(encoded) and row.n == len(h(encoded))
    assert x < 0 or runs.varint_bytes(x) == h(encoded)


def test_zigzag(spark):
    values = [0, -1, 1, -2, 2, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x long").select("k", E.zigzag(F.col("x")).alias("z"), E.unzigzag(E.zigzag(F.col("x"))).alias("back")).orderBy("k").collect()
    assert [r.z for r in rows][:6] == [0, 1, 2, 3, 4, -2] and [r.back for r in rows] == values


def test_nanos(spark):
    said = {0: 0, 1: 8, 10: 80, 100: 9, 1000: 10, 100_000_000: 15, 123_456_000: 987_650}
    rows = spark.createDataFrame([(n,) for n in said], "n long").select("n", E.pack_nanos(F.col("n")).alias("p"), E.unpack_nanos(E.pack_nanos(F.col("n"))).alias("back")).collect()
    assert {r.n: r.p for r in rows} == said and all(r.back == r.n for r in rows)


def test_times_before_the_epoch_are_rounded_down(spark):
    row = spark.sql("SELECT timestamp_micros(-1) AS t").select(E.epoch_millis(F.col("t")).alias("m"), E.nanos(F.col("t")).alias("n"), E.seconds_since_2015(F.col("t")).alias("s")).first()
    assert (row.m, row.n, row.s) == (-1, 999_999_000, -1_420_070_401)


def test_decimal_text(spark):
    rows = spark.sql("SELECT * FROM VALUES (300), (120), (5), (-50), (0) AS t(x)").select("x", E.decimal_text((F.col("x") / 100).cast("decimal(10,2)")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == {300: "3", 120: "1.20", 5: "0.05", -50: "-0.50", 0: "0"}


def test_encoded_groups_follow_the_order_and_skip_nulls(spark):
    df = spark.createDataFrame([(0, 2, 20), (0, 0, 10), (0, 1, 15), (0, 3, None), (1, 4, 7)], "g int, at int, x int")
    rows = {r.g: (r.n, bytes(r.encoded)) for r in runs.encoded_groups(df, "g", "at", "x", "int").collect()}
    assert rows == {0: (3, bytes((0, 5, 20))), 1: (1, bytes((255, 14)))}


def test_run_segments(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate("aabbba")] + [(6, None), (7, None)], "at int, c string")
    rows = runs.run_segments(df, "c", "at").orderBy("run").collect()
    assert [(r.value, r.first, r.last, r.length) for r in rows] == [("a", 0, 1, 2), ("b", 2, 4, 3), ("a", 5, 5, 1), (None, 6, 7, 2)]


def test_runs_and_deltas_over_few_keys_are_the_same_in_many_ranges(spark):
    rows = [(k, "a" if k % 3 else None, (k // 4) % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "at int, g string, x int").repartition(4)
    got = sorted((r.g or "", r.run, r.value, r["first"], r["last"], r.length) for r in runs.run_segments(df, "x", "at", ["g"]).collect())
    said = []
    for g in (None, "a"):
        own = [(k, x) for k, h_, x in rows if h_ == g]
        run, start = 0, 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k][1] != own[start][1]:
                run += 1
                said.append((g or "", run, own[start][1], own[start][0], own[k - 1][0], k - start))
                start = k
    assert got == sorted(said)
    found = {r.at: r.delta for r in runs.deltas(df, "x", "at", ["g"]).collect()}
    last = {}
    for k, g, x in rows:
        assert found[k] == (x - last[g] if g in last else None)
        last[g] = x
