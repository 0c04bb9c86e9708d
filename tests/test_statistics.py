import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stripewise.model import types as M
from stripewise.operators import checks, groups
from stripewise.operators import statistics as S

N = 12_345


@pytest.fixture(scope="module")
def demo(spark):
    """Thirteen columns of all kinds with the first or last value missing in some."""
    j = F.col("id")
    union = M.union((j % 2).cast("int"), j, j.cast("float"))
    cols = {
        "x": F.when(j > 0, j - 1),
        "y": F.when(j < N - 1, j * j),
        "z": F.when(j > 0, F.concat(F.lit("hello "), F.floor((j - 1) / 3).cast("string"))),
        "a": F.floor(j / 3) * 0.01,
        "b": (F.floor(j / 3) * 0.5).cast("float"),
        "c": F.date_add(F.lit(datetime.date(1970, 1, 1)), j.cast("int")),
        "d": j % 3 == 0,
        "e": ((j - N // 2) / 100).cast("decimal(15,2)"),
        "f": F.array(3 * j, 3 * j + 1, 3 * j + 2),
        "g": F.create_map(F.lit("param"), j % 2 == 1, F.lit("setting"), j % 2 == 0),
        "h": F.timestamp_seconds(j + 1_420_070_400),
        "i": F.lit("abc").cast("binary"),
        "k": union,
    }
    df = spark.range(N).select("id", *(c.alias(name) for name, c in cols.items()))
    return M.as_union(df, "k")


def by_column(stats):
    return {r["column"]: r for r in stats.withColumn("int_sum", S.int_sum()).withColumn("text", S.decimal_texts("decimal_min")).collect()}


def test_statistics_of_all_kinds(demo):
    s = by_column(S.column_statistics(demo.drop("id")))
    assert (s["x"].num_values, s["x"].num_present, s["x"].int_min, s["x"].int_max, s["x"].int_sum) == (N, N - 1, 0, 12_343, 76_180_996)
    assert s["y"].int_sum == 626_893_416_084
    assert (s["z"].string_min, s["z"].string_max, s["z"].total_length) == ("hello 0", "hello 999", 120_110)
    assert s["a"].double_max == pytest.approx(41.14) and s["a"].double_sum == pytest.approx(253_936.65)
    assert s["b"].double_sum == 12_696_832.5
    assert (s["c"].int_min, s["c"].int_max, s["c"].int_sum) == (0, 12_344, 76_193_340)
    assert (s["d"].true_count, s["d"].false_count) == (4115, 8230)
    assert (s["e"].decimal_min, s["e"].decimal_max, s["e"].decimal_total, s["e"].text) == (-6172, 6172, 0, "-61.72")
    assert (s["f"].num_present, s["f.element"].num_values, s["f.element"].int_max, s["f.element"].int_sum) == (N, 3 * N, 37_034, 685_777_095)
    assert (s["g.key"].num_values, s["g.key"].string_min, s["g.key"].total_length) == (2 * N, "param", 148_140)
    assert (s["g.value"].true_count, s["g.value"].false_count) == (N, N)
    assert s["h"].millis_max - s["h"].millis_min == 12_344_000
    assert s["i"].total_length == 3 * N
    assert (s["k"].num_present, s["k.c0"].num_values, s["k.c0"].int_sum, s["k.c1"].num_values, s["k.c1"].double_sum) == (N, 6173, 38_099_756, 6172, 38_093_584.0)
    ids = [r.column_id for r in sorted(s.values(), key=lambda r: r.column_id)]
    assert ids == list(range(len(ids)))


def test_row_groups_stripes_and_file(demo):
    rows = groups.row_group_statistics(demo.select("id", "x", "f"), ["id"], 10_000)
    assert sorted((r.row_group, r.num_values) for r in rows.filter(F.col("column") == "x").collect()) == [(0, 10_000), (1, 2345)]
    assert sorted(r.num_values for r in rows.filter(F.col("column") == "f.element").collect()) == [7035, 30_000]
    own = groups.row_group_statistics(demo.select("id", "f"), ["id"], 10_000, grouping="values").filter(F.col("column") == "f.element")
    assert sorted(r.num_values for r in own.collect()) == [7035, 10_000, 10_000, 10_000]
    assert {r.column_id for r in own.collect()} == {3}
    merged = by_column(groups.file_statistics(groups.stripe_statistics(rows, 1)))
    direct = by_column(S.column_statistics(demo.select("id", "x", "f")))
    assert merged == direct


def test_row_numbers_are_the_order_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.v == r.row_number for r in groups.with_row_number(df, ["v"]).collect())


def test_empty_and_all_null_columns(spark):
    schema = "i int, d double, s string, m decimal(5,2), b boolean, t timestamp, l array<int>"
    s = by_column(S.column_statistics(spark.createDataFrame([], schema)))
    assert all(r.num_values == 0 for r in s.values()) and s["i"].int_sum == 0 and s["i"].int_min is None
    s = by_column(S.column_statistics(spark.createDataFrame([(None,) * 7] * 3, schema)))
    assert (s["i"].num_values, s["i"].num_present, s["i"].int_sum, s["d"].double_sum, s["s"].total_length, s["l.element"].num_values) == (3, 0, 0, 0.0, 0, 0)


def test_sums_beyond_long_are_absent_and_transient_ones_are_not(spark):
    top = (1 << 63) - 1
    over = by_column(S.column_statistics(spark.createDataFrame([(top,), (1,)], "x long")))["x"]
    back = by_column(S.column_statistics(spark.createDataFrame([(top,), (1,), (-1,)], "x long")))["x"]
    assert over.int_sum is None and back.int_sum == top


def test_nan_is_the_greatest(spark):
    s = by_column(S.column_statistics(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")))["x"]
    assert s.double_min == 1.0 and s.double_max != s.double_max


def test_bytes_not_characters(spark):
    assert by_column(S.column_statistics(spark.createDataFrame([("é",)], "x string")))["x"].total_length == 2


@pytest.mark.parametrize("parts", [[0, 50], [7, 20], [1, 1], [49, 50]])
def test_merge_is_the_statistics_of_the_whole(spark, parts):
    rows = [(k, None if k % 5 == 0 else k * k - 400, f"s{k % 9}", Decimal(k) / 4, [k] * (k % 3), (datetime.date(2020, 1, 1) + datetime.timedelta(k))) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, x long, s string, m decimal(9,2), l array<int>, d date").select("*", F.when(F.col("k") < parts[0], 0).when(F.col("k") < parts[1], 1).otherwise(2).alias("part"))
    merged = by_column(S.merge_statistics(S.column_statistics(df, ["part"])))
    assert merged == by_column(S.column_statistics(df.drop("part")))


def test_union_tags_are_checked(spark):
    df = spark.createDataFrame([(0,), (2,)], "t int").select(M.union(F.col("t"), F.lit(1), F.lit("a")).alias("u"))
    with pytest.raises(Exception, match="out of range"):
        df.collect()


def test_type_table(spark, demo):
    rows = {r.column_id: (r.name, r.kind, r.children) for r in M.type_table(spark, demo.drop("id").schema).collect()}
    assert rows[0][1] == "struct" and rows[9] == ("f", "list", [10]) and rows[11] == ("g", "map", [12, 13]) and rows[16] == ("k", "union", [17, 18])


def test_checks(spark, demo):
    checks.require(checks.verify_list(demo, "f"))
    checks.require(checks.verify_map(demo, "g"))
    checks.require(checks.verify_union(demo, "k", 2))
    checks.require(checks.verify_rows(demo, N))
    bad = spark.createDataFrame([((0, None, "x"),)], "u struct<tag:int,c0:int,c1:string>")
    with pytest.raises(AssertionError, match="don't agree"):
        checks.require(checks.verify_union(bad, "u", 2))


def test_null_profile(spark):
    rows = S.null_profile(spark.createDataFrame([(1, None), (2, "a")], "a int, b string")).collect()
    assert [(r.column, r.null_count, r.has_null) for r in rows] == [("a", 0, False), ("b", 1, True)]


def test_ties_and_nulls_are_numbered_in_many_ranges(spark):
    rows = [(None if k % 3 else 7, k, {"a": k}) for k in range(300)]
    df = spark.createDataFrame(rows, "at int, v int, m map<string,int>").repartition(5)
    got = groups.with_row_number(df, ["at"]).collect()
    assert sorted(r.row_number for r in got) == list(range(300))
    assert [r["at"] for r in sorted(got, key=lambda r: r.row_number)] == [None] * 200 + [7] * 100
    again = {r.v: r.row_number for r in groups.with_row_number(df.repartition(3), ["at"]).collect()}
    assert again == {r.v: r.row_number for r in got}
