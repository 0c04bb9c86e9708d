"""Run-length encoders, which depend on the order of values, and run segmentation.

The encoders are greedy with literal groups of at most 128 values that reset the search for runs, so no window function
gives their bytes; they run on ordered lists of a group's values in Arrow batches. Runs are found over whole lists at a time, and
Python steps from group to group, not from value to value. A group is a row group: bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.operators.groups import in_ranges, with_previous, with_running_sum

_LITERALS, _SHORTEST, _LONGEST = 128, 3, 130


def _stretches(same: np.ndarray) -> np.ndarray:
    """For each value how many, from it on, are like their neighbour; same[k]: whether value k + 1 is like value k."""
    places = np.arange(len(same) + 1)
    ends = np.where(np.append(~same, True), places, len(same) + 1)
    return np.minimum.accumulate(ends[::-1])[::-1] - places + 1


def _groups(runs: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(first, length, is a run) of each group. runs: the length of the run at each place."""
    n, place, pending = len(runs), 0, 0
    worth = np.flatnonzero(runs >= _SHORTEST)
    at = 0
    while place < n:
        at += int(np.searchsorted(worth[at:], place))
        run = int(worth[at]) if at < len(worth) else n
        # a run takes back two literals, so both must still be in the open group; else that is filled up first
        if run < n and run - pending + _SHORTEST - 1 < _LITERALS:
            if run > pending:
                yield pending, run - pending, False
            length = min(int(runs[run]), _LONGEST)
            yield run, length, True
            place = pending = run + length
        elif pending + _LITERALS <= n:
            yield pending, _LITERALS, False
            place = pending = pending + _LITERALS
        else:
            break
    if pending < n:
        yield pending, n - pending, False


def byte_rle(data: bytes) -> bytes:
    """Runs of 3 to 130 equal bytes as (length - 3, byte), others as (256 - length, bytes)."""
    values = np.frombuffer(data, dtype=np.uint8)
    out = bytearray()
    for first, length, run in _groups(_stretches(values[1:] == values[:-1])) if len(values) else ():
        out += bytes((length - _SHORTEST, data[first])) if run else bytes((256 - length,)) + data[first : first + length]
    return bytes(out)


def byte_rle_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < _LITERALS:
            out += data[at + 1 : at + 2] * (head + _SHORTEST)
            at += 2
        else:
            out += data[at + 1 : at + 257 - head]
            at += 257 - head
    return bytes(out)


def pack_booleans(bits: Sequence[bool]) -> bytes:
    """Eight to a byte, the first in the highest bit, the last byte filled up with zeros."""
    return np.packbits(np.asarray(bits, dtype=bool)).tobytes()


def bool_rle(bits: Sequence[bool]) -> bytes:
    return byte_rle(pack_booleans(bits))


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned base-128 forms of 64-bit numbers, end to end, and where each begins (and the last ends)."""
    parts = numbers.astype(np.uint64)[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))
    length = np.maximum((parts != 0).sum(axis=1), 1)
    inside = np.arange(10) < length[:, None]
    more = np.arange(10) < length[:, None] - 1
    flat = ((parts & np.uint64(127)) | np.where(more, 128, 0).astype(np.uint64)).astype(np.uint8)[inside]
    return flat, np.concatenate([[0], np.cumsum(length)])


def varint_bytes(x: int) -> bytes:
    """The same of one number of up to 128 bits."""
    out = bytearray()
    x &= (1 << 128) - 1
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def int_rle(values: Sequence[int], signed: bool = True) -> bytes:
    """Runs of 3 to 130 values with one step between -128 and 127 as (length - 3, step, first), others as (256 - length, values).

    Values are taken modulo 2**64, steps as the signed 64-bit differences of those.
    """
    if not len(values):
        return b""
    x = np.array(values, dtype=np.uint64 if not signed and max(values) > 2**63 - 1 else np.int64).view(np.int64)
    with np.errstate(over="ignore"):
        steps = x[1:] - x[:-1]
        numbers = ((x << 1) ^ (x >> 63)).view(np.uint64) if signed else x.view(np.uint64)
    small = (steps >= -128) & (steps <= 127)
    runs = np.ones(len(x), dtype=np.int64)
    if len(x) > 1:  # so many values follow one another with the same step
        runs[:-1] = np.where(small, _stretches(steps[1:] == steps[:-1]) + 1, 1)
    flat, at = varints(numbers)
    out = bytearray()
    for first, length, run in _groups(runs):
        out += bytes((length - _SHORTEST, int(steps[first]) & 255)) if run else bytes((256 - length,))
        out += flat[at[first] : at[first + 1 if run else first + length]].tobytes()
    return bytes(out)


def _udf(encode: Callable):
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(v) for v in values], dtype=object)

    return run


def byte_rle_column(values: Column) -> Column:
    """A list of numbers from 0 to 255 as byte runs."""
    return _udf(lambda v: byte_rle(np.asarray(v).astype(np.int64).astype(np.uint8).tobytes()))(values)


def bool_rle_column(values: Column) -> Column:
    return _udf(bool_rle)(values)


def int_rle_column(values: Column, signed: bool = True) -> Column:
    return _udf(lambda v: int_rle(np.asarray(v).astype(np.int64), signed))(values.cast("array<bigint>"))


ENCODERS = {"byte": byte_rle_column, "boolean": bool_rle_column, "int": int_rle_column, "unsigned": lambda v: int_rle_column(v, False)}


def encoded_groups(df: DataFrame, group: str, order_by: str, column: str, encoder: str) -> DataFrame:
    """group, n and the encoded bytes of the column's present values in order, for each group. Groups must be bounded, as row groups are."""
    pairs = df.filter(F.col(column).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order_by, column))).alias("pairs"))
    values = F.transform("pairs", lambda p: p[column])
    return pairs.select(group, F.size("pairs").alias("n"), ENCODERS[encoder](values).alias("encoded"))


def run_segments(df: DataFrame, column: str, order_by: str, by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of equal values: by, run, value, first, last and length. Not the encoder's groups, which are cut at 130.

    Rows are dealt to ranges of (by, order_by): neither all rows nor all of a key meet in one task. The order should be total.
    """
    by = list(by)
    ranged = in_ranges(df, by, order_by)
    looked = with_previous(ranged, column, by, order_by, "__previous", "__first")
    marked = looked.withColumn("__start", (F.col("__first") | ~F.col(column).eqNullSafe(F.col("__previous"))).cast("int"))
    runs = with_running_sum(marked, "__start", by, order_by, "run").withColumn("run", F.col("run").cast("long"))
    return runs.groupBy(*by, "run").agg(F.first(column).alias("value"), F.min(order_by).alias("first"), F.max(order_by).alias("last"), F.count("*").alias("length"))


def deltas(df: DataFrame, column: str, order_by: str, by: Sequence[str] = (), name: str = "delta") -> DataFrame:
    """df with the column's difference to the row before of the same `by`; null for the first and where it leaves 64 bits."""
    looked = with_previous(in_ranges(df, list(by), order_by), column, list(by), order_by, "__previous", "__first")
    return looked.withColumn(name, F.try_subtract(F.col(column).cast("long"), F.col("__previous").cast("long"))).drop("__previous", "__first", "range")
