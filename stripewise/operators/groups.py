"""Row groups and stripes: numbering rows in order over many tasks, and statistics by group that merge upwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stripewise.model.types import type_tree
from stripewise.operators.statistics import column_label, column_statistics, merge_statistics
from stripewise.storage import settled

STRIDE = 10_000
_LOCAL = (1 << 33) - 1


def with_row_number(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with the place of each row in the order, from 0.

    Rows are dealt to ranges of the order and numbered within each; the ranges' sizes, one number each, give the
    offsets. No task sees all rows; `partitions` sets the number of ranges. Rows that the order doesn't tell apart (ties, nulls) are told apart by a hash of what they hold,
    so that very many of them are dealt out as well. The rows are written to the shared folder once, since what range a row is in must
    not change.
    """
    held = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    order = [*order_by, F.xxhash64(*held)] if held else list(order_by)
    ordered = settled(df.repartitionByRange(*((partitions,) if partitions else ()), *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    placed = ordered.withColumn("__range", F.shiftright("__place", 33))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__rows"))  # one row for each range
    offsets = sizes.select("__range", (F.sum("__rows").over(W.orderBy("__range")) - F.col("__rows")).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__offset") + F.col("__place").bitwiseAND(F.lit(_LOCAL))).drop("__range", "__place", "__offset")


def _hashable(kind: T.DataType) -> bool:
    """Whether a type has no map inside: Spark doesn't hash those."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType)


def in_ranges(df: DataFrame, by: Sequence[str], order_by: str, name: str = "range") -> DataFrame:
    """df with the range of (by, order_by) that each row was dealt to, numbered in order, so that a key of any size is in many."""
    return settled(df.repartitionByRange(*by, order_by).withColumn(name, F.spark_partition_id()))


def with_previous(ranged: DataFrame, column: str, by: Sequence[str], order_by: str, name: str, first: str, range_name: str = "range") -> DataFrame:
    """Rows of `in_ranges` with the column's value in the row before of the same `by`, and whether there is none before.

    Rows look back within their range; a range's first row of a key takes the last value of the ranges before it, which is one
    row for each range and key.
    """
    within = W.partitionBy(range_name, *by).orderBy(order_by)
    ends = ranged.groupBy(range_name, *by).agg(F.max_by(F.struct(F.col(column).alias("x")), order_by).alias("last"))
    carried = F.lag("last").over(W.partitionBy(*by).orderBy(range_name))
    ends = ends.select(F.col(range_name).alias("__range"), *(F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)), carried.alias("__carried"))
    on = [F.col(range_name) == F.col("__range"), *(F.col(c).eqNullSafe(F.col(f"__by_{k}")) for k, c in enumerate(by))]
    looked = ranged.withColumns({"__place": F.row_number().over(within), "__before": F.lag(column).over(within)}).join(ends, on)
    opens = F.col("__place") == 1
    return looked.withColumns({name: F.when(opens, F.col("__carried.x")).otherwise(F.col("__before")), first: opens & F.col("__carried").isNull()}).drop("__place", "__before", "__carried", "__range", *(f"__by_{k}" for k in range(len(by))))


def with_running_sum(ranged: DataFrame, column: str, by: Sequence[str], order_by: str, name: str, range_name: str = "range") -> DataFrame:
    """Rows of `in_ranges` with the sum of the column up to and with each row of the same `by`: within ranges, then over their totals."""
    within = W.partitionBy(range_name, *by).orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy(range_name, *by).agg(F.sum(column).alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*by).orderBy(range_name)) - F.col("__total")
    totals = totals.select(F.col(range_name).alias("__range"), *(F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)), before.alias("__earlier"))
    on = [F.col(range_name) == F.col("__range"), *(F.col(c).eqNullSafe(F.col(f"__by_{k}")) for k, c in enumerate(by))]
    return ranged.withColumn(name, F.sum(column).over(within)).join(totals, on).withColumn(name, F.col(name) + F.col("__earlier")).drop("__earlier", "__range", *(f"__by_{k}" for k in range(len(by))))


def assign_row_groups(df: DataFrame, order_by: Sequence[str | Column], stride: int = STRIDE, name: str = "row_group") -> DataFrame:
    """df with the number of each row's group of `stride` rows in the order; the last group may be smaller."""
    if stride < 1:
        raise ValueError("the stride must be positive")
    return with_row_number(df, order_by, "__row").withColumn(name, F.floor(F.col("__row") / stride).cast("long")).drop("__row")


def row_group_statistics(df: DataFrame, order_by: Sequence[str], stride: int = STRIDE, grouping: str = "rows") -> DataFrame:
    """row_group and the statistics of its columns.

    grouping "rows" counts rows for all columns alike, nested ones too. "values" counts each column's own values: a list's
    elements, a map's entries and a union's variants have groups of `stride` values of their own.
    """
    if grouping == "rows":
        return column_statistics(assign_row_groups(df, order_by, stride), ["row_group"])
    if grouping != "values":
        raise ValueError("grouping is 'rows' or 'values'")
    numbered = with_row_number(df, order_by, "__row")
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    whole = numbered.withColumn("row_group", F.floor(F.col("__row") / stride).cast("long"))
    parts = [column_statistics(whole.drop("__row"), ["row_group"]).filter(F.col("kind").isin("list", "map") | (F.col("column") == "_root") | F.split("column", r"\.")[0].isin(flat))]
    for f in df.schema.fields:
        if f.name in flat:
            continue
        entries = numbered.select("__row", F.posexplode(f"`{f.name}`").alias("__at", *(("v",) if isinstance(f.dataType, T.ArrayType) else ("k", "v"))))
        own = assign_row_groups(entries, ["__row", "__at"], stride)
        for child, column in (("element", "v"),) if isinstance(f.dataType, T.ArrayType) else (("key", "k"), ("value", "v")):
            label = f"{f.name}.{child}"
            found = column_statistics(own.select("row_group", F.col(column).alias(child)), ["row_group"]).filter(F.col("column") != "_root")
            parts.append(found.withColumn("column", F.concat(F.lit(f"{f.name}."), F.col("column"))).withColumn("column_id", F.col("column_id") - 1 + _id_of(df, label)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _id_of(df: DataFrame, label: str) -> int:
    return next(n.id for n in type_tree(df.schema).walk() if column_label(n) == label)


def stripe_statistics(groups: DataFrame, groups_per_stripe: int) -> DataFrame:
    """stripe and the statistics of its columns, merged from row groups."""
    return merge_statistics(groups.withColumn("stripe", F.floor(F.col("row_group") / groups_per_stripe).cast("long")), ["stripe"])


def file_statistics(parts: DataFrame) -> DataFrame:
    """The statistics of the whole, merged from row groups or stripes."""
    return merge_statistics(parts)


def prune(groups: DataFrame, column: str, measure: str, at_least=None, at_most=None) -> DataFrame:
    """Row groups that may hold a value of `column` in the range, by their least and greatest: the others can be skipped."""
    zone = groups.filter(F.col("column") == column)
    if at_least is not None:
        zone = zone.filter(F.col(f"{measure}_max") >= F.lit(at_least))
    if at_most is not None:
        zone = zone.filter(F.col(f"{measure}_min") <= F.lit(at_most))
    return zone
