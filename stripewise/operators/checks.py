"""Integrity of nested columns: children must be as many as their parents say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.operators.statistics import column_statistics


def verify_list(df: DataFrame, column: str, lengths: str | None = None) -> DataFrame:
    """expected (sum of lengths), found (exploded elements) and holds. lengths: a column that says them, where they are stored apart."""
    length = F.col(lengths) if lengths else F.when(F.col(column).isNotNull(), F.size(column))
    said = df.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("expected"))
    found = df.select(F.explode(column)).agg(F.count("*").alias("found"))
    return _side_by_side(said, found).select("expected", "found", (F.col("expected") == F.col("found")).alias("holds"))


def verify_map(df: DataFrame, column: str | tuple[str, str], lengths: str | None = None) -> DataFrame:
    """expected, keys, values and holds: as many keys and values as the lengths say. column: a map, or a list of keys and one of values."""
    parts = (F.map_keys(column), F.map_values(column)) if isinstance(column, str) else tuple(map(F.col, column))
    length = F.col(lengths) if lengths else F.when(parts[0].isNotNull(), F.size(parts[0]))
    said = df.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("expected"))
    keys, values = (df.select(F.explode(x)).agg(F.count("*").alias(name)) for x, name in zip(parts, ("keys", "values"), strict=True))
    both = _side_by_side(_side_by_side(said, keys), values)
    return both.select("expected", "keys", "values", ((F.col("expected") == F.col("keys")) & (F.col("expected") == F.col("values"))).alias("holds"))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results of one row each, in one row."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def verify_union(df: DataFrame, column: str, variants: int) -> DataFrame:
    """variant, tagged (rows whose tag names it), stray (rows that hold it under another tag) and holds."""
    rows = []
    for k in range(variants):
        mine = F.coalesce(F.col(column)["tag"] == k, F.lit(False))
        stray = F.count_if(~mine & F.col(column)[f"c{k}"].isNotNull())
        rows.append(F.struct(F.lit(k).alias("variant"), F.count_if(mine).alias("tagged"), stray.alias("stray"), (stray == 0).alias("holds")))
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def verify_struct(df: DataFrame, column: str, present: str | None = None) -> DataFrame:
    """present: rows whose struct is there; stray: rows without it that have a field; holds.

    present: a column that says whether it is there, where that is stored apart from the fields.
    """
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.col(column).isNotNull()
    held = F.lit(False)
    for name in df.schema[column].dataType.names:
        held = held | F.col(column)[name].isNotNull()
    stray = F.count_if(~there & F.coalesce(held, F.lit(False)))
    return df.agg(F.count_if(there).alias("present"), stray.alias("stray")).select("present", "stray", (F.col("stray") == 0).alias("holds"))


def verify_rows(df: DataFrame, expected: int) -> DataFrame:
    """expected, found and holds for the number of rows."""
    return df.agg(F.count("*").alias("found")).select(F.lit(expected).cast("long").alias("expected"), "found", (F.col("found") == expected).alias("holds"))


def verify_children(df: DataFrame) -> DataFrame:
    """column_id, column, kind, num_values and holds for every column of the tree: none has more present values than values."""
    return column_statistics(df).select("column_id", "column", "kind", "num_values", (F.col("num_present") <= F.col("num_values")).alias("holds"))


def require(result: DataFrame) -> None:
    """Raise an error that names the failing rows of one of these checks, which are few."""
    bad = result.filter(~F.col("holds")).collect()
    if bad:
        raise AssertionError(f"row counts don't agree: {bad}")
