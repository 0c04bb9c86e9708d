"""Column statistics of nested tables as ordinary two-phase aggregations.

The result is a table with one row for each group and column of the type tree, whatever the columns' kinds, so that
statistics of row groups merge into those of stripes and of files by one more aggregation. Everything that isn't
repeated is aggregated in one scan; each list or map takes one more, over its exploded children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.functions import encodings as E
from stripewise.model.types import Node, type_tree

#: The measures of a column and how two of each merge. The rest of a row is derived from these.
MEASURES: dict[str, tuple[str, str]] = {
    "num_values": ("bigint", "sum"),
    "num_present": ("bigint", "sum"),
    "true_count": ("bigint", "sum"),
    "false_count": ("bigint", "sum"),
    "int_min": ("bigint", "min"),
    "int_max": ("bigint", "max"),
    "int_total": ("decimal(38,0)", "sum"),
    "double_min": ("double", "min"),
    "double_max": ("double", "max"),
    "double_sum": ("double", "sum"),
    "decimal_min": ("decimal(38,0)", "min"),
    "decimal_max": ("decimal(38,0)", "max"),
    "decimal_total": ("decimal(38,0)", "sum"),
    "string_min": ("string", "min"),
    "string_max": ("string", "max"),
    "total_length": ("bigint", "sum"),
    "date_min": ("date", "min"),
    "date_max": ("date", "max"),
    "millis_min": ("bigint", "min"),
    "millis_max": ("bigint", "max"),
}
_LABELS = ("column_id", "column", "kind", "scale")


def _total(x: Column) -> Column:
    """An exact sum, 0 if there is nothing to add up; null where it leaves 38 digits."""
    return F.when(F.count(x) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.try_sum(x.cast("decimal(38,0)")))


def _integer_total(x: Column) -> Column:
    """The same of an integer column, as sums of three parts of its bits: plain long additions, exact up to 2**41 rows."""
    x, part = x.cast("long"), (1 << 21) - 1
    sums = [F.sum(F.shiftright(x, 42)), F.sum(F.shiftright(x, 21).bitwiseAND(F.lit(part).cast("long"))), F.sum(x.bitwiseAND(F.lit(part).cast("long")))]
    high, middle, low = (F.coalesce(y, F.lit(0)).cast("decimal(19,0)") for y in sums)
    return (high * F.lit(1 << 42).cast("decimal(13,0)") + middle * F.lit(1 << 21).cast("decimal(7,0)") + low).cast("decimal(38,0)")


def measures(kind: str, x: Column, scale: int = 0, precision: int = 38) -> dict[str, Column]:
    """Aggregates over the non-null values of a column of this kind."""
    if kind == "boolean":
        return {"true_count": F.count_if(x), "false_count": F.count_if(~x)}
    if kind in ("byte", "short", "int", "long"):
        return {"int_min": F.min(x), "int_max": F.max(x), "int_total": _integer_total(x)}
    if kind == "date":
        day = E.epoch_day(x)
        return {"int_min": F.min(day), "int_max": F.max(day), "int_total": _integer_total(day), "date_min": F.min(x), "date_max": F.max(x)}
    if kind in ("float", "double"):
        wide = x.cast("double")
        return {"double_min": F.min(wide), "double_max": F.max(wide), "double_sum": F.coalesce(F.sum(wide), F.lit(0.0))}
    if kind == "decimal":
        whole = E.decimal_unscaled(x, scale, precision)
        return {"decimal_min": F.min(whole), "decimal_max": F.max(whole), "decimal_total": _total(whole)}
    if kind == "timestamp":
        millis = E.epoch_millis(x)
        return {"millis_min": F.min(millis), "millis_max": F.max(millis)}
    if kind in ("string", "char", "varchar"):
        return {"string_min": F.min(x), "string_max": F.max(x), "total_length": F.coalesce(F.sum(F.octet_length(x)), F.lit(0))}
    if kind == "binary":
        return {"total_length": F.coalesce(F.sum(F.octet_length(x)), F.lit(0))}
    return {}


def _scale(node: Node) -> int | None:
    return node.data_type.scale if isinstance(node.data_type, T.DecimalType) else None


def column_label(node: Node) -> str:
    """The path of a column, `_root` for the row itself."""
    return ".".join({"element": "element", "key": "key", "value": "value"}.get(step, name if step == "field" else f"c{name}") for step, name in node.path) or "_root"


def _row(node: Node, value: Column, counted: Column | None) -> Column:
    """The struct of a node's measures. counted: whether a row has a value, be it null, for the node; None if every row has."""
    own = measures(node.kind, value, _scale(node) or 0, node.data_type.precision if isinstance(node.data_type, T.DecimalType) else 38)
    if counted is None:
        own |= {"num_values": F.count(F.lit(1)), "num_present": F.count(value)}
    else:
        own |= {"num_values": F.count_if(counted), "num_present": F.count_if(counted & value.isNotNull())}
    fixed = [F.lit(node.id).alias("column_id"), F.lit(column_label(node)).alias("column"), F.lit(node.kind).alias("kind"), F.lit(_scale(node)).cast("int").alias("scale")]
    return F.struct(*fixed, *(own.get(name, F.lit(None)).cast(kind).alias(name) for name, (kind, _) in MEASURES.items()))


def column_statistics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, column_id, column, kind, scale and MEASURES of every column in the type tree of `df` without `by`.

    num_values counts a value for each row, for a struct's fields one for each present struct, for a list's or map's
    children one for each entry, for a union's variant one for each row whose tag names it.
    """
    by = list(by)
    own = [c for c in df.columns if c not in by]
    tree = type_tree(df.select(*own).schema)
    groups = {g: f"__by_{k}" for k, g in enumerate(by)}
    keys = list(groups.values())
    flat = df.select(*(F.col(f"`{g}`").alias(a) for g, a in groups.items()), F.struct(*(F.col(f"`{c}`") for c in own)).alias("v")) if own else df.select(*(F.col(f"`{g}`").alias(a) for g, a in groups.items()), F.lit(True).alias("v"))
    frames: list[DataFrame] = []

    def level(frame: DataFrame, roots: list[tuple[Node, Column]]) -> None:
        rows: list[Column] = []
        later: list[tuple[Node, Column]] = []

        def reach(node: Node, value: Column, counted: Column | None) -> None:
            rows.append(_row(node, value, counted))
            if node.kind == "struct":
                inside = None if node is tree else value.isNotNull() if counted is None else counted & value.isNotNull()  # the row itself is never null
                for child in node.children:
                    reach(child, value.getField(child.name), inside)
            elif node.kind == "union":
                for k, child in enumerate(node.children):
                    mine = (F.lit(True) if counted is None else counted) & F.coalesce(value.getField("tag") == k, F.lit(False))
                    reach(child, F.when(mine, value.getField(child.name)), mine)
            elif node.kind in ("list", "map"):
                later.append((node, value))

        for node, value in roots:
            reach(node, value, None)
        frames.append(frame.groupBy(*keys).agg(F.array(*rows).alias("rows")).select(*keys, F.explode("rows").alias("s")).select(*keys, "s.*"))
        for node, value in later:
            if node.kind == "list":
                level(frame.select(*keys, F.explode(value).alias("v")), [(node.children[0], F.col("v"))])
            else:
                level(frame.select(*keys, F.explode(value).alias("k", "v")), [(node.children[0], F.col("k")), (node.children[1], F.col("v"))])

    level(flat, [(tree, F.col("v"))])
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.select(*(F.col(a).alias(g) for g, a in groups.items()), *_LABELS, *MEASURES)


def merge_statistics(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The statistics of the union of groups: of rows of `column_statistics` that agree in `by`, one for each column."""

    def merged(name: str, kind: str, how: str) -> Column:
        x = F.col(name)
        out = {"min": F.min, "max": F.max}[how](x) if how != "sum" else F.try_sum(x) if kind.startswith("decimal") else F.sum(x)
        if kind == "decimal(38,0)" and how == "sum":  # one absent total makes the whole absent
            out = F.when(F.count(x) == F.count(F.lit(1)), out)
        return out.cast(kind).alias(name)

    return stats.groupBy(*by, *_LABELS).agg(*(merged(name, kind, how) for name, (kind, how) in MEASURES.items()))


def int_sum() -> Column:
    """The sum of an integer column as a long; null where it doesn't fit."""
    return E.fits_long(F.col("int_total"))


def has_null() -> Column:
    return F.col("num_values") != F.col("num_present")


def decimal_texts(name: str) -> Column:
    """A decimal measure as text by the column's scale: without fraction where it is zero, else with all its digits."""
    x, unit = F.col(name), F.rpad(F.lit("1"), F.col("scale") + 1, "0").cast("decimal(38,0)")
    whole, rest = F.floor(F.abs(x) / unit).cast("decimal(38,0)"), F.abs(x) % unit
    whole = ((F.abs(x) - rest) / unit).cast("decimal(38,0)")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(rest == 0, F.concat(sign, whole.cast("string"))).otherwise(F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(rest.cast("decimal(38,0)").cast("string"), F.col("scale"), F.lit("0"))))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, num_values, num_present, null_count and has_null of top-level columns, in one scan."""
    columns = list(columns or df.columns)
    rows = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("num_values"), F.count(F.col(f"`{c}`")).alias("num_present")) for c in columns]
    out = df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("s")).select("s.*")
    return out.select("*", (F.col("num_values") - F.col("num_present")).alias("null_count"), has_null().alias("has_null"))
