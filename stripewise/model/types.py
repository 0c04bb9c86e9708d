"""The nested type tree of a schema, numbered in pre-order as ORC numbers its columns, and tagged unions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Metadata key of a struct that stands for a union.
UNION = "union"
MAX_VARIANTS = 256


@dataclass
class Node:
    """A column of the tree. path: how it is reached from the root, with the kind of each step."""

    id: int
    name: str
    kind: str
    data_type: T.DataType
    path: tuple[tuple[str, str], ...]
    parent: int | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


_KINDS = {
    T.BooleanType: "boolean",
    T.ByteType: "byte",
    T.ShortType: "short",
    T.IntegerType: "int",
    T.LongType: "long",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.StringType: "string",
    T.BinaryType: "binary",
    T.DateType: "date",
    T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp",
    T.DecimalType: "decimal",
    T.CharType: "char",
    T.VarcharType: "varchar",
}


def is_union(field_: T.StructField | None, data_type: T.DataType) -> bool:
    """Whether a struct is marked as a union and looks like one: a tag, then one field for each variant."""
    marked = field_ is not None and bool((field_.metadata or {}).get(UNION))
    return marked and isinstance(data_type, T.StructType) and data_type.names == ["tag", *(f"c{k}" for k in range(len(data_type) - 1))]


def type_tree(schema: T.StructType) -> Node:
    """The tree of a table's schema; the root is the row."""
    counter = iter(range(1 << 30))

    def build(name: str, data_type: T.DataType, path: tuple, parent: int | None, own: T.StructField | None = None) -> Node:
        node = Node(next(counter), name, "struct", data_type, path, parent)
        if is_union(own, data_type):
            node.kind = "union"
            node.children = [build(f"c{k}", data_type[f"c{k}"].dataType, (*path, ("variant", str(k))), node.id) for k in range(len(data_type) - 1)]
        elif isinstance(data_type, T.StructType):
            node.children = [build(f.name, f.dataType, (*path, ("field", f.name)), node.id, f) for f in data_type.fields]
        elif isinstance(data_type, T.ArrayType):
            node.kind = "list"
            node.children = [build("element", data_type.elementType, (*path, ("element", "")), node.id)]
        elif isinstance(data_type, T.MapType):
            node.kind = "map"
            node.children = [build("key", data_type.keyType, (*path, ("key", "")), node.id), build("value", data_type.valueType, (*path, ("value", "")), node.id)]
        elif type(data_type) in _KINDS:
            node.kind = _KINDS[type(data_type)]
        else:
            raise TypeError(f"{data_type.simpleString()} has no place in the type tree")
        return node

    return build("", schema, (), None)


def type_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The tree as rows: column_id, parent_id, name, kind, children, precision, scale, max_length."""
    rows = [
        (
            n.id,
            n.parent,
            n.name,
            n.kind,
            [c.id for c in n.children],
            n.data_type.precision if isinstance(n.data_type, T.DecimalType) else None,
            n.data_type.scale if isinstance(n.data_type, T.DecimalType) else None,
            n.data_type.length if isinstance(n.data_type, (T.CharType, T.VarcharType)) else None,
        )
        for n in type_tree(schema).walk()
    ]
    return spark.createDataFrame(rows, "column_id int, parent_id int, name string, kind string, children array<int>, precision int, scale int, max_length int")


def union(tag: Column, *variants: Column) -> Column:
    """A tagged struct; only the variant that the tag names is kept, and a tag out of range raises an error."""
    if not 0 < len(variants) <= MAX_VARIANTS:
        raise ValueError(f"a union has 1 to {MAX_VARIANTS} variants")
    wrong = (tag < 0) | (tag >= len(variants))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("union tag out of range: "), tag.cast("string")))).otherwise(tag).cast("int")
    return F.when(tag.isNotNull(), F.struct(checked.alias("tag"), *(F.when(tag == k, v).alias(f"c{k}") for k, v in enumerate(variants))))


def as_union(df: DataFrame, column: str) -> DataFrame:
    """Mark a column that `union` made, so that it counts as one column with variants in the type tree."""
    return df.withMetadata(column, {UNION: True})
