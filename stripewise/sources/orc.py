"""ORC files through Spark's own writer and reader, behind a validated configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.operators.groups import with_row_number

CODECS = ("none", "snappy", "zstd", "zlib", "lz4", "lzo")
MAX_BLOCK = 0x7FFFFF
LEAST_STRIDE = 1000
#: Rows that Spark hands to the writer at once.
BATCH = 1024
#: Rows of a file, about, where a table is written in order.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class WriteConfig:
    """How files are laid out; every `with_` returns a changed copy.

    stripe_size is a goal in bytes that the writer tests as it buffers. compression_block_size is an upper bound: the
    writer takes smaller blocks where stripes are small for the number of columns.
    """

    row_index_stride: int = 10_000
    compression: str = "none"
    stripe_size: int = 64 << 20
    compression_block_size: int = 256 << 10
    compression_level: int | None = None
    bloom_filter_columns: tuple[str, ...] = ()
    whole_groups: bool = False

    LEVELS: ClassVar[dict[str, range]] = {"zstd": range(1, 23)}

    def __post_init__(self):
        if self.row_index_stride < LEAST_STRIDE:
            raise ValueError(f"row_index_stride must be at least {LEAST_STRIDE}: the writer takes no less")
        if self.stripe_size < 1:
            raise ValueError("stripe_size must be positive")
        if self.compression not in CODECS:
            raise ValueError(f"compression must be one of {', '.join(CODECS)}")
        if not 0 < self.compression_block_size <= MAX_BLOCK:
            raise ValueError(f"compression_block_size must be between 1 and {MAX_BLOCK}: a block's length has 23 bits")
        if self.compression_level is not None and self.compression_level not in self.LEVELS.get(self.compression, ()):
            raise ValueError(f"{self.compression} has no level {self.compression_level}")

    def with_row_index_stride(self, rows: int) -> WriteConfig:
        return replace(self, row_index_stride=rows)

    def with_stripe_size(self, size: int) -> WriteConfig:
        return replace(self, stripe_size=size)

    def with_compression(self, codec: str, block_size: int | None = None, level: int | None = None) -> WriteConfig:
        if codec == "zstd" and level is None:
            level = 3
        return replace(self, compression=codec, compression_block_size=block_size or self.compression_block_size, compression_level=level)

    def with_whole_groups(self) -> WriteConfig:
        """Stripes end with full row groups: the writer tests their size only where a batch and a row group end together."""
        return replace(self, whole_groups=True)

    def with_bloom_filter(self, *columns: str) -> WriteConfig:
        return replace(self, bloom_filter_columns=columns)

    def options(self) -> dict[str, str]:
        out = {"compression": self.compression, "orc.row.index.stride": str(self.row_index_stride), "orc.stripe.size": str(self.stripe_size), "orc.compress.size": str(self.compression_block_size)}
        if self.compression_level is not None:
            out["orc.compression.zstd.level"] = str(self.compression_level)
        if self.whole_groups:
            out["orc.rows.between.memory.checks"] = str(math.lcm(BATCH, self.row_index_stride))
        if self.bloom_filter_columns:
            out["orc.bloom.filter.columns"] = ",".join(self.bloom_filter_columns)
        return out


def with_orc_timestamps(df: DataFrame) -> DataFrame:
    """Top-level timestamps without a zone as instants, since files would hold them as plain numbers otherwise.

    The session's zone should be UTC.
    """
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp") for c in naive}) if naive else df


def as_table(values: DataFrame) -> DataFrame:
    """A single column of any type as a table, under the name `value`: files have a struct at their root."""
    if len(values.columns) != 1:
        raise ValueError("one column is needed")
    return values.toDF("value")


def writer(df: DataFrame, config: WriteConfig | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> DataFrameWriter:
    out = df.write.mode(mode).format("orc").options(**(config or WriteConfig()).options())
    return out.partitionBy(*partition_by) if partition_by else out


def write(df: DataFrame, path: str, config: WriteConfig | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), sort_within: tuple[str, ...] = (), files: int | None = None) -> None:
    """Write a table. sort_within orders each task's rows so that row groups' ranges are narrow; files sets their number."""
    if files is not None:
        df = df.coalesce(files) if files == 1 else df.repartition(files)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer(df, config, mode, partition_by).save(path)


def write_in_order(df: DataFrame, path: str, order_by: tuple[str, ...], config: WriteConfig | None = None, mode: str = "errorifexists", file_rows: int | None = None) -> None:
    """Write a table in an order as files of about `file_rows` rows, which follow one another by name.

    All of them have whole row groups but the last, so that groups counted on from file to file are those of the whole table. A task
    sorts and writes the rows of one file, however many the table has.
    """
    config, rows = config or WriteConfig(), df.count()
    files = max(1, math.ceil(rows / (file_rows or FILE_ROWS)))
    group = F.floor(F.col("__row") / config.row_index_stride)
    numbered = with_row_number(df, order_by, "__row", partitions=files)
    writer(numbered.repartitionByRange(files, group).sortWithinPartitions("__row").drop("__row"), config, mode).save(path)


def append_batch(df: DataFrame, path: str, config: WriteConfig | None = None, expected: int | None = None) -> None:
    """Commit a batch to a table; `expected` rows, if given, are verified before anything is written."""
    if expected is not None and (found := df.count()) != expected:
        raise AssertionError(f"the batch has {found} rows, not {expected}")
    write(df, path, config, mode="append")


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.orc(path)
