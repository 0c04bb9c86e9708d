"""Helpers shared by the training-data operators: shared storage, text conventions and row splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space: a word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only in local mode, where the driver is the executor, may it be unset: then a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stripewise-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard_all(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once the results that may still read them are written elsewhere."""
    discard(spark, f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as each write ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to a scratch table, and its path; what was shuffled for them is dropped at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_of(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def word_count(column: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, most: int, most_bytes: int, group: str = "label") -> DataFrame:
    """Of each group of `rows` (id, text, label) at most `most` distinct rows, and of these as many as have `most_bytes` of text together.

    Those with the least hashes of id, text and label are taken, whatever the partitions; rows with over a sixteenth of the bytes
    are never. What is not near the least hashes goes before anything is shuffled, so a group's ranking sees some 1.5 * most rows.
    """
    rows = rows.filter(16 * F.octet_length("text") <= most_bytes).withColumn("h", F.xxhash64("id", "text", "label")).withColumn("g", F.col(group))
    share = F.least(F.lit(1.0), F.lit(1.5 * most + 20.0) / F.count("*"))
    shares = rows.groupBy("g").agg(share.alias("share"))
    near = rows.join(F.broadcast(shares), "g").filter((F.col("h").cast("double") + 2.0**63) / 2.0**64 < F.col("share"))  # one row for each group
    once = near.groupBy("g", "h").agg(*(F.first(c).alias(c) for c in ("id", "text", "label")))
    order = W.partitionBy("g").orderBy("h")
    ranked = once.withColumns({"r": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    return ranked.filter((F.col("r") <= most) & (F.col("bytes") <= most_bytes)).select("id", "text", "label", "h")


def fresh_names(docs: DataFrame, *columns: str) -> dict[str, str]:
    """For each of the wanted columns a name that `docs` lacks."""
    taken = {c.lower() for c in docs.columns}
    out = {}
    for name in columns:
        fresh = name
        while fresh.lower() in taken:
            fresh = f"_{fresh}"
        taken.add(fresh.lower())
        out[name] = fresh
    return out


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
