"""Appending micro-batches to ORC tables with their statistics, which merge like those of any other groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stripewise.operators.statistics import column_statistics, merge_statistics
from stripewise.sources.orc import WriteConfig, with_orc_timestamps, writer


def start(stream: DataFrame, data_path: str, statistics_path: str, checkpoint: str, config: WriteConfig | None = None, by: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Write each micro-batch to a folder of its own below data_path (batch=N), and its statistics below statistics_path.

    A batch that is repeated after a failure overwrites its own folders, so rows are committed once.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        batch = with_orc_timestamps(batch).persist()
        try:
            writer(batch, config, mode="overwrite").save(f"{data_path}/batch={epoch}")
            column_statistics(batch, by).write.mode("overwrite").parquet(f"{statistics_path}/batch={epoch}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, data_path: str) -> DataFrame:
    """All committed rows, without the batch's number."""
    return spark.read.orc(data_path).drop("batch")


def statistics(spark: SparkSession, statistics_path: str, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of all committed batches, merged."""
    stored = spark.read.parquet(statistics_path)
    return merge_statistics(stored.drop("batch") if "batch" in stored.columns else stored, by).orderBy(*by, F.col("column_id"))
