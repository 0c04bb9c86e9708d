"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many neighbours is pre-aggregated and never gathered in
one task; the steps are checkpointed and nothing but two numbers reaches the driver. Rows of two kinds come from one frame by
exploding pairs, not from unions: Spark 4.1's planner may fail to map the partitioning of a union's children. `few_components` gives
the same of so few links that one task holds them, without the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import checkpointed


def _stars(directed: DataFrame, keep) -> DataFrame:
    """directed: u, v. Each u's neighbours that pass `keep` are hung to the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return directed.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _either(df: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """u and v of each of the pairs of columns, for every row."""
    pairs = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends))
    return df.select(F.explode(pairs).alias("x")).select("x.u", "x.v")


def connected_components(pairs: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of `pairs`, whose two columns are the ends of links."""
    a, b = pairs.columns
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = checkpointed(edges), None
    while True:  # the rounds grow with the logarithm of the longest path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        large = _stars(_either(edges, ("u", "v"), ("v", "u")), F.col("v") > F.col("u")).filter("u <> v").distinct()
        # small star: u hangs to the least of its lower neighbours, and so do the others of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(_either(large.join(least, "u"), ("u", "m"), ("v", "m")).filter("u <> v").distinct())
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return checkpointed(_either(roots, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("root")))


def few_components(pairs: DataFrame) -> DataFrame:
    """What `connected_components` gives, by union and find in one task: for as many links as its memory holds."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = {}

        def top(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a != b:
                    a, b = top(a), top(b)
                    above[max(a, b)] = min(a, b)
        ends = [list(above), [top(x) for x in list(above)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["node", "root"])

    return checkpointed(pairs.coalesce(1).mapInArrow(joined, "node long, root long"))
