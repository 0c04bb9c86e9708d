"""Mixing sources to target weights by blocks.

The words of each source, document after document, form a stream that is cut into blocks of a fixed length. Every
output shard draws multinomial source counts for its slots. The k-th slot of a source takes block k of a pseudorandom
permutation of that source's block indices, one permutation for each pass over the source, and slots are joined to
blocks by (source, index).

Of the sources only the totals reach the driver, about a hundred bytes each, for their targets. Draws are made by tasks: the counts of
all shards are split among ranges of shards, and these among theirs, until a task draws for some shards one by one; each range
also knows where in a source's slots it begins. Positions in the streams are prefix sums over spans of hash buckets, then over the
buckets of a span, then over the rows of a bucket, so that no source is sorted in one task; equal rows are one row with a count there.

Defined results: a null text has size 0 and is never taken; null is a source of its own, ordered last; repeated rows are
rows of their own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stripewise.llm.common import checkpointed, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
ROWS_PER_BUCKET = 256
BUCKETS_PER_SPAN = 1024
#: Output shards: so many at least, and none of more words than this, so that no shard's slots outgrow a task.
LEAST_SHARDS = 64
WORDS_PER_SHARD = 1 << 26

PLAN_SCHEMA = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("n_blocks", T.LongType()),
        T.StructField("multiplier", T.LongType()),
        T.StructField("shift", T.LongType()),
        T.StructField("final", T.LongType()),
        T.StructField("trim", T.LongType()),
    ]
)
DRAW_SCHEMA = "k int, shard int, first long, slots long"
NODE_SCHEMA = "lo int, hi int, counts binary, firsts binary"
#: Parts that a range of shards is split into, and sources that are broadcast at most.
FANOUT = 64
BROADCAST_SOURCES = 100_000
COPIES_AT_ONCE = 4096


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size: the excess goes by weight to the rest."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / whole for k in open_}
        full = {k for k in open_ if share[k] > most * sizes[k]}
        if not full:
            for k in open_:
                targets[k] = share[k]
            break
        for k in full:
            targets[k] = most * sizes[k]
            left -= targets[k]
        open_ -= full
    return targets


@dataclass
class Quota:
    """What the mix takes of one source: passes over all of it, then a part, ending inside a block."""

    size: int
    block: int
    words: int

    @property
    def n_blocks(self) -> int:
        return -(-self.size // self.block)

    def slots(self, permuted_last: int) -> tuple[int, int]:
        """The number of slots, and the words that the last of them takes.

        permuted_last: where the short last block stands in the permutation of the unfinished pass.
        """
        passes, rest = divmod(self.words, self.size)
        if rest == 0:
            return passes * self.n_blocks, -1
        short = self.block * self.n_blocks - self.size
        count = -(-rest // self.block)
        if permuted_last < count:
            count = -(-(rest + short) // self.block)
        before = (count - 1) * self.block - (short if permuted_last < count - 1 else 0)
        return passes * self.n_blocks + count, rest - before


def permutation(n: int, seed: int) -> tuple[int, int]:
    """Multiplier and shift of an affine permutation of range(n); both below 2**31."""
    rng = np.random.default_rng([seed, n])
    while math.gcd(multiplier := int(rng.integers(1, 1 << 31)), n) != 1:
        pass
    return multiplier, int(rng.integers(0, 1 << 31))


def shard_slots(total: int, n_shards: int, lo: int, hi: int) -> int:
    """Slots of the shards from lo to hi: all shards have the same number but for one, the later ones the more."""
    each, more = divmod(total, n_shards)
    return each * (hi - lo) + max(0, hi - max(lo, n_shards - more))


def split_counts(counts: np.ndarray, firsts: np.ndarray, cuts: list[int], total: int, n_shards: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Multinomial source counts of each range of shards between the cuts, in proportion to what those before have left.

    The counts of a source add up to what the whole range has. With each range go the places in the sources' slots where it begins.
    """
    left, first, out = counts.copy(), firsts.copy(), []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        rng = np.random.default_rng([seed, lo, hi])
        drawn = np.zeros_like(left)
        while wanted := shard_slots(total, n_shards, lo, hi) - int(drawn.sum()):
            rest = left - drawn
            drawn += np.minimum(rng.multinomial(wanted, rest / rest.sum()), rest)
        out.append((lo, hi, drawn, first.copy()))
        left -= drawn
        first += drawn
    return out


def draw_counts(spark: SparkSession, quotas: list[int], n_shards: int, seed: int) -> DataFrame:
    """k, shard, first and slots of every source that a shard draws from: how many of its slots, and from which on."""
    total = sum(quotas)
    zeros = np.zeros(len(quotas), dtype=np.int64)
    nodes = spark.createDataFrame([(0, n_shards, np.array(quotas, dtype=np.int64).tobytes(), zeros.tobytes())] if total else [], NODE_SCHEMA)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi = batch.column("lo")[row].as_py(), batch.column("hi")[row].as_py()
                counts, firsts = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("counts", "firsts"))
                n = min(FANOUT, hi - lo)
                yield from split_counts(counts, firsts, [lo + (hi - lo) * k // n for k in range(n + 1)], total, n_shards, seed)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, counts, firsts in parts_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([hi], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([firsts.tobytes()], pa.binary())], names=["lo", "hi", "counts", "firsts"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, _, counts, firsts in parts_of(batches):
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), lo, np.int32)), pa.array(firsts[some]), pa.array(counts[some])], names=["k", "shard", "first", "slots"])

    width, ranges = n_shards, 1
    while width > FANOUT:
        nodes = nodes.mapInArrow(split, NODE_SCHEMA)
        width, ranges = -(-width // FANOUT), ranges * FANOUT
        nodes = nodes.repartition(min(ranges, n_shards), "lo")
    return nodes.mapInArrow(draw, DRAW_SCHEMA)


def permuted(index: Column, n: Column, multiplier: Column, shift: Column) -> Column:
    """Where slot `index` of a pass points, in arithmetic that can't overflow."""
    at = F.pmod(index, n).cast("decimal(38,0)") * multiplier.cast("decimal(20,0)") + shift
    return F.pmod(at, n.cast("decimal(20,0)")).cast("long")


def streams(sized: DataFrame, buckets: int) -> DataFrame:
    """Distinct rows with size, copies and, for each, bucket, rank in the bucket and the offset of the first copy in its source's word stream."""
    sized = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    sized = sized.withColumns({"bucket": F.pmod(F.xxhash64(F.col("doc_id"), F.col("size")), F.lit(buckets)).cast("int"), "all": F.col("size") * F.col("copies")})
    parts = sized.groupBy("source", "bucket").agg(F.sum("all").alias("words"))
    parts = parts.withColumn("span", F.floor(F.col("bucket") / BUCKETS_PER_SPAN))
    spans = parts.groupBy("source", "span").agg(F.sum("words").alias("words"))
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("p"), (F.sum("words").over(W.partitionBy("source").orderBy("span")) - F.col("words")).alias("before"))
    within_span = F.sum("words").over(W.partitionBy("source", "span").orderBy("bucket")) - F.col("words")
    starts = parts.withColumn("start", within_span).join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).select("source", "bucket", (F.col("before") + F.col("start")).alias("start"))
    order = W.partitionBy("source", "bucket").orderBy("doc_id", "size")
    ranked = sized.withColumns({"rank": F.row_number().over(order), "within": F.sum("all").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("all")})
    return ranked.join(starts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (ranked["bucket"] == starts["bucket"])).select(
        "doc_id", "source", "size", "copies", ranked["bucket"], "rank", (F.col("start") + F.col("within")).alias("offset")
    )


def each_copy(placed: DataFrame) -> DataFrame:
    """Every row of `streams` as often as it has copies, with the number and the offset of each; very many are dealt out first."""
    if placed.filter(F.col("copies") > COPIES_AT_ONCE).limit(1).count():
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("from")
        placed = placed.select("*", part).repartition("source", "bucket", "rank", "from")
        copies = F.sequence("from", F.least(F.col("from") + COPIES_AT_ONCE, F.col("copies")) - 1)
    else:
        copies = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    return placed.select("doc_id", "source", "size", "bucket", "rank", "offset", F.explode(copies).alias("copy")).withColumn("offset", F.col("offset") + F.col("copy") * F.col("size"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    block: int = 128,
    n_shards: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    The first has doc_id, size, source_size, target and taken (words, repeats counted) of every row of `docs`; the second
    the slots of the output: shard, slot, source, block (index in the source's stream) and words (taken from its start).
    Without `n_shards` there are LEAST_SHARDS, or as many as hold WORDS_PER_SHARD words each. Reruns agree: the draws follow from the totals and `seed`, positions from the rows.
    """
    spark = docs.sparkSession
    # texts are read once: what follows needs their sizes only
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).toArrow()  # a row for each source
    names, words, rows = (totals.column(c).to_pylist() for c in ("source", "words", "n"))
    by_name = sorted(range(len(names)), key=lambda k: (names[k] is None, names[k] or ""))
    names, sizes = [names[k] for k in by_name], [words[k] or 0 for k in by_name]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes))
    if n_shards is None:
        n_shards = max(LEAST_SHARDS, math.ceil(share * sum(sizes) / WORDS_PER_SHARD))

    plan, slots = [], []
    for k, (name, size, target) in enumerate(zip(names, sizes, targets, strict=True)):
        quota = Quota(size, block, round(target)) if size else None
        n = quota.n_blocks if quota else 0
        multiplier, shift = permutation(n, seed + k) if n else (1, 0)
        # where the short last block stands in the unfinished pass
        done = quota.words // quota.size if quota else 0
        place = ((n - 1 - shift - done) * pow(multiplier, -1, n)) % n if n > 1 else 0
        count, last = quota.slots(place) if quota and quota.words else (0, -1)
        plan.append((k, name, size, targets[k], n, multiplier, shift, count - 1, last))
        slots.append(count)

    known = spark.createDataFrame(pd.DataFrame(plan, columns=PLAN_SCHEMA.names), PLAN_SCHEMA) if plan else spark.createDataFrame([], PLAN_SCHEMA)
    few = F.broadcast if len(plan) <= BROADCAST_SOURCES else lambda df: df
    drawn = draw_counts(spark, slots, n_shards, seed)
    filled = (
        drawn.repartition(max(1, min(n_shards, n_shards * len(plan))), "shard", "k")
        .join(few(known), "k")
        .select("source", "shard", "n_blocks", "multiplier", "shift", "source_size", "final", "trim", F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)).alias("slot"))
        .withColumn("block", permuted(F.col("slot"), F.col("n_blocks"), F.col("multiplier"), F.col("shift") + F.floor(F.col("slot") / F.col("n_blocks"))))
        .withColumn("full", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block))
        .select("shard", "slot", "source", "block", F.when((F.col("slot") == F.col("final")) & (F.col("trim") >= 0), F.col("trim")).otherwise(F.col("full")).alias("words"))
    )

    buckets = max(1, -(-sum(rows) // ROWS_PER_BUCKET))
    placed = each_copy(streams(sized, buckets))
    first, end = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = (
        placed.filter(F.col("size") > 0)
        .select("source", "bucket", "rank", "copy", "offset", "size", F.explode(F.sequence(first, end)).alias("block"))
        .select("source", "bucket", "rank", "copy", "block", F.greatest(F.col("offset") - F.col("block") * block, F.lit(0)).alias("lo"), F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.lit(block)).alias("hi"))
    )
    # how often each block is taken, by the length taken of it: one row for each block and length
    uses = filled.groupBy(F.col("source").alias("u"), F.col("block").alias("b"), "words").agg(F.count("*").alias("times"))
    taken = (
        pieces.join(uses, F.col("source").eqNullSafe(F.col("u")) & (F.col("block") == F.col("b")))
        .groupBy("source", "bucket", "rank", "copy")
        .agg(F.sum(F.col("times") * F.greatest(F.least(F.col("hi"), F.col("words")) - F.col("lo"), F.lit(0))).alias("taken"))
        .select(F.col("source").alias("k"), F.col("bucket").alias("kb"), F.col("rank").alias("kr"), F.col("copy").alias("kc"), "taken")
    )
    report = (
        placed.join(taken, F.col("source").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("kb")) & (F.col("rank") == F.col("kr")) & (F.col("copy") == F.col("kc")), "left")
        .join(few(known.select(F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return report, filled
