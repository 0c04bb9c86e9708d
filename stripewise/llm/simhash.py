"""SimHash near-duplicates, with candidates found and pruned by the pigeonring principle.

Fingerprints are cut into m segments on a ring. If two differ in at most t bits, then some segment starts a chain in which,
for every length l up to m, the first l segments differ in at most floor(l * t / m) bits together. The lengths with a
budget of zero make the join key (with t = 2 and m = 8, three consecutive equal segments: 24 bits); the longer ones are
checked on each candidate before the full distance, the last of the budgets, is. More and shorter segments make longer keys
(m = 64: 31 bits), so m follows the number of fingerprints, and a key is shared by few of them at any size.

Only distinct fingerprints are compared, so exact copies cost one row each. A key that more than `bucket` fingerprints
share isn't paired off: its members go the exact way of common neighbours instead. Two fingerprints are within t bits of
each other just if some value is within t / 2 bits of both (for odd t, with one bit left out of both), so each member is dealt to
its values of that kind, whose number follows from t alone, and each value links its members to the least of them.

`near_copies` is for looser likeness, as a share of five-word shingles, which no small budget of 64 bits takes. It is exact too: sets
that are alike by 4 / 5 share one at least of the first fifth of their shingles, in an order that is the same for all, so those are
the keys, and pairs of a key are compared by the shingles themselves. Members of a key that links join already aren't compared
again, which keeps large groups of near copies linear; texts of a crowded key that stay apart are compared by 512 bits
and more that bound from below in how many shingles two texts differ. Shingles and sets of them are told apart by 64-bit hashes.

Defined results: a null or empty text has no words and fingerprint zero, which is linked like any other; fewer words than a
shingle takes count as one shingle; repeated rows are rows of their own; a null id is kept and never names a component
unless it has no other member; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stripewise.llm.common import checkpointed, discard, fresh_names, scratch_path, shuffles_dropped, stored
from stripewise.llm.components import connected_components, few_components

BITS = 64
_SLICE = 1 << 15
#: `near_copies`: likeness as a fraction, and 64-bit parts of the bits that bound it.
ALIKE, PARTS = (4, 5), 8
#: Texts of the sample that orders shingles, and shingles of it that are kept; texts that a broadcast picks out; rows of a crowded key in a task.
SAMPLE, COMMON, BROADCAST_TEXTS, PART = 20_000, 200_000, 100_000, 256
#: By how much the rounds of `set_components` grow, the keys of a node by which a pair finds the one it is compared in, and links that one task joins.
GROWTH, FEW, FEW_LINKS = 16, 32, 100_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(digest, shingles), dtype="<u8", count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), _SLICE):
        some = hashes[lo : lo + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return kept.mapInArrow(compute, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def segments_for(n: int, most: int = 2, share: int = 8) -> int:
    """The fewest segments whose keys are so long that n random fingerprints share one with `share` others at most."""
    for segments in (8, 16, 32, 64):
        if segments > most:
            free = sum(length * most // segments == 0 for length in range(1, segments + 1))
            if share << (free * (BITS // segments)) >= n:
                return segments
    return 64


def links(fps: DataFrame, most: int = 2, segments: int | None = None, bucket: int = 64) -> DataFrame:
    """Pairs a, b of the distinct fingerprints in `fps` (column fp) that join all that are within `most` bits.

    Every pair within `most` bits is in one component of the result; pairs of crowded keys may be given by a path.
    """
    segments = segments or segments_for(fps.count(), most)
    if BITS % segments or not 0 < most < segments:
        raise ValueError("segments must divide 64 and be more than the bits allowed")
    width = BITS // segments
    budgets = [length * most // segments for length in range(1, segments + 1)]
    free = budgets.count(0)
    starts = [F.struct(F.lit(k).alias("start"), rotated(F.col("fp"), k * width).alias("ring")) for k in range(segments)]
    keyed = (
        fps.select("fp", F.explode(F.array(*starts)).alias("x"))
        .select("fp", "x.start", "x.ring")
        .withColumn("key", F.shiftrightunsigned("ring", BITS - free * width))
    )
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared, _ = stored(keyed.join(sizes, ["start", "key"]).select("start", "key", "n", "fp", "ring"), "simhash-keys")

    few = shared.filter(F.col("n") <= bucket)
    a, b = few.select("start", "key", F.col("fp").alias("a"), F.col("ring").alias("ra")), few.select("start", "key", F.col("fp").alias("b"), F.col("ring").alias("rb"))
    differ = F.col("ra").bitwiseXOR(F.col("rb"))
    rises = [length for length in range(free + 1, segments) if budgets[length - 1] < budgets[length]]  # the last length of each budget
    chain = [F.bit_count(F.shiftrightunsigned(differ, BITS - length * width)) <= budgets[length - 1] for length in rises]
    near = F.bit_count(differ) <= most
    for check in reversed(chain):
        near = check & near
    paired = a.join(b, ["start", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")

    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return paired.unionByName(neighbour_links(crowded, most)).distinct()


def neighbour_links(fps: DataFrame, most: int = 2) -> DataFrame:
    """The same by common neighbours, in rows that grow with the fingerprints, not with the pairs."""
    bits = F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(BITS)))
    # for odd `most` one bit is left out of both, and half of the others stand on either side
    if most % 2:
        without = F.posexplode(F.transform(bits, lambda bit: F.col("fp").bitwiseAND(F.bitwise_not(bit))))
        values = fps.select("fp", without.alias("bit", "x"))
    else:
        values = fps.select("fp", F.lit(-1).alias("bit"), F.col("fp").alias("x"))
    for _ in range(most // 2):
        turned = F.array_union(F.array("x"), F.transform(bits, lambda bit: F.col("x").bitwiseXOR(bit)))
        values = values.select("fp", "bit", F.explode(turned).alias("x"))
        values = values.filter("bit < 0 OR (shiftrightunsigned(x, bit) & 1) = 0").distinct() if most > 2 or most % 2 else values
    met = values.groupBy("bit", "x").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)  # no more than values of a fingerprint
    return met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2, segments: int | None = None, bucket: int = 64) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the least id reachable over links) of every row."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(links(nodes.select("fp"), most, segments, bucket))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingles' XXH64 in ascending order; fewer words than a shingle takes are one, a text without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(digest, shingles), dtype=np.uint64, count=n))


def prefix_of(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, alike: tuple[int, int] = ALIKE) -> np.ndarray:
    """The first of a set's hashes, so many that sets which are alike enough share one of them at least.

    All sets are ordered alike: hashes that `common` (ascending) lacks come first, by value, then the others by `rank`.
    """
    p, q = alike
    length = len(hashes) - -(-p * len(hashes) // q) + 1
    if not len(common):
        return hashes[:length]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    met = common[at] == hashes
    first = hashes[~met][:length]
    return first if len(first) == length else np.concatenate([first, hashes[met][np.argsort(rank[at[met]], kind="stable")]])[:length]


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of m residues, a bit that says if an odd number of hashes has it, in 64-bit parts: sets differ in as many hashes as bits, or more.

    m is a power of two, 512 or at least twice the hashes; parts XORed together, half on half, are those of fewer residues.
    """
    m = max(64 * PARTS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def bits_apart(a: str, b: str) -> Column:
    """In how many bits two columns of `parities` differ, the longer one folded once if need be; 0, which says nothing, where once isn't enough."""
    n = F.least(F.size(a), F.size(b))

    def folded(c: str) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == n, F.col(c)).otherwise(halves)

    each = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * n, F.aggregate(each, F.lit(0), lambda total, x: total + x)).otherwise(0)


def common_shingles(kept: DataFrame, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, as far as a bounded sample shows, ascending, and their rank from the rarest.

    They order the shingles only: whatever they are, no link is lost.
    """
    share = min(1.0, SAMPLE / max(1, kept.count()))
    near = kept.filter((F.octet_length("text") <= 1 << 20) & ((F.col("h").cast("double") + 2.0**63) / 2.0**64 < share)).dropDuplicates(["h"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py(), shingle).view(np.int64))], names=["s"])

    counted = near.select("text").mapInArrow(spread, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= 4)
    found = counted.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    values = found.column("s").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.arange(len(values), 0, -1)[order]


def set_components(nodes: DataFrame, kept: DataFrame, shingle: int = 5, alike: tuple[int, int] = ALIKE, bucket: int = 16) -> DataFrame:
    """node and root (the least node of its component) of the nodes that are alike enough to another one.

    nodes: node, h (of one of its texts in `kept`), size, bits (its parities), p0 to p7 (those of 512) and keys (its prefix). Sets that
    are alike share a key.
    In a first round each member of a key is compared with the least of them, in a second one with the `bucket` least, in each later one
    with GROWTH times as many, until all are: but only with those that links so far don't join already, and once however many
    keys they share. Nodes are hashes, so the least are a random sample: what many others are alike to is joined in an early round,
    and few pairs are left for the later ones. What is compared has sizes and parities that leave it open whether it is alike; then the
    shingles themselves are counted. The number of plans follows the logarithm of the largest key.
    Joins are merges by hint: what Spark takes for small by its compressed size may not fit into the driver as a broadcast.
    """
    spark, (p, q) = nodes.sparkSession, alike
    names = [f"p{k}" for k in range(PARTS)]
    of_key = W.partitionBy("key").orderBy("node")
    ranked = nodes.select("node", F.explode("keys").alias("key")).withColumns(
        {"r": F.row_number().over(of_key), "n": F.count("*").over(of_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "least": F.first("node").over(of_key)}
    )
    shared, shared_path = stored(ranked.filter("n > 1"), "simhash-keys")
    traits = nodes.select("node", "h", "size", "bits", *names, F.slice(F.array_sort("keys"), 1, FEW).alias("few"))
    paths, linked, n_links = [shared_path], scratch_path(spark, "simhash-links"), 0
    links = spark.read.schema("a long, b long").parquet

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{end}_{c}") for c in df.columns))

    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in names))
    both = F.col("a_size") + F.col("b_size")
    open_yet = (q * F.least("a_size", "b_size") >= p * F.greatest("a_size", "b_size")) & ((p + q) * differ <= (q - p) * both) & ((p + q) * bits_apart("a_bits", "b_bits") <= (q - p) * both)

    # what meets in many keys is compared in the least of them, in the round that its rank there is due
    once = F.coalesce(F.array_min(F.array_intersect("a_few", "b_few")), "a_key") == F.col("a_key")

    def linked_by(pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """Components with the links among `pairs`: a_ and b_ of node, h and size, with repeats. roots: those without them."""
        nonlocal n_links
        ends = [f"{end}_{c}" for end in "ab" for c in ("node", "h", "size")]
        pairs, path = stored(pairs.select(ends).distinct(), "simhash-pairs")
        paths.append(path)
        most = 2 * pairs.count()
        if roots is not None and not most:
            return roots
        wanted = pairs.select(F.explode(F.array("a_h", "b_h")).alias("h")).distinct()
        wanted = F.broadcast(wanted) if most <= BROADCAST_TEXTS else wanted

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, text in zip(batch.column(0), batch.column(1), strict=True):
                    found = pa.array([shingle_hashes(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([h.as_py()], pa.int64()), found], names=["h", "shingles"])

        texts = kept.select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"])
        counted, path = stored(texts.mapInArrow(sets, "h long, shingles array<long>"), "simhash-sets")
        paths.append(path)
        joined = pairs.join(side(counted, "a").hint("merge"), "a_h").join(side(counted, "b").hint("merge"), "b_h")
        same = F.size(F.array_intersect("a_shingles", "b_shingles"))
        more, path = stored(joined.filter((p + q) * same >= p * both).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "simhash-found")
        paths.append(path)
        n_more = more.count()
        if roots is not None and not n_more:
            return roots
        n_links += n_more
        with shuffles_dropped(spark):
            more.write.mode("append").parquet(linked)
        return few_components(links(linked)) if n_links <= FEW_LINKS else connected_components(links(linked))

    firsts = shared.filter("r > 1").select(F.col("least").alias("a_node"), F.col("node").alias("b_node")).distinct()
    roots = linked_by(firsts.join(side(traits, "a").hint("merge"), "a_node").join(side(traits, "b").hint("merge"), "b_node").filter(open_yet))

    largest = shared.agg(F.max("n")).first()[0] or 0
    lo, reach = 1, bucket
    while largest > lo + 1:
        # members of keys in which not all are joined yet; the first ones, of the rounds before, have been compared with all
        hi = 1 + reach
        left = shared.filter(F.col("r") > lo).join(roots.hint("merge"), "node", "left").select("node", "key", "r", "n", F.coalesce("root", "node").alias("root"))
        apart = left.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
        left, path = stored(left.join(apart.hint("merge"), "key").join(traits.hint("merge"), "node"), "simhash-left")
        paths.append(path)
        # the others of a key are dealt out by their rank, so that no task has all of a crowded one
        first = left.filter(F.col("r") <= hi).withColumn("part", F.explode(F.sequence(F.floor(F.col("r") / PART), F.floor(F.col("n") / PART))))
        others = left.withColumn("part", F.floor(F.col("r") / PART))
        pairs = side(first, "a").join(side(others, "b").hint("merge"), (F.col("a_key") == F.col("b_key")) & (F.col("a_part") == F.col("b_part")) & (F.col("a_r") < F.col("b_r")) & (F.col("a_root") != F.col("b_root")) & open_yet & once)
        roots = linked_by(pairs, roots)
        lo, reach = hi, GROWTH * reach
    discard(spark, linked, *paths)
    return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: tuple[int, int] = ALIKE, bucket: int = 16) -> DataFrame:
    """id and component_id (the least id reachable over links) of every row; linked are texts of whose shingles p / q or more are the same.

    Likeness is that of the sets of shingles (what both have, of what either has), alike = (p, q).
    """
    spark, names = docs.sparkSession, [f"p{k}" for k in range(PARTS)]
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(common_shingles(kept, shingle))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, size, bits, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), shingle)
                node.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                size.append(len(hashes))
                bits.append(parities(hashes))
                keys.append(prefix_of(hashes, *common.value, alike))
            few = np.array([np.bitwise_xor.reduce(x.reshape(-1, PARTS)) for x in bits], dtype=np.uint64).reshape(-1, PARTS).view(np.int64)
            lists = [pa.array([x.view(np.int64) for x in some], pa.list_(pa.int64())) for some in (bits, keys)]
            columns = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64()), *(pa.array(few[:, k]) for k in range(PARTS)), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "h", "node", "size", *names, "bits", "keys"])

    id_type = kept.schema["id"].dataType.simpleString()
    sets, sets_path = stored(kept.select("id", "h", "text").mapInArrow(compute, f"id {id_type}, h long, node long, size long, " + ", ".join(f"{c} long" for c in names) + ", bits array<long>, keys array<long>"), "simhash-texts")
    alone = sets.groupBy("node").agg(F.min("id").alias("least"), F.min("h").alias("h"), *(F.first(c).alias(c) for c in ("size", *names, "bits", "keys")))
    nodes, nodes_path = stored(alone, "simhash-nodes")
    found = set_components(nodes, kept.select("h", "text"), shingle, alike, bucket)
    rooted = nodes.join(found.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("node", "component_id")
    out, _ = stored(sets.select("id", "node").join(named.hint("merge"), "node").select(F.col("id").alias(id_col), "component_id"), "simhash-copies")
    common.destroy()
    discard(spark, sets_path, nodes_path)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: DataFrame | None = None, **options) -> DataFrame:
    """The rows of `docs` that stay if of each group of near copies only the smallest id does, with all their columns.

    grouped: id and component_id of every row; if it isn't given, that of `near_duplicates`. Of rows that share an id one stays. Rows
    without an id stay: no decision can name them.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, **options) if grouped is None else grouped
    kept_name, rows_name = fresh_names(docs, "kept", "rows").values()
    kept = checkpointed(found.filter(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(kept_name)).agg(F.count("*").alias(rows_name)))
    once = docs.join(kept.filter(F.col(rows_name) == 1).select(kept_name), F.col(id_col) == F.col(kept_name), "left_semi")
    nameless = docs.filter(F.col(id_col).isNull())
    parts = [once, nameless]
    if kept.filter(F.col(rows_name) > 1).limit(1).count():
        repeated = docs.join(kept.filter(F.col(rows_name) > 1).select(kept_name), F.col(id_col) == F.col(kept_name), "left_semi")
        # the same row wherever it is computed: the least by all that tells rows apart
        others = [c for c in docs.columns if c != id_col]
        row_name = fresh_names(docs, "row")["row"]
        parts.append(repeated.groupBy(id_col).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias(row_name)).select(*(F.col(f"{row_name}.{c}").alias(c) if c != id_col else F.col(id_col) for c in docs.columns)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
