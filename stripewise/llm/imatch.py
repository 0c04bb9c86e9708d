"""I-Match fingerprints: hashes of a document's sorted mid-frequency terms under randomised lexicon subsets.

The lexicon keeps terms whose document frequency lies in a band. Frequencies count distinct texts, so that copies neither
push their own words out of the band nor into it. Since a term of the band is in at least `lo` of all distinct texts, the
lexicon has at most (mean distinct terms of a text) / lo terms however many documents there are. Its
size is checked: up to `broadcast_terms` it is broadcast, beyond that it is joined by a shuffle.

Several randomised lexicons are drawn from the band, the same for all documents: `PER_SHARE` for each of `SHARES`, each of which
keeps a pseudorandom part of the band's terms of that size, from three quarters down. For each, the terms of the document that
it keeps, distinct and sorted, are hashed together; the fingerprint is the list of these hashes. Lexicons that keep most of the band
differ as soon as a few terms do, sparse ones stand edits of a quarter of the text, so the likeness is graded: the part of
equal hashes among the lexicons that keep a term of either text.

All on built-in functions. Defined results: a null text counts as the empty text; texts without lexicon terms get "~" and
a hash of all their own words, so they are alike by 1 if these are the same, and not at all to others; texts without words get
"-"; repeated rows are rows of their own; rows without an id come first; ties between equal ids are broken by the text; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stripewise.llm.common import checkpointed, stored

#: The band of document frequency, as shares of all documents: idf between log(1/HI) and log(1/LO).
LO, HI = 0.02, 0.03
#: What part of the band a lexicon keeps, as 64ths, and how many lexicons there are of each.
SHARES = (48, 32, 16, 8, 4)
PER_SHARE = 6
LEXICONS = len(SHARES) * PER_SHARE
#: Hex digits of a lexicon's hash.
DIGITS = 6
ROWS_PER_RANGE = 1024


def words_of(text: Column) -> Column:
    """Distinct words, lower-cased, in order of their first place; the empty string may be among them."""
    return F.array_distinct(F.split(F.lower(text), r"[ \t\n\x0b\f\r]+"))


def kept_by(term: Column) -> Column:
    """A bit for each lexicon that keeps the term."""
    bits = [F.when(F.pmod(F.xxhash64(term, F.lit(k)), F.lit(64)) < SHARES[k // PER_SHARE], F.lit(1 << k)).otherwise(F.lit(0)) for k in range(LEXICONS)]
    return sum(bits[1:], bits[0]).cast("int")


def lexicon(texts: DataFrame, documents: int, lo: float = LO, hi: float = HI) -> DataFrame:
    """Terms (column term, 64-bit hashes of words) whose document frequency lies within the band. texts: one `text` for each document."""
    words = texts.select(F.explode(words_of(F.col("text"))).alias("word")).filter("word <> ''")
    df = words.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("df"))
    # a term of one document alone says nothing, however small the corpus
    return df.filter((F.col("df") >= max(2.0, lo * documents)) & (F.col("df") <= max(2.0, hi * documents))).select("term")


def with_fingerprint(df: DataFrame, held: str, name: str, otherwise: str) -> DataFrame:
    """df and a column `name`: the hashes of the distinct terms in `held` (term, kept) by lexicon, "-" where none is kept.

    If there are none in any lexicon, what the column `otherwise` says.
    """
    terms = F.sort_array(held)
    df = df.withColumn("__terms", F.when(F.size(held) > 0, terms))

    def hashed(k: int) -> Column:
        own = F.filter("__terms", lambda t: t["kept"].bitwiseAND(F.lit(1 << k)) != 0)
        return F.when(F.size(own) > 0, F.substring(F.lpad(F.hex(F.xxhash64(F.transform(own, lambda t: t["term"]))), 16, "0"), 1, DIGITS)).otherwise(F.lit("-" * DIGITS))

    told = F.lower(F.concat(*(hashed(k) for k in range(LEXICONS))))
    return df.withColumn(name, F.when(F.col("__terms").isNull(), F.col(otherwise)).otherwise(told)).drop("__terms")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    parts = [(F.substring(a, 1 + DIGITS * k, DIGITS), F.substring(b, 1 + DIGITS * k, DIGITS)) for k in range(LEXICONS)]
    nothing = F.lit("-" * DIGITS)
    some = sum((F.when((x == nothing) & (y == nothing), 0).otherwise(1) for x, y in parts), F.lit(0))
    same = sum((F.when((x == y) & (x != nothing), 1).otherwise(0) for x, y in parts), F.lit(0))
    whole = (F.length(a) == LEXICONS * DIGITS) & (F.length(b) == LEXICONS * DIGITS)
    return F.when(a == b, F.lit(1.0)).when(whole, same / F.greatest(some, F.lit(1))).otherwise(F.lit(0.0))


def ranged(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = ROWS_PER_RANGE, most: int = 50_000) -> DataFrame:
    """part, rank, id, text and next_text, the text of the row that follows by id (after the last: the first).

    Rows are dealt to ranges of the id and, among equal ids or rows without one, of a hash of the text, so that no task
    sorts all of them; the first row of each range closes the one before. The bounds come from a range partitioning of ids
    and hashes alone, `most` at most.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    light = rows.select("id", "tie")
    parts = max(1, min(-(-light.count() // rows_per_range), most))
    cuts = []
    if parts > 1:
        dealt = light.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("id").isNotNull(), "id", "tie")).alias("x"))
        cuts = sorted((r.x.id is not None, r.x.id or 0, r.x.tie) for r in dealt.collect())[1:]  # `most` at most
    rows = rows.withColumn("part", _rank_in(cuts) if cuts else F.lit(0))
    within = W.partitionBy("part").orderBy(*order, "text")
    ranked = rows.withColumns({"next_text": F.lead("text").over(within), "rank": F.row_number().over(within)})
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "tie", "text")).alias("first")).select(F.col("part").alias("p"), F.col("first.text").alias("opening"))
    closing = firsts.join(_before(firsts.select("p")), "p").select(F.col("before").alias("part"), "opening")
    return ranked.join(closing, "part").select("part", "rank", "id", "text", F.coalesce("next_text", "opening").alias("next_text"))


def _before(ranges: DataFrame) -> DataFrame:
    """p and before: the range in front of each, the last one for the first. One row for each range, `most` at most."""
    return ranges.select("p", F.coalesce(F.lag("p").over(W.orderBy("p")), F.max("p").over(W.partitionBy())).alias("before"))


def match(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lo: float = LO, hi: float = HI, broadcast_terms: int = 2_000_000) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many of the next row's.
    """
    # copies of a text count once, both for the terms and for the documents of the band
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    distinct = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct().count()
    terms, _ = stored(lexicon(texts.distinct(), distinct, lo, hi).withColumn("kept", kept_by(F.col("term"))), "lexicon")
    small = terms.count() <= broadcast_terms
    # the empty word stands for the row itself, so that rows without lexicon terms pass the join
    terms = terms.unionByName(terms.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(0).alias("kept")))

    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = ranged(docs, id_col, text_col).select("part", "rank", "id", "text", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)).alias("edited"))
    rows = rows.select("part", "rank", "id", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), words_of(F.col("text")).alias("words"), words_of(F.col("edited")).alias("edited_words"))
    rows = rows.withColumns({"own_hash": own_hash(F.col("words")), "other_hash": own_hash(F.col("edited_words"))})
    both = F.array(F.struct(F.lit(False).alias("of_edited"), F.array_union("words", F.array(F.lit(""))).alias("words")), F.struct(F.lit(True).alias("of_edited"), F.col("edited_words").alias("words")))
    passed = ["part", "rank", "id", "n_chars", "sha", "own_hash", "other_hash"]
    said = rows.select(*passed, F.explode(both).alias("x"))
    # the grouping below keeps to the partitions of `part`, so terms are dealt out only if the lexicon can't be broadcast
    dealt = said.select(*passed, "x.of_edited", F.explode("x.words").alias("word")).select(*passed, "of_edited", F.xxhash64("word").alias("term"))
    told = F.when(F.col("kept") != 0, F.struct("term", "kept"))
    held = (
        dealt.join(F.broadcast(terms) if small else terms, "term")
        .groupBy("part", "rank")
        .agg(*(F.first(c).alias(c) for c in passed[2:]), F.collect_list(F.when(~F.col("of_edited"), told)).alias("own"), F.collect_list(F.when(F.col("of_edited"), told)).alias("other"))
    )
    held = held.withColumns({c: F.when(F.col(c) == 0, F.lit("-")).otherwise(F.concat(F.lit("~"), F.lower(F.lpad(F.hex(c), 16, "0")))) for c in ("own_hash", "other_hash")})
    both = with_fingerprint(with_fingerprint(held, "own", "fingerprint", "own_hash"), "other", "edited_fingerprint", "other_hash")
    prints = checkpointed(both.select("part", "rank", "id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint"))

    firsts = prints.filter("rank = 1").select(F.col("part").alias("p"), F.col("fingerprint").alias("opening"))
    closing = firsts.join(_before(firsts.select("p")), "p").select(F.col("before").alias("part"), "opening")
    following = prints.withColumn("following", F.lead("fingerprint").over(W.partitionBy("part").orderBy("rank"))).join(closing, "part").withColumn("following", F.coalesce("following", "opening"))
    return following.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


def own_hash(words: Column) -> Column:
    """A hash of the words, 0 if there are none."""
    return F.when(F.array_join(words, "") == "", F.lit(0).cast("long")).otherwise(F.xxhash64(words))


def _rank_in(bounds: list[tuple[bool, int, int]]) -> Column:
    """How many of the sorted bounds (there is an id, id, tie) are at or below the row's, by halving."""
    columns = [f"cast(split('{','.join(str(int(b[k])) for b in bounds)}', ',') AS array<bigint>)" for k in range(3)]
    middle = "cast((s.lo + s.hi) div 2 AS int)"
    bound = ", ".join(f"{c}[{middle}]" for c in columns)
    row = "cast(id IS NOT NULL AS bigint), coalesce(id, 0L), tie"
    return F.expr(
        f"aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, _) -> "
        f"CASE WHEN s.lo >= s.hi THEN s WHEN struct({bound}) <= struct({row}) THEN named_struct('lo', {middle} + 1, 'hi', s.hi) "
        f"ELSE named_struct('lo', s.lo, 'hi', {middle}) END, s -> s.lo)"
    )
