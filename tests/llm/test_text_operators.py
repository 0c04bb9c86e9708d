"""Token counts, mixing, LM scores, I-Match, languages and quality against brute force, and on odd rows."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stripewise.llm import imatch, langid_crf, lm_scoring, mixing, quality, token_counts
from stripewise.llm.common import bounded_sample, scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text):
    return (text or "").encode().lower().split()


# token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(spark, odd, docs, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for df in (odd.filter("doc_id IS NULL OR doc_id <> 7"), docs):
        got = token_counts.token_counts(df, scratch_path(spark, "cache"), public_tokenizers.path(name)).collect()
        assert len(got) == df.count()
        said = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == said
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_only_misses_are_encoded_and_versions_are_kept_apart(spark, odd, docs, tmp_path):
    path = str(tmp_path / "cache")
    few = odd.filter("doc_id < 5")
    token_counts.token_counts(few, path, BPE).collect()
    assert token_counts.read_cache(spark, path).count() == 3  # empty, one, the fox
    # a stored count is used as it is: the text isn't encoded again
    marked = spark.read.parquet(path).withColumn("n_tokens", F.lit(-7).cast("long"))
    marked.write.parquet(str(tmp_path / "marked"))
    got = token_counts.token_counts(odd.filter("doc_id < 6 or doc_id = 8"), str(tmp_path / "marked"), BPE).collect()
    assert [r.n_tokens for r in got if r.doc_id != 8] == [-7] * 6 and next(r.n_tokens for r in got if r.doc_id == 8) > 0
    other = token_counts.token_counts(few, str(tmp_path / "marked"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert all(r.n_tokens >= 0 for r in other)


def test_both_encoders_count_alike():
    """Seeded texts of special strings, white space, long runs and every range of characters that the faster encoder takes."""
    with open(BPE, encoding="utf-8") as file:
        spec = file.read()
    library, count = Tokenizer.from_str(spec), token_counts.counter(spec)
    rng = np.random.default_rng(12)
    specials = [x["content"] for x in json.loads(spec).get("added_tokens", [])] or ["<|endoftext|>"]
    ranges = [(0x20, 0x7E), (0x20, 0x7E), (0x61, 0x7A), (0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
    loose = ["\t", "\n", "\r", "\r\n", " ", "  ", "   ", "'s", "'LL", "’s", "<|", "|>", "1234567890", "a" * 300, " " * 70, "\n\n\n", *specials, *(x[:-1] for x in specials)]
    texts = []
    for _ in range(3000):
        parts = []
        for _ in range(rng.integers(1, 25)):
            if rng.random() < 0.4:
                parts.append(loose[rng.integers(len(loose))])
            else:
                lo, hi = ranges[rng.integers(len(ranges))]
                parts.append("".join(map(chr, rng.integers(lo, hi + 1, rng.integers(1, 12)))))
        texts.append("".join(parts))
    texts += [chr(k) * n for k in range(0x20, 0x250) for n in (1, 5)] + ["".join(map(chr, rng.integers(0x20, 0x7F, 50_000)))]
    texts += ["日本語 и ещё", "e\u0301a\u0300", "\u2028x\u00a0y", "🙂👍🏽"]
    assert count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_warm_cache_moves_no_text(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    token_counts.token_counts(docs, path, BPE).collect()
    files = sorted(p.name for p in (tmp_path / "cache").iterdir())
    again = token_counts.token_counts(docs, path, BPE)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == files and again.count() == docs.count()


def test_no_rows(spark, none):
    assert token_counts.token_counts(none, scratch_path(spark, "cache"), BPE).count() == 0
    assert mixing.mix(none)[0].count() == 0 and mixing.mix(none)[1].count() == 0
    assert lm_scoring.score_texts(none).count() == 0
    assert imatch.match(none).count() == 0
    assert langid_crf.languages(none).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# mixing


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mix(spark, request, table):
    df = request.getfixturevalue(table)
    report, slots = mixing.mix(df, block=16, n_shards=8)
    rows = report.collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((r.doc_id, len(words(r.text))) for r in df.collect())
    source_of = {(r.doc_id, len(words(r.text))): r.source for r in df.collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = source_of[r.doc_id, r["size"]]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    said = mixing.water_fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()))
    for s, t in zip(names, said, strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.51
    assert slots.agg(F.sum("words")).first()[0] == sum(taken.values())
    per_shard = [r["count"] for r in slots.groupBy("shard").count().collect()]
    assert max(per_shard) - min(per_shard) <= 1
    again = mixing.mix(df.repartition(3), block=16, n_shards=8)[0]
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, rows))


def test_taken_words_follow_from_the_slots(spark, odd, docs, monkeypatch):
    """Every row's words by counting each word of the stream that the slots take."""
    monkeypatch.setattr(mixing, "FANOUT", 3)
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 2)
    few = docs.filter("doc_id < 40").select("doc_id", "text", "source")
    df = few.unionByName(few.filter("doc_id = 3")).unionByName(few.filter("doc_id = 3")).unionByName(few.filter("doc_id < 5"))
    report, slots = mixing.mix(df, block=16, n_shards=20)
    sized = df.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    placed = mixing.each_copy(mixing.streams(sized, max(1, -(-df.count() // mixing.ROWS_PER_BUCKET)))).collect()
    uses = collections.Counter()
    drawn = slots.collect()
    for r in drawn:
        uses.update((r.source, r.block * 16 + k) for k in range(r.words))
    said = sorted((r.doc_id, r["size"], sum(uses[r.source, r.offset + k] for k in range(r["size"]))) for r in placed)
    assert said == sorted((r.doc_id, r["size"], r.taken) for r in report.collect())
    # each source's slots are numbered without gaps, and shards are as large as each other
    for source in {r.source for r in drawn}:
        mine = sorted(r.slot for r in drawn if r.source == source)
        assert mine == list(range(len(mine)))
    sizes = collections.Counter(r.shard for r in drawn)
    assert len(sizes) == 20 and max(sizes.values()) - min(sizes.values()) <= 1


def test_very_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    rows = mixing.mix(df, block=2, n_shards=100)[0].collect()
    assert len(rows) == 3000 and sum(r.taken for r in rows) == pytest.approx(1.5 * 4 * 3000, abs=1500)


def test_water_fill():
    assert mixing.water_fill([100, 100], [3, 1], 300) == [200.0, 100.0]
    assert mixing.water_fill([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 295 / 3, 295 * 2 / 3])
    assert mixing.water_fill([0, 5], [3, 1], 7.5) == [0.0, 7.5]


def test_permutation_visits_every_block_once(spark):
    for n in (1, 2, 7, 100):
        multiplier, shift = mixing.permutation(n, 5)
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(multiplier), F.lit(shift)).alias("b")).collect()
        assert sorted(r.b for r in got) == list(range(n))


# language model


def brute_scores(rows, weights_of=None):
    counts = collections.Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*words(t), None]
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        out.append((d, held, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 5)))
    return collections.Counter(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_base_scores(request, table):
    df = request.getfixturevalue(table)
    got = lm_scoring.score_texts(df).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == brute_scores([(r.doc_id, r.text) for r in df.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_interpolation_against_brute_force(docs, texts):
    """All of the model by dictionaries: counts, held-out expectation-maximisation and scores, but for the histogram's grid."""
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in texts}
    one, two, ctx = ({"main": collections.Counter(), "whole": collections.Counter()} for _ in range(3))
    for d, t in texts.items():
        tokens = [*words(t), None]
        for part in () if fold[d] == 2 else ("whole",) if fold[d] == 3 else ("main", "whole"):
            one[part].update(tokens)
            two[part].update(zip(["^", *tokens], tokens, strict=False))
            ctx[part].update(["^", *tokens[:-1]])
    v = len(one["whole"])

    def tokens_of(d):
        tokens = [*words(texts[d]), None]
        return zip(["^", *tokens], tokens, strict=False)

    def bucket(c):
        return min(int(math.log2(c)) + 1, 20) if c else 0

    def em(items):
        w = 0.5
        for _ in range(60):
            w = min(max(sum(w * own / (w * own + (1 - w) * low) for own, low in items) / len(items), 1e-9), 1 - 1e-6)
        return w

    n = sum(one["main"].values())
    dev = [x for d in texts if fold[d] == 3 for x in tokens_of(d)]
    w1 = em([(one["main"][b] / n, 1 / (v + 1)) for _, b in dev])
    low = lambda part, total, b: w1 * one[part][b] / total + (1 - w1) / (v + 1)
    groups = collections.defaultdict(list)
    for a, b in dev:
        c = ctx["main"][a]
        groups[bucket(c)].append((two["main"][a, b] / c if c else 0.0, low("main", n, b)))
    w2 = {k: em(items) for k, items in groups.items()}
    total = sum(one["whole"].values())
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(docs).collect()}
    for d in texts:
        said = 0.0
        for a, b in tokens_of(d):
            c = ctx["whole"][a]
            w = w2.get(bucket(c), 0.0)
            said += math.log10(w * (two["whole"][a, b] / c if c else 0) + (1 - w) * low("whole", total, b))
        assert got[d] == pytest.approx(said, rel=0.02)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm_scoring.score_texts(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b


def test_word_hashes():
    texts = [b"", b" a  B\tcc\n", b"a", b"x" * 3000, b"\x0b\x0c", "é b".encode()]
    hashes, counts = lm_scoring.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    tokens = [w for t in texts for w in t.lower().split()]
    seen = {}
    for h, w in zip(hashes.tolist(), tokens, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_block_by_block():
    rng = np.random.default_rng(5)
    for text in (b"a bc def" * 40, b"x" * 5000, b" " * 100, b"ab " * 33, bytes(rng.choice(np.frombuffer(b"ab \n", np.uint8), 3000))):
        whole = lm_scoring.word_hashes([text])[0].tolist()
        for block in (1, 7, 64, 4096):
            assert lm_scoring.long_word_hashes(text, block).tolist() == whole


def test_scores_are_the_same_by_relays_and_in_small_groups(docs, odd):
    for df in (docs, odd):
        said = collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score_texts(df).collect())
        for options in ({"group_bytes": 5000}, {"group_bytes": 20_000, "tokens_per_owner": 50, "fan": 8}):
            got = lm_scoring.score_texts(df, **options).collect()
            assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == said


def test_counts_beyond_32_bits():
    keys, big = np.array([3, 2**63 + 5], np.uint64), np.array([2**33, 7], np.uint64)
    columns = lm_scoring._messages(1, keys, big, big, np.array([True, False]), owners=1)
    table = lm_scoring._table({k: v * 2 for k, v in columns.items()})
    tally = lm_scoring.Tally(table)
    assert tally.whole.tolist() == [2**34, 14] and tally.keys.tolist() == keys.tolist() and tally.words.tolist() == [True, False]
    assert lm_scoring._unpack_counts(lm_scoring._pack_counts(tally.whole)).tolist() == [2**34, 14]
    assert lm_scoring._unpack(lm_scoring._pack(keys)).tolist() == keys.tolist()
    assert lm_scoring._unpack_counts(lm_scoring._pack_counts(np.zeros(3, np.uint64))).tolist() == [0, 0, 0]


def test_a_text_of_fifty_megabytes(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, F.repeat(F.lit("some words of a long text "), 2_000_000)).otherwise(F.lit("some words")).alias("text"))
    got = {r.doc_id: r for r in lm_scoring.score_texts(df).collect()}
    assert got[1].n_tokens == 12_000_001 and got[0].n_tokens == 3 and all(r.score < 0 for r in got.values())


# I-Match


def test_edited_texts_and_likeness(docs):
    rows = imatch.match(docs).collect()
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0])
    said = {}
    for k, (d, t) in enumerate(order):
        cut = len(t) // 4
        said[d] = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
    got = {r.doc_id: r for r in rows}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in said.items()} == {d: r.edited_sha256 for d, r in got.items()}
    by_text = collections.defaultdict(set)
    for d, t in order:
        by_text[t].add(got[d].fingerprint)
        assert got[d].n_chars == len(t)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert np.mean([r.near_edited for r in rows]) > 0.15 > 0.02 > np.mean([r.near_next for r in rows if by_text])


def lower_words(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]


def test_fingerprints_against_brute_force(docs):
    def xx(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed)

    def term_of(word):
        return xx(word.encode())

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    distinct = set(texts.values())
    df = collections.Counter(w for t in distinct for w in set(lower_words(t)))
    band = {w for w, c in df.items() if max(2, imatch.LO * len(distinct)) <= c <= max(2, imatch.HI * len(distinct))}
    keeps = {}
    for w in band:
        term = term_of(w).to_bytes(8, "little")
        keeps[w] = [(xx(k.to_bytes(4, "little"), xx(term)) + 2**63) % 2**64 - 2**63 for k in range(imatch.LEXICONS)]
        keeps[w] = [x % 64 < imatch.SHARES[k // imatch.PER_SHARE] for k, x in enumerate(keeps[w])]

    def print_of(text):
        held = sorted({w for w in lower_words(text)} & band, key=lambda w: (term_of(w) + 2**63) % 2**64)
        if not held:
            return None
        out = ""
        for k in range(imatch.LEXICONS):
            seed, some = 42, [w for w in held if keeps[w][k]]
            for w in some:
                seed = xx(term_of(w).to_bytes(8, "little"), seed)
            out += f"{seed:016x}"[: imatch.DIGITS] if some else "-" * imatch.DIGITS
        return out

    def alike(a, b):
        cut = [[x[k : k + imatch.DIGITS] for k in range(0, len(x), imatch.DIGITS)] for x in (a, b)]
        some = [(x, y) for x, y in zip(*cut, strict=True) if not x.startswith("-") or not y.startswith("-")]
        return sum(x == y for x, y in some) / len(some)

    order = sorted(texts)
    edited = {d: (t[: len(t) - len(t) // 4] + texts[order[(k + 1) % len(order)]][: len(t) // 4]) for k, d in enumerate(order) for t in (texts[d],)}
    for r in imatch.match(docs).collect():
        own, other = print_of(texts[r.doc_id]), print_of(edited[r.doc_id])
        following = print_of(texts[order[(order.index(r.doc_id) + 1) % len(order)]])
        assert r.fingerprint == own if own else r.fingerprint[0] in "~-" and len(r.fingerprint) < 18
        assert r.edited_fingerprint == other if other else r.edited_fingerprint[0] in "~-"
        assert r.near_edited == pytest.approx(alike(own, other)) if own and other else r.near_edited in (0.0, 1.0)
        assert r.near_next == pytest.approx(alike(own, following)) if own and following else r.near_next in (0.0, 1.0)


def test_lexicon_terms_of_a_fingerprint(spark, docs):
    n = docs.count()
    df = collections.Counter(w for t in {r.text for r in docs.collect()} for w in set(lower_words(t)))
    n = len({r.text for r in docs.collect()})
    band = sum(max(2, imatch.LO * n) <= c <= max(2, imatch.HI * n) for c in df.values())
    assert imatch.lexicon(docs.select("text").distinct(), n).count() == band


def test_matching_odd_rows(spark, odd):
    rows = imatch.match(odd, lo=0.1, hi=1.0).collect()
    assert len(rows) == 10
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[1] == prints[2] == prints[8] == {"-"} and prints[4] == prints[5]
    # one row: its next is itself
    one = imatch.match(odd.filter("doc_id = 3")).first()
    assert one.edited_sha256 == hashlib.sha256(b"one").hexdigest() and one.near_next == 1.0


def test_large_groups_of_copies_keep_their_fingerprints(spark):
    shared = "alpha beta gamma delta"
    hot, warm = f"{shared} " + " ".join(f"hot{k}" for k in range(30)), " ".join(f"warm{k}" for k in range(30))
    rest = [f"{shared if k < 5 else ''} " + " ".join(f"r{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate([hot] * 30 + [warm] * 30 + rest + [""])]
    got = {r.doc_id: r for r in imatch.match(spark.createDataFrame(rows, "doc_id long, text string"), hi=0.2).collect()}
    # distinct texts: 6 of 43 have the shared words, which are the lexicon; words of copies alone are not in it
    assert len(got[0].fingerprint) == imatch.LEXICONS * imatch.DIGITS and got[0].fingerprint == got[29].fingerprint
    assert got[30].fingerprint[0] == "~" and got[30].fingerprint == got[59].fingerprint
    assert len({got[k].fingerprint for k in (0, 30, 65, 66, 100)}) == 5 and got[100].fingerprint == "-"
    assert got[28].near_next == got[30].near_next == 1.0 and got[29].near_next == got[59].near_next == got[66].near_next == 0.0


def test_ranges_of_ids(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r.id: r.next_text for r in imatch.ranged(df, "doc_id", "text", rows_per_range=4).collect()}
    assert got == {3 * k: str((k + 1) % 50) for k in range(50)}
    # rows without an id are dealt out by their texts
    nameless = df.select(F.when(F.col("doc_id") > 90, F.col("doc_id")).alias("doc_id"), "text")
    rows = imatch.ranged(nameless, "doc_id", "text", rows_per_range=4).collect()
    parts = collections.Counter(r.part for r in rows)
    assert max(parts.values()) < 20 and sorted(r.text for r in rows) == sorted(r.next_text for r in rows)
    assert {r.id: r.next_text for r in rows if r.id} == {3 * k: str(k + 1) for k in range(31, 49)} | {147: next(r.text for r in rows if r.part == min(parts) and r["rank"] == 1)}


# languages


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid_crf.languages(docs, sample=80).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(odd, spark):
    got = {r.doc_id: r.lang_pred for r in langid_crf.languages(odd).collect()}
    assert got[1] == got[2] == got[8] == "und" and got[3] in ("en", "fr") and got[7] in ("en", "fr")
    unlabelled = langid_crf.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlabelled) == 10 and all((r.lang_pred, r.score) == ("und", 0.0) for r in unlabelled)


def test_code_switching_is_labelled_by_word():
    model = langid_crf.fit({"a": ["lorem ipsum dolor sit amet consectetur " * 40], "b": ["zwk xqj vvz kkw jjq zzx " * 40]}, sequences=800)
    labeller = langid_crf.Labeller(model)
    mixed = ["lorem", "ipsum", "dolor", "zwk", "xqj", "vvz", "kkw"]
    ids = labeller.ids_of(" ".join(mixed))
    marginals = langid_crf.forward_backward(labeller.table[ids][None], np.array([7]), model.transitions, model.first)[0]
    assert marginals.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1]
    name, share = next(labeller.label(iter([" ".join(mixed)])))
    assert name == "b" and 0.5 < share < 0.65


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t, first = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total, marginal, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = math.exp(first[path[0]] + sum(e[0, k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for k, y in enumerate(path):
            marginal[k, y] += p
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += p
    m, x = langid_crf.forward_backward(e, np.array([4]), t, first, pairs=True)
    assert np.allclose(m[0], marginal / total) and np.allclose(x, pairs / total)
    padded = np.concatenate([e, np.zeros((1, 2, 3))], axis=1)
    assert np.allclose(langid_crf.forward_backward(padded, np.array([4]), t, first)[0, :4], marginal / total)


# quality


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(3)
    model = langid_crf.Model(["a", "b", "c"], np.zeros((langid_crf.FEATURES, 3), np.float32), {}, np.zeros((3, 3)), rng.normal(0, 2, (3, 3)), rng.normal(size=3))
    texts = [rng.normal(0, 1, (n, 3)).astype(np.float32) for n in (0, 1, 5, 64, 65, 200, 1000, 129, 128)]
    whole = langid_crf.Labeller(model).marginal_sums(texts, chain=10_000)
    for chain in (1, 7, 64):
        assert np.allclose(langid_crf.Labeller(model).marginal_sums(texts, chain), whole, rtol=2e-3, atol=2e-3)


def test_more_languages_than_are_learned(spark):
    rows = [(k, f"word{chr(97 + k % 9)} other{chr(97 + k % 9)} " * 4, f"l{k % 9}" if k % 9 < 3 or k < 30 else "l0") for k in range(90)]
    model = langid_crf.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=3)
    assert model.languages == ["l0", "l1", "l2"]
    assert langid_crf.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=500).languages == [f"l{k}" for k in range(9)]


def test_spread_takes_from_the_whole_text():
    text = [str(k) for k in range(10_000)]
    some = langid_crf.spread(text, 160)
    assert len(some) == 160 and some[0] == "0" and some[-1] == "9999" and langid_crf.spread(text[:9], 16) == text[:9]
    assert langid_crf.words_of("x" * 95) == ["x" * 40, "x" * 40, "x" * 15]


def test_predictions_against_brute_force(docs):
    """Every text by one loop over its words, without blocks, batches or remembered potentials."""
    model = langid_crf.train(docs)
    step = np.exp(model.transitions - model.transitions.max())
    got = {r.doc_id: r for r in langid_crf.languages(docs).collect()}
    for r in docs.filter("doc_id % 3 = 0").collect():
        words_ = langid_crf.words_of(r.text)
        if not words_:
            assert got[r.doc_id].lang_pred == "und"
            continue
        psi = np.exp(np.concatenate([model.potentials([w]) for w in words_]).astype(np.float64))
        alpha, beta = [psi[0] * np.exp(model.first)], [np.ones(len(model.languages))]
        for p in psi[1:]:
            a = (alpha[-1] @ step) * p
            alpha.append(a / a.sum())
        for p in psi[:0:-1]:
            b = step @ (p * beta[-1])
            beta.append(b / b.sum())
        marginals = np.array(alpha) * np.array(beta[::-1])
        sums = (marginals / marginals.sum(axis=1, keepdims=True)).sum(axis=0)
        assert got[r.doc_id].score == pytest.approx(sums.max() / len(words_), abs=2e-3)
        assert got[r.doc_id].lang_pred == model.languages[int(sums.argmax())] or np.sort(sums)[-1] - np.sort(sums)[-2] < 1e-2


def test_samples_are_bounded_and_spread(spark):
    rows = [(k, "same text", "a") for k in range(400)] + [(7, "hot", "b")] * 500 + [(k, "y" * 5000, "c") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    got = collections.Counter(r.label for r in bounded_sample(df, 100, 400_000).collect())
    assert got["a"] == 100 and got["b"] == 1 and got["c"] == 50
    assert collections.Counter(r.label for r in bounded_sample(df, 100, 160_000).collect())["c"] <= 32
    again = bounded_sample(df.repartition(5), 100, 400_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, bounded_sample(df, 100, 400_000).collect()))


def test_quality_scores_against_brute_force(spark):
    """Pooling token by token, and the network's sums one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for r in docs.filter("doc_id % 40 = 0").collect():
        tokens = re.findall(r"\w+|[^\w\s]+", r.text or "")
        x = np.zeros(2 * quality.DIM + 8)
        if tokens:
            rows = [model.vectors[model.vocabulary.get(t, model.shapes.get(quality.shape_of(t), len(model.vectors) - 1))] for t in tokens]
            x[: quality.DIM], x[quality.DIM : -8] = np.mean(rows, axis=0), np.std(rows, axis=0)
            ws = [t for t in tokens if t[0].isalnum() or t[0] == "_"]
            m = max(1, len(ws))
            x[-8:] = [1 - len(ws) / len(tokens), sum(t.isupper() for t in ws) / m, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / m, len(set(ws)) / m, min(1, sum(map(len, ws)) / m / 12), sum(map(len, ws)) / len(r.text), min(1, r.text.count("\n") / m), min(1, m / 200)]
        hidden = [math.tanh(sum((x - model.centre) / model.scale * model.w1[:, j]) + model.b1[j]) for j in range(model.w1.shape[1])]
        score = 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2) / model.temperature))
        assert got[r.doc_id].score == pytest.approx(score, abs=2e-3) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_long_texts_are_pooled_in_pieces(monkeypatch):
    model = quality.fit(["good words here, and more of them"] * 3 + ["BAD!!! BAD bad 99"] * 3, [1, 1, 1, 0, 0, 0])
    text = "Some good words, some BAD ones 12\n " * 300
    whole = quality.Vectors(model).pooled(text)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert "".join(quality.pieces_of(text)) == text
    assert np.allclose(quality.Vectors(model).pooled(text), whole, atol=1e-5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert len(quality.classify(odd, labels).collect()) == 10
    assert {r.score for r in quality.classify(odd, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_temperature_and_labels_decide_and_nothing_else(spark, odd):
    model = quality.fit(["good words here and there", "BAD!! BAD!! BAD!!"] * 40, [1, 0] * 40, epochs=10)
    x = odd.select("doc_id", "text")
    a = {r.doc_id: r.score for r in quality.score(x, model).collect()}
    b = {r.doc_id: r.score for r in quality.score(x.repartition(3), model).collect()}
    assert a == b
    good, bad = (quality.Vectors(model).pooled(t) for t in ("other words here", "BAD!! WORSE!!"))
    assert model.scores(good[None])[0] > model.scores(bad[None])[0]
