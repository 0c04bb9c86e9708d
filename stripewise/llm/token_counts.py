"""Token counts behind a digest cache.

The cache is a Parquet table with one row per (content digest, tokenizer digest). Texts are normalised, digested
and joined to it; the distinct texts that it lacks are encoded once each and appended; the answer is a second join. Digests are
joined before any text is dealt out, so a run over a cache that has them all moves no text.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows are returned as often as they
came and encoded once; a null id is kept; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.llm.common import discard, shuffles_dropped, stored

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("content_digest", T.BinaryType()),
        T.StructField("tokenizer_digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)

#: Digests that are broadcast at most, 32 bytes each.
BROADCAST_DIGESTS = 500_000

#: Texts of these characters only are split alike under every Unicode version; others go to the library itself.
_STABLE = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₿]")
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the file is plain byte-level BPE whose ids follow the merge order."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
    )
    if not plain:
        return None
    added = {x["content"]: x for x in spec.get("added_tokens", [])}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added.values()):
        return None
    alphabet, ids = byte_alphabet(), {k: v for k, v in model["vocab"].items() if k not in added}
    order = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
    if [ids.get(x.replace(" ", "", 1)) for x in order] != list(range(256, 256 + len(order))) or len(ids) != 256 + len(order):
        return None
    return {bytes(alphabet[c] for c in token): rank for token, rank in ids.items()}


def counter(spec_json: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, as the tokenizers library gives them for this file.

    Plain byte-level BPE files take a faster encoder with the same merges for texts whose characters no Unicode
    version classes differently; every other text, and every other file, goes through the library.
    """
    from tokenizers import Tokenizer

    spec = json.loads(spec_json)

    @lru_cache(1)
    def library() -> Tokenizer:
        made = Tokenizer.from_str(spec_json)
        made.no_truncation()
        made.no_padding()
        return made

    ranks = _merge_ranks(spec)
    fast = None
    if ranks is not None:
        import tiktoken

        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        fast = tiktoken.Encoding("byte_level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if fast is not None and not _STABLE.search(text):
                out[k] = len(fast.encode(text, allowed_special="all"))
            elif text:
                rest.append(k)
        for lo in range(0, len(rest), 64):
            some = rest[lo : lo + 64]
            for k, got in zip(some, library().encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = len(got.ids)
        return out

    return count


_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _counter_for(spec_json: str, digest: str) -> Callable[[list[str]], list[int]]:
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[digest] = counter(spec_json)
    return _COUNTERS[digest]


def read_cache(spark, path: str) -> DataFrame:
    """The cache without what concurrent or repeated runs appended twice; empty if there is none yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    limit: int = 1024,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row, encoding only texts that the cache at `cache_path` lacks.

    `normalise` is applied before digesting and encoding; the default leaves texts alone, since this vocabulary's own
    normaliser is the identity. n_bytes is of the text as it came. The tokenizer file is read on the driver and sent
    along; its digest keys the cache, so that another version never reads another's counts.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec_json = file.read()
    version = hashlib.sha256(spec_json.encode()).hexdigest()
    shipped = spark.sparkContext.broadcast(spec_json)

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(normalise(text).cast("binary"), 256)).alias("content_digest"),
        normalise(text).alias("content"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter_for(shipped.value, version)
        for batch in batches:
            counts = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=CACHE_SCHEMA.names)

    known = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest")
    lacking, path = stored(keyed.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "token-misses")
    n = lacking.count()
    if n:
        # one row for each text and task before anything is dealt out, so a text that recurs very often weighs no more than others
        if n <= BROADCAST_DIGESTS:
            misses = keyed.join(F.broadcast(lacking), "content_digest", "left_semi").groupBy("content_digest").agg(F.first("content").alias("content"))
        else:
            misses = keyed.groupBy("content_digest").agg(F.first("content").alias("content")).join(lacking, "content_digest", "left_semi")
        with shuffles_dropped(spark):
            misses.select("content_digest", "content").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    discard(spark, path)

    counted = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    return (
        keyed.select("id", "n_bytes", "content_digest")
        .join(counted, "content_digest", "left")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
