"""Benchmark decontamination by templates.

Texts become tokens in two forms: plain (lower case) and template, in which numbers, names (capitalised words) and units
(those of one letter after a number only) are typed placeholders. Windows of `window` tokens are hashed in both forms and joined to the
benchmark's windows by hash. Where a window matches as a template only, its slots are compared: within one document and
item, every benchmark value must stand for one value throughout, so a question asked with other numbers or names is
caught while a chance likeness of templates is not. A document is reported with an item if the windows that hold cover at least
`share` of the item's, or if `run` of its tokens in a row do, however long the item is.

Documents are read once; a bitmap of 2**22 flags, whatever the size of the benchmark, keeps windows that can't match from
being dealt out at all, and the join on the full hash decides: a window that passes goes in both forms, and its template is
set aside only where the same item is known to hold it word by word. Equal items are sought once. Windows are hashed by doubling, and
templates of whole items are looked for only where one of their first windows is met, so that their lengths cost no pass each.

Benchmark items shorter than a window are sought as a whole. Items in which too few windows have enough literal words to reach the
share as templates (short items, and those that are mostly numbers and names) are also sought by one template of the whole item, in
which capitalised function words stay words; it holds if its slots are consistent, and it is made for items in which two tokens
at least are given, as literal words or as values that come again. With fewer (`12 + 15`, a single name) any numbers or
names would do: those are sought in plain form only.

Defined results: null and empty texts and items match nothing; rows that share an id are judged together, null ids too;
repeated items are reported by their item_id each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stripewise.llm.common import checkpointed, fresh_names

WINDOW = 8
SHARE = 0.2
RUN = 50
LEAST_LITERAL = 5
LEAST_GIVEN = 2
FILTER_BITS = 22
BROADCAST_WINDOWS = 100_000

UNITS = frozenset(
    "% percent km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs oz ton tons tonne tonnes l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms ns mph kmh km/h hz khz mhz ghz w kw v a j kj cal kcal pa "
    "k c f celsius fahrenheit degree degrees dollar dollars euro euros pound pounds cent cents usd eur gbp b kb mb gb tb bytes bit bits".split()
)
FUNCTION_WORDS = frozenset(
    "what which who whom whose when where why how if is are was were do does did has have had can could should would will the a an this that these those there it in on at of for from with by to "
    "and or but as not each every all some find compute calculate solve evaluate determine simplify convert name give list write given let suppose".split()
)
_PIECE = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£]")
_WORD, _NUMBER, _NAME = 0, 1, 2
_SLOTS = {_NUMBER: "n", _NAME: "c", 3: "u"}
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], dtype=np.uint64)

CANDIDATE_SCHEMA = "key {key}, hash long, place int, plain boolean, words long, slots array<string>"
WINDOW_SCHEMA = "item_id {key}, hash long, place int, windows int, length int, plain boolean, whole boolean, slots array<string>, anchor long"


class Canon:
    """Tokens of white-space-separated strings, remembered; emptied when it holds `most` of them."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.first, self.count = [], []
        self.plain, self.hash, self.kind, self.unit, self.long, self.common = [], [], [], [], [], []
        self._arrays = None

    def _learn(self, raw: str) -> int:
        import xxhash

        k = self.ids[raw] = len(self.first)
        self.first.append(len(self.plain))
        for piece in _PIECE.findall(raw):
            low = piece.lower()
            self.plain.append(low)
            self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
            self.kind.append(_NUMBER if piece[0].isdigit() else _NAME if piece[0].isupper() else _WORD)
            self.unit.append(low in UNITS)
            self.long.append(len(low) > 1)
            self.common.append(low in FUNCTION_WORDS)
        self.count.append(len(self.plain) - self.first[-1])
        return k

    def ids_of(self, text: str) -> np.ndarray:
        get, learn = self.ids.get, self._learn
        raws = text.split()
        return np.fromiter((k if (k := get(x)) is not None else learn(x) for x in raws), dtype=np.int64, count=len(raws))

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self._arrays is None or len(self._arrays[0]) != len(self.first):
            self._arrays = (np.array(self.first, dtype=np.int64), np.array(self.count, dtype=np.int64), np.array(self.hash, dtype=np.uint64), np.array(self.kind, dtype=np.int8), np.array(self.unit, dtype=bool), np.array(self.long, dtype=bool), np.array(self.common, dtype=bool))
        return self._arrays

    def full(self) -> bool:
        return len(self.first) > self.most


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Chunk:
    """The tokens of several texts in a row, with what their windows need."""

    def __init__(self, canon: Canon, ids: list[np.ndarray]):
        first, count, hashes, kind, unit, long, common = canon.arrays()
        raw = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        n = count[raw] if len(raw) else raw
        ends = np.cumsum(n)
        flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first[raw] if len(raw) else raw, n)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.text = np.repeat(owner, n)
        self.start = np.searchsorted(self.text, np.arange(len(ids) + 1))
        self.flat, self.plain = flat, hashes[flat]
        kinds = kind[flat].copy()
        after = np.zeros(len(flat), dtype=bool)
        after[1:] = (kinds[:-1] == _NUMBER) & (self.text[1:] == self.text[:-1])
        kinds[(after | long[flat]) & unit[flat] & (kinds != _NUMBER)] = 3
        self.kinds = kinds
        self.template = np.where(kinds == _WORD, self.plain, _MARKS[kinds])
        self._common = common
        self._canon = canon
        self._doubled: dict[int, list[np.ndarray]] = {}

    @cached_property
    def whole_kinds(self) -> np.ndarray:
        """Kinds of the tokens in templates of whole items."""
        return np.where((self.kinds == _NAME) & self._common[self.flat], _WORD, self.kinds)

    @cached_property
    def whole_template(self) -> np.ndarray:
        return np.where(self.whole_kinds == _WORD, self.plain, _MARKS[self.whole_kinds])

    def hashes(self, length: int, form: int) -> np.ndarray:
        """Hashes of all windows of a length: two windows of a power of two that overlap, each paired from two of half of it."""
        levels = self._doubled.get(form)
        if levels is None:
            levels = self._doubled[form] = [(self.template, self.plain, self.whole_template)[form] + np.uint64(form + 1)]
        power = length.bit_length() - 1
        while len(levels) <= power:
            half = 1 << (len(levels) - 1)
            levels.append(_paired(levels[-1][:-half], levels[-1][half:]))
        n = max(0, len(self.flat) - length + 1)
        last = length - (1 << power)
        return _mixed(_paired(levels[power][:n], levels[power][last : last + n]) + np.uint64(length))

    def hashes_at(self, length: int, form: int, places: np.ndarray) -> np.ndarray:
        """The same of the windows at some places only, from the doublings that there are."""
        levels = self._doubled[form]

        def doubled(power: int, at: np.ndarray) -> np.ndarray:
            return levels[power][at] if power < len(levels) else _paired(doubled(power - 1, at), doubled(power - 1, at + (1 << (power - 1))))

        power = length.bit_length() - 1
        return _mixed(_paired(doubled(power, places), doubled(power, places + (length - (1 << power)))) + np.uint64(length))

    def windows(self, length: int, plain: bool, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each place, and whether it lies in one text and says enough; templates of whole items need a slot only."""
        if len(self.flat) < length:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        hashes = self.hashes(length, 1 if plain else 2 if whole else 0)
        good = self.text[length - 1 :] == self.text[: len(hashes)]
        if not plain:
            literal = np.concatenate([[0], np.cumsum((self.whole_kinds if whole else self.kinds) == _WORD)])
            said = literal[length:] - literal[:-length]
            good = good & (said >= (0 if whole else LEAST_LITERAL)) & (said < length)
        return hashes, good

    def slots(self, place: int, length: int, whole: bool = False) -> list[str]:
        return [_SLOTS[int(k)] + self._canon.plain[f] for k, f in zip((self.whole_kinds if whole else self.kinds)[place : place + length], self.flat[place : place + length], strict=True) if k != _WORD]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """All windows of all items, and templates of whole items whose windows can't reach the share as templates: WINDOW_SCHEMA."""
    kept = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    key = kept.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon, rows = Canon(), []
            for key_, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                chunk = Chunk(canon, [canon.ids_of(text or "")])
                tokens = len(chunk.flat)
                length = min(window, tokens)
                if not length:
                    continue
                windows, templates = tokens - length + 1, 0
                for plain in (True, False) if length == window else (True,):
                    hashes, good = chunk.windows(length, plain)
                    rows += [(key_.as_py(), int(hashes[k : k + 1].view(np.int64)[0]), k, windows, length, plain, False, [] if plain else chunk.slots(k, length), None) for k in np.flatnonzero(good).tolist()]
                    templates += 0 if plain else int(good.sum())
                if templates < 2 * share * windows:
                    hashes, good = chunk.windows(tokens, False, whole=True)
                    slots = chunk.slots(0, tokens, whole=True)
                    if good[0] and tokens - len(set(slots)) >= LEAST_GIVEN:
                        anchor = int(chunk.hashes(window, 2)[:1].view(np.int64)[0]) if tokens > window else None
                        rows.append((key_.as_py(), int(hashes.view(np.int64)[0]), 0, windows, tokens, False, True, slots, anchor))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "hash", "place", "windows", "length", "plain", "whole", "slots", "anchor"])

    return kept.mapInArrow(cut, WINDOW_SCHEMA.format(key=key))


def _candidates(docs: DataFrame, flags, lengths: list[tuple[int, bool]], id_col: str, text_col: str, window: int, chunk_tokens: int = 400_000) -> DataFrame:
    kept = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    key = kept.schema["key"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, canon = np.unpackbits(np.frombuffer(flags.value, dtype=np.uint8), bitorder="little"), Canon()

        def found(keys: list, ids: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
            chunk, rows, anchors = Chunk(canon, ids), [], None

            def passing(hashes: np.ndarray) -> np.ndarray:
                return passes[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)].astype(bool)

            for length, whole in lengths:
                if whole and length > window:
                    if anchors is None:
                        first = chunk.hashes(window, 2) if len(chunk.flat) >= window else np.zeros(0, np.uint64)
                        anchors = np.flatnonzero(passing(first))
                    at = anchors[anchors <= len(chunk.flat) - length]
                    at = at[chunk.text[at] == chunk.text[at + length - 1]]
                    hashes = chunk.hashes_at(length, 2, at) if len(at) else np.zeros(0, np.uint64)
                    met = passing(hashes)
                    at, hashes = at[met], hashes[met].view(np.int64)
                    if len(at):
                        chunk.hashes(1, 1)
                        words = chunk.hashes_at(length, 1, at).view(np.int64)
                        for k, h, w in zip(at.tolist(), hashes.tolist(), words.tolist(), strict=True):
                            owner = int(chunk.text[k])
                            rows.append((keys[owner], h, k - int(chunk.start[owner]), False, w, chunk.slots(k, length, True)))
                    continue
                words = chunk.windows(length, True)[0].view(np.int64) if whole else None
                for plain in (False,) if whole else (True, False) if length == window else (True,):
                    hashes, good = chunk.windows(length, plain, whole)
                    if plain:
                        words = hashes.view(np.int64)
                    hit = passing(hashes) & good
                    for k in np.flatnonzero(hit).tolist():
                        owner = int(chunk.text[k])
                        rows.append((keys[owner], int(hashes[k : k + 1].view(np.int64)[0]), k - int(chunk.start[owner]), plain, int(words[k]), [] if plain else chunk.slots(k, length, whole)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [kind, pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "hash", "place", "plain", "words", "slots"])

        for batch in batches:
            kind, keys, ids, size = batch.schema.field(0).type, [], [], 0
            for key_, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key_.as_py())
                ids.append(canon.ids_of(text.as_py() or ""))
                size += len(ids[-1])
                if size >= chunk_tokens or canon.full():
                    yield found(keys, ids, kind)
                    keys, ids, size = [], [], 0
                    if canon.full():
                        canon.clear()
            if keys:
                yield found(keys, ids, kind)

    return kept.mapInArrow(search, CANDIDATE_SCHEMA.format(key=key))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """id, item_id, windows (of the item that hold), item_windows, share and verbatim (no slot differs) of contaminated documents."""
    spark = docs.sparkSession
    # equal items are one unit, told apart again at the end
    units = checkpointed(items.select(F.col(item_col).alias("named"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL").distinct().withColumn("unit", F.xxhash64("text")))
    bench = checkpointed(benchmark_windows(units.select("unit", "text").distinct(), "unit", "text", window, share))
    # 2**22 places as 65,536 numbers of 64 bits, whatever the benchmark
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    sought = bench.select("hash").unionByName(bench.filter("anchor IS NOT NULL").select(F.col("anchor").alias("hash")))
    words = sought.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63) AS int))")).alias("bits")).collect()
    bits = np.zeros(1 << max(0, FILTER_BITS - 6), dtype=np.int64)
    bits[[r.word for r in words]] = [r.bits for r in words]
    flags = spark.sparkContext.broadcast(bits.tobytes())
    # only items shorter than a window or with too few templates need windows of other lengths
    lengths = sorted((r.length, r.whole) for r in bench.select("length", "whole").distinct().collect())

    found = _candidates(docs, flags, lengths, id_col, text_col, window)
    wanted = bench.select("item_id", "hash", F.col("place").alias("item_place"), "windows", F.col("plain").alias("item_plain"), "whole", F.col("slots").alias("item_slots"))
    # a window that very many documents share stays where they are if the benchmark's windows are few, else AQE splits it
    wanted = F.broadcast(wanted) if bench.count() <= BROADCAST_WINDOWS else wanted
    met = found.join(wanted, "hash").filter(F.col("plain") == F.col("item_plain"))
    met = met.filter(F.size("slots") == F.size("item_slots")).withColumn("same", F.col("slots") == F.col("item_slots"))
    met = checkpointed(met)  # read three times below; the texts are searched once

    # template matches with other values: each value of the item must stand for one value in the document
    by_words = bench.filter("plain").select(F.col("item_id").alias("i"), F.col("hash").alias("w")).distinct()
    # what the same item holds word by word needs no template
    unlike = met.filter(~F.col("same")).join(by_words, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("words") == F.col("w")), "left_anti")
    other = unlike.filter(~F.col("whole"))
    pairs = other.select("key", "item_id", "windows", "item_place", "place", F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select("key", "item_id", "windows", "item_place", "place", F.col("x.item_slots").alias("was"), F.col("x.slots").alias("now"))
    votes = pairs.groupBy("key", "item_id", "was", "now").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("key", "item_id", "was").agg(F.max(F.struct("n", "now")).getField("now").alias("means"))
    on = [pairs["key"].eqNullSafe(F.col("k")), pairs["item_id"].eqNullSafe(F.col("i")), pairs["was"] == F.col("w")]
    agreed = (
        pairs.join(chosen.select(F.col("key").alias("k"), F.col("item_id").alias("i"), F.col("was").alias("w"), "means"), on)
        .groupBy("key", "item_id", "windows", "item_place", "place")
        .agg(F.bool_and(F.col("now") == F.col("means")).alias("holds"))
        .filter("holds")
    )
    # a whole item's template is judged by itself, and stands for all its windows
    said = F.size(F.array_distinct(F.arrays_zip("item_slots", "slots"))) == F.size(F.array_distinct("item_slots"))
    wholes = unlike.filter("whole").filter(said).select("key", "item_id", "windows", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("item_place"), F.lit(0).alias("place"), F.lit(False).alias("same"))
    held = wholes.unionByName(met.filter("same").select("key", "item_id", "windows", "item_place", "place", F.lit(True).alias("same"))).unionByName(agreed.select("key", "item_id", "windows", "item_place", "place", F.lit(False).alias("same")))
    each = held.groupBy("key", "item_id", "windows", "item_place").agg(F.bool_or("same").alias("same"))
    judged = each.groupBy("key", "item_id", "windows").agg(F.count("*").cast("int").alias("n"), F.bool_and("same").alias("verbatim"))
    enough = F.col("n") >= share * F.col("windows")
    # in shorter items a run is a share of the windows that is enough
    least = max(1, run - window + 1)
    if bench.filter(share * F.col("windows") > least).limit(1).count():
        shifts = held.filter(share * F.col("windows") > least).select("key", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
        first = F.col("item_place") - F.row_number().over(W.partitionBy("key", "item_id", "shift").orderBy("item_place"))
        runs = shifts.withColumn("first", first).groupBy("key", "item_id", "shift", "first").agg(F.count("*").alias("length")).filter(F.col("length") >= least)
        runs = runs.select(F.col("key").alias("k"), F.col("item_id").alias("i"), F.lit(True).alias("ran")).distinct()
        judged = judged.join(runs, F.col("key").eqNullSafe(F.col("k")) & F.col("item_id").eqNullSafe(F.col("i")), "left")
        enough = enough | F.col("ran").isNotNull()
    reported = judged.filter(enough).select("key", F.col("item_id").alias("unit"), F.col("n").alias("windows"), F.col("windows").alias("item_windows"), (F.col("n") / F.col("windows")).alias("share"), "verbatim")
    return reported.join(units.select("unit", F.col("named").alias("item_id")), "unit").select(F.col("key").alias(id_col), "item_id", "windows", "item_windows", "share", "verbatim")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id isn't reported by `contaminated`, with all their columns."""
    name = fresh_names(docs, "leaked")["leaked"]
    found = contaminated(docs.select(id_col, text_col), items, id_col, text_col, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(name)), "left_anti")
