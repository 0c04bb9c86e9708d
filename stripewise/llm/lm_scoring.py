"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders up to `order` (2: word pairs) with the uniform estimate; the
weights depend on how often the context was seen, by powers of two, and are learned by expectation-maximisation on held-out
counts: a part of the training rows is left out of the counts, and its tokens are what the weights are fitted to. Scores
then use the counts of all training rows.

Texts are read once and never shuffled: every task packs them, some bytes at a time, into groups of sorted word hashes and
the places of the words among them, and writes those to the shared folder; the later steps read that. Counts never meet in
one place. Each group asks for the n-grams it has by sorted 64-bit hashes, the hashes are dealt to owners by their leading
bits, and the owners send back counts in the order of the asking. With more than `fan` owners the asking goes by way of relays,
each of which merges what some groups ask of some owners, so that no message shrinks to a few keys and no owner hears from
every group. For the weights, tokens are reduced to a histogram of log ratios by context bucket (a fixed grid, whatever the
size of the corpus) that the driver fits. Counts are 64 bits wide throughout.

Defined results: a null text counts as the empty text, whose only token is the end; repeated rows count as often as they
come; without training rows every estimate is uniform; a null id splits like the empty text; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import discard, split_of, stored

#: Text of a group; a longer text is a group of its own.
GROUP_BYTES = 12 << 20
#: Tokens whose n-grams an owner counts, on average; owners that a group or a relay sends to.
TOKENS_PER_OWNER = 1_000_000
LEAST_OWNERS = 8
FAN = 2048
#: Cells of the histogram: log2 ratios by quarters within +-40.
_GRID, _REACH = 4, 40

_U = np.uint64
_END = _U(0x8BADF00D5EED1E55)
_START = _U(0x51AB1E0FFB0A710D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACES = _mix(np.arange(1, 1025, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _runs(raw: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and unfinished hashes of the words in some bytes; `before` bytes of the first word came earlier."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0] if len(raw) and not space[0] else [], edge, [len(raw)] if len(raw) and not space[-1] else []]).astype(np.int64)
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    letters = raw[~space]
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(len(letters)) - np.repeat(firsts, lengths)
    places[: lengths[0]] += before
    factors = _PLACES[places & 1023]
    if places.max() > 1023:  # places beyond the table take their own factors
        far = places > 1023
        factors[far] = _mix(places[far].astype(np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    return starts, lengths, np.add.reduceat(_BYTES[letters] * factors, firsts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, A-Z lower-cased, and how many each text has."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    starts, lengths, sums = _runs(raw)
    return _mix(sums + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


def long_word_hashes(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """The same of one text, a block of bytes at a time; a word may go on from block to block."""
    out: list[np.ndarray] = []
    open_sum, open_length = _U(0), 0
    for lo in range(0, len(text), block):
        raw = np.frombuffer(text[lo : lo + block].lower(), dtype=np.uint8)
        if open_length and _IS_SPACE[raw[0]]:
            out.append(_mix(np.array([open_sum], np.uint64) + _U(open_length)))
            open_sum, open_length = _U(0), 0
        starts, lengths, sums = _runs(raw, open_length)
        if open_length:
            sums[:1] += open_sum
            lengths[0] += open_length
        if len(starts) and not _IS_SPACE[raw[-1]]:
            open_sum, open_length = sums[-1], int(lengths[-1])
            lengths, sums = lengths[:-1], sums[:-1]
        else:
            open_sum, open_length = _U(0), 0
        out.append(_mix(sums + lengths.astype(np.uint64)))
    if open_length:
        out.append(_mix(np.array([open_sum], np.uint64) + _U(open_length)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _start(n: int) -> np.uint64:
    """The context of n words of a text's first token."""
    return _START + _U(n)


def tokens_of(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, ends included, and how many each text has."""
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0

    def flush() -> None:
        if waiting:
            hashes, n = word_hashes(waiting)
            tokens = np.full(len(hashes) + len(n), _END)
            inside = np.ones(len(tokens), dtype=bool)
            inside[np.cumsum(n + 1) - 1] = False
            tokens[inside] = hashes
            parts.append(tokens)
            counts.append(n + 1)
            waiting.clear()

    for text in texts:
        if len(text) > chunk:
            flush()
            size = 0
            parts.append(np.append(long_word_hashes(text, chunk), _END))
            counts.append(np.array([len(parts[-1])]))
            continue
        waiting.append(text)
        size += len(text) + 1
        if size >= chunk:
            flush()
            size = 0
    flush()
    return (np.concatenate(parts), np.concatenate(counts).astype(np.int64)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Grams:
    """The tokens of a group's texts as numbers of their n-grams among the group's sorted distinct hashes."""

    def __init__(self, words: np.ndarray, stream: np.ndarray, counts: np.ndarray, order: int):
        """words: the sorted distinct token hashes; stream: the tokens as places among them, `counts` of each text."""
        self.counts = counts
        self.firsts = np.cumsum(counts) - counts
        tokens = words[stream]
        found, places, current = [words], [stream], tokens
        for n in range(2, order + 1):
            context = np.roll(current, 1)
            context[self.firsts] = _start(n - 1)
            current = _mix(context * _U(0x2545F4914F6CDD1D) + tokens + _U(n))
            keys, inverse = np.unique(current, return_inverse=True)
            found.append(keys)
            places.append(inverse.astype(np.int32))
        found.append(np.array([_start(n) for n in range(1, order)], dtype=np.uint64))
        merged = np.concatenate(found)
        by_key = np.argsort(merged, kind="stable")
        at = np.empty(len(merged), dtype=np.int32)
        at[by_key] = np.arange(len(merged), dtype=np.int32)
        self.keys = merged[by_key]
        self.ids, offset = [], 0
        for keys, inverse in zip(found, places, strict=False):
            self.ids.append(at[offset : offset + len(keys)][inverse])
            offset += len(keys)
        self.starts = at[offset:]
        self.words = np.zeros(len(merged), dtype=bool)
        self.words[at[: len(found[0])]] = True

    @classmethod
    def read(cls, row: pa.Table, order: int) -> Grams:
        """Of a row that `packed_groups` wrote."""
        return cls(_unpack(row.column("words")[0].as_py()), _unpack_counts(row.column("stream")[0].as_py()).astype(np.int32), _unpack_counts(row.column("counts")[0].as_py()).astype(np.int64), order)

    def context(self, n: int) -> np.ndarray:
        """Numbers of the contexts of n words; a text's first token has the start of a text."""
        out = np.roll(self.ids[n - 1], 1)
        out[self.firsts] = self.starts[n - 1]
        return out

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """How often each key occurs in the chosen rows; a text's start counts once for each text."""
        inside = np.repeat(rows, self.counts)
        out = np.zeros(len(self.keys), dtype=np.uint64)
        for ids in self.ids:
            out += np.bincount(ids[inside], minlength=len(out)).astype(np.uint64)
        out[self.starts] += _U(int(rows.sum()))
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, the lowest first; leading planes of zeros are left out."""
    width = (int(numbers.max()).bit_length() + 7) // 8 if len(numbers) else 0
    planes = np.ascontiguousarray(numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T[:width])
    return len(numbers).to_bytes(8, "little") + planes.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = np.frombuffer(data, dtype=np.uint8, offset=8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


_pack_counts, _unpack_counts = _planes, _from_planes


def _bucket(counts: np.ndarray) -> np.ndarray:
    """Of context counts: 0 for none, else one for each power of two."""
    return np.where(counts > 0, np.minimum(np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 20), 0)


def estimates(grams: Grams, counts: np.ndarray, total: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the maximum-likelihood estimate of every token and the bucket of its context."""
    found = counts[grams.ids[0]]
    likely, buckets = [found / max(1, total)], [np.zeros(len(found), dtype=np.int64)]
    of_key = _bucket(counts)
    for n in range(1, len(grams.ids)):
        context = grams.context(n)
        likely.append(counts[grams.ids[n]] / np.maximum(counts[context], 1))
        buckets.append(of_key[context])
    return likely, buckets


def interpolated(likely: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, uniform: float) -> np.ndarray:
    """Probabilities: for each order the weight of its context's bucket goes to its estimate, the rest to the order below."""
    p = np.full(len(likely[0]), uniform)
    for n, (own, bucket) in enumerate(zip(likely, buckets, strict=True)):
        w = weights[n][bucket]
        p = w * own + (1 - w) * p
    return p


def fit_weight(cells: dict[tuple[int, int], int], rounds: int = 60) -> np.ndarray:
    """Weights by bucket from a histogram {(bucket, cell of log2(own / lower))} by expectation-maximisation.

    The cell -1 is of tokens whose own estimate is zero.
    """
    weights = np.zeros(21)
    for bucket in {b for b, _ in cells}:
        items = [(c, n) for (b, c), n in cells.items() if b == bucket]
        ratio = np.array([0.0 if c < 0 else 2.0 ** ((c + 0.5) / _GRID - _REACH) for c, _ in items])
        n = np.array([x for _, x in items], dtype=np.float64)
        w = 0.5
        for _ in range(rounds):
            w = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            w = min(max(w, 1e-9), 1 - 1e-6)
        weights[bucket] = w
    weights[0] = weights[0] if any(b == 0 for b, _ in cells) else 0.0
    return weights


def cells_of(own: np.ndarray, lower: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.floor((np.log2(own / lower) + _REACH) * _GRID)
    return np.where(own > 0, np.clip(cell, 0, 2 * _REACH * _GRID - 1), -1).astype(np.int64)


def packed_groups(rows: DataFrame, group_bytes: int) -> DataFrame:
    """rows: id, fold, text (binary). One row for each group: part, tuning, tokens, ids, folds, and packed counts, words and stream.

    A group has rows of the tuning part only or of the rest only, so the weights can be fitted without reading the others.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        waiting: dict[bool, list] = {False: [], True: []}
        sizes = {False: 0, True: 0}
        id_type = None

        def flush(tuning: bool) -> pa.RecordBatch:
            nonlocal part
            some = waiting[tuning]
            tokens, counts = tokens_of([x for _, _, x in some])
            words, stream = np.unique(tokens, return_inverse=True)
            columns = {
                "part": pa.array([part], pa.int64()),
                "tuning": pa.array([tuning]),
                "tokens": pa.array([len(tokens)], pa.int64()),
                "ids": pa.array([[x for x, _, _ in some]], pa.list_(id_type)),
                "folds": pa.array([bytes(f for _, f, _ in some)], pa.binary()),
                "counts": pa.array([_pack_counts(counts.astype(np.uint64))], pa.binary()),
                "words": pa.array([_pack(words)], pa.binary()),
                "stream": pa.array([_pack_counts(stream.astype(np.uint64))], pa.binary()),
            }
            part, sizes[tuning] = part + 1, 0
            some.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            id_type = batch.schema.field("id").type
            for id_, fold, text in zip(batch.column("id"), batch.column("fold").to_pylist(), batch.column("text"), strict=True):
                tuning, raw = fold == 1, text.as_py()
                waiting[tuning].append((id_.as_py(), fold, raw))
                sizes[tuning] += len(raw) + 1
                if sizes[tuning] >= group_bytes:
                    yield flush(tuning)
        for tuning in (False, True):
            if waiting[tuning]:
                yield flush(tuning)

    return rows.mapInArrow(pack, f"part long, tuning boolean, tokens long, ids array<{kind}>, folds binary, counts binary, words binary, stream binary")


MESSAGE_SCHEMA = "part long, owner long, keys binary, whole binary, main binary, words binary"
REPLY_SCHEMA = "part long, owner long, whole binary, main binary"


def _messages(part: int, keys: np.ndarray, whole: np.ndarray, main: np.ndarray | None, words: np.ndarray, owners: int, first: int = 0, step: int = 1, n: int | None = None) -> dict[str, list]:
    """What is asked of owners `first`, `first + step` and so on (n of them), each for the hashes up to the next one's.

    Without `main` the counts without the tuning part are the whole ones: then nothing is sent for them, nor sent back.
    Owners that are asked for nothing get no row: there are never more rows than keys, however many owners there are.
    """
    n = -(-owners // step) if n is None else n
    cuts = np.searchsorted(keys, ((first + np.arange(1, n, dtype=np.float64) * step) * (2.0**64 / owners)).astype(np.uint64))
    spans = [(k, a, b) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)) if a < b]
    return {
        "part": [part] * len(spans),
        "owner": [first + k * step for k, _, _ in spans],
        "keys": [_pack(keys[a:b]) for _, a, b in spans],
        "whole": [_pack_counts(whole[a:b]) for _, a, b in spans],
        "main": [b"" if main is None else _pack_counts(main[a:b]) for _, a, b in spans],
        "words": [np.packbits(words[a:b]).tobytes() for _, a, b in spans],
    }


def _table(columns: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int64() if k in ("part", "owner") else pa.binary()) for k, v in columns.items()})


class Tally:
    """What several groups or relays ask, merged: the distinct keys with their counts, and each sender's places among them."""

    def __init__(self, table: pa.Table):
        lists = [_unpack(x.as_py()) for x in table.column("keys")]
        self.keys = np.unique(np.concatenate(lists))
        self.places = [np.searchsorted(self.keys, x) for x in lists]
        self.whole, self.main = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.uint64)
        self.words = np.zeros(len(self.keys), bool)
        for at, whole, main, bits in zip(self.places, *(table.column(c) for c in ("whole", "main", "words")), strict=True):
            counts = _unpack_counts(whole.as_py())
            self.whole[at] += counts
            self.main[at] += _unpack_counts(main.as_py()) if main.as_py() else counts
            self.words[at] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(at)).astype(bool)


def counted(groups: DataFrame, order: int, owners: int, n_groups: int, fan: int) -> tuple[DataFrame, list[str]]:
    """Replies to every group (part, owner, whole, main) with the totals of each owner, and the scratch tables to discard."""
    relayed = owners > fan
    step = fan if relayed else 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                grams = Grams.read(row, order)
                counts = grams.counted(np.frombuffer(row.column("folds")[0].as_py(), np.uint8) != 2)
                main = np.zeros_like(counts) if row.column("tuning")[0].as_py() else None
                yield from _table(_messages(row.column("part")[0].as_py(), grams.keys, counts, main, grams.words, owners, step=step)).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        tally = Tally(table)
        known = tally.words & (tally.whole > 0)
        totals = (int(tally.whole[known].sum()), int(known.sum()), int(tally.main[tally.words].sum()))
        replies = {
            "part": table.column("part").to_pylist(),
            "owner": table.column("owner").to_pylist(),
            "whole": [_pack_counts(tally.whole[at]) for at in tally.places],
            "main": [_pack_counts(tally.main[at]) if main.as_py() else b"" for at, main in zip(tally.places, table.column("main"), strict=True)],
        }
        sums = [pa.array([x if k == 0 else 0 for k in range(table.num_rows)], pa.int64()) for x in totals]
        made = _table(replies)
        for name, values in zip(("tokens", "distinct", "main_tokens"), sums, strict=True):
            made = made.append_column(name, values)
        return made

    answer_schema = f"{REPLY_SCHEMA}, tokens long, distinct long, main_tokens long"
    asked = groups.select("part", "tuning", "folds", "counts", "words", "stream").mapInArrow(ask, MESSAGE_SCHEMA)
    if not relayed:
        replies, path = stored(asked.groupBy("owner").applyInArrow(answer, answer_schema), "lm-replies")
        return replies, [path]

    bundles = -(-n_groups // fan)
    asked, asked_path = stored(asked, "lm-asked")
    asked = asked.withColumn("node", (F.col("owner") / fan).cast("long") * bundles + F.pmod(F.xxhash64("part"), F.lit(bundles)))

    def relay(table: pa.Table) -> pa.Table:
        tally, first = Tally(table), table.column("owner")[0].as_py()
        return _table(_messages(table.column("node")[0].as_py(), tally.keys, tally.whole, tally.main, tally.words, owners, first=first, n=min(fan, owners - first)))

    def back(table: pa.Table, counts: pa.Table) -> pa.Table:
        lists = [_unpack(x.as_py()) for x in table.column("keys")]
        keys = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        whole, main = _joined(counts, "whole"), _joined(counts, "main")
        places = [np.searchsorted(keys, x) for x in lists]
        return _table({"part": table.column("part").to_pylist(), "owner": table.column("owner").to_pylist(), "whole": [_pack_counts(whole[at]) for at in places], "main": [_pack_counts(main[at]) if x.as_py() else b"" for at, x in zip(places, table.column("main"), strict=True)]})

    inner, inner_path = stored(asked.groupBy("node").applyInArrow(relay, MESSAGE_SCHEMA).groupBy("owner").applyInArrow(answer, answer_schema), "lm-inner")
    outer = asked.select("node", "part", "owner", "keys", "main").groupBy("node").cogroup(inner.select(F.col("part").alias("node"), "owner", "whole", "main").groupBy("node")).applyInArrow(back, REPLY_SCHEMA)
    sums = inner.select(F.lit(-1).cast("long").alias("part"), "owner", F.lit(None).cast("binary").alias("whole"), F.lit(None).cast("binary").alias("main"), "tokens", "distinct", "main_tokens").filter("tokens + distinct + main_tokens > 0")
    nothing = F.lit(0).cast("long")
    replies, path = stored(outer.withColumns({"tokens": nothing, "distinct": nothing, "main_tokens": nothing}).unionByName(sums), "lm-replies")
    discard(groups.sparkSession, asked_path, inner_path)
    return replies, [path]


def _joined(counts: pa.Table, column: str) -> np.ndarray:
    """The counts that several owners sent, in the order of the keys."""
    order = np.argsort(counts.column("owner").to_numpy())
    return np.concatenate([_unpack_counts(counts.column(column)[int(k)].as_py()) for k in order]) if len(order) else np.zeros(0, np.uint64)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mod: int = 7,
    held: int = 2,
    tuning: int = 3,
    order: int = 2,
    group_bytes: int = GROUP_BYTES,
    tokens_per_owner: int = TOKENS_PER_OWNER,
    fan: int = FAN,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32(id) modulo `mod` isn't `held`; of these, those where it is `tuning` are what the weights
    are fitted to.
    """
    rest = split_of("id", mod)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")).withColumn("fold", F.when(rest == held, 2).when(rest == tuning, 1).otherwise(0).cast("int"))
    kind = rows.schema["id"].dataType.simpleString()
    groups, _ = stored(packed_groups(rows, group_bytes), "lm-groups")
    size = groups.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    owners = max(LEAST_OWNERS, -(-(size.tokens or 0) // tokens_per_owner))
    replies, _ = counted(groups, order, owners, size.n, fan)
    sums = replies.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.sum("main_tokens").alias("main")).first()
    total, distinct, main_total = sums.tokens or 0, sums.distinct or 0, sums.main or 0
    uniform = 1.0 / (distinct + 1)

    weights = np.zeros((order, 21))

    def histogram_of(n: int, so_far: np.ndarray):
        def histogram(table: pa.Table, counts: pa.Table) -> pa.Table:
            found: dict[tuple[int, int], int] = {}
            if table.num_rows:
                likely, buckets = estimates(Grams.read(table, order), _joined(counts, "main"), main_total)
                lower = interpolated(likely[:n], buckets[:n], so_far, uniform) if n else np.full(len(likely[0]), uniform)
                pairs, times = np.unique(buckets[n] * 4096 + cells_of(likely[n], lower), return_counts=True)
                found = dict(zip(pairs.tolist(), times.tolist(), strict=True))
            return pa.table({"cell": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

        return histogram

    tuned = groups.filter("tuning").select("part", "counts", "words", "stream")
    main = replies.join(tuned.select("part"), "part", "left_semi").select("part", "owner", "main")
    for n in range(order):
        # one order at a time, since the mixture below is what the next is mixed with
        cells = tuned.groupBy("part").cogroup(main.groupBy("part")).applyInArrow(histogram_of(n, weights.copy()), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a fixed grid
        weights[n] = fit_weight({((r.cell + 1) // 4096, (r.cell + 1) % 4096 - 1): r.n for r in cells})
    if not main_total:
        weights[:] = 0.0

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        if not table.num_rows:  # the totals that relays pass on
            ids = table.schema.field("ids").type.value_type
            return pa.table({"id": pa.array([], ids), "fold": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        grams = Grams.read(table, order)
        have, firsts = _joined(counts, "whole"), grams.firsts
        likely, buckets = estimates(grams, have, total)
        p = interpolated(likely, buckets, weights, uniform)
        c = have[grams.ids[0]].astype(np.float64)
        return pa.table(
            {
                "id": table.column("ids").combine_chunks().flatten(),
                "fold": pa.array(np.frombuffer(table.column("folds")[0].as_py(), np.uint8).astype(np.int32)),
                "n_tokens": pa.array(grams.counts),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), firsts)),
                "base_score": pa.array(np.add.reduceat(np.log10((c + 1) / (total + distinct + 1)), firsts)),
                "score": pa.array(np.add.reduceat(np.log10(p), firsts)),
            }
        )

    whole = replies.filter("part >= 0").select("part", "owner", "whole")
    scored = groups.select("part", "ids", "folds", "counts", "words", "stream").groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(score, f"id {kind}, fold int, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), (F.col("fold") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
