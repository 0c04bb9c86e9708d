"""Language identification by a linear-chain conditional random field over words.

The words of a text (runs of letters, lower-cased; runs of over 40 letters are cut into such) are labelled as one chain, however
long the text. A word's potentials come from hashed affixes and byte n-grams, and from a lexicon of the training texts' words with their
shares by language; transitions are learned on sequences spliced from texts of different languages, so that a chain may switch.
Forward-backward gives each word's marginals; a document takes the language with the largest sum, and its share of the words is
the score. Long chains are cut into blocks that are worked side by side: the product of a block's matrices carries the forward
and backward messages over it, so the marginals are those of the whole chain.

The model is fitted on the driver on at most `sample` rows of each language that are not held out and `sample_bytes` of their
text, chosen by a hash, and on the `most` languages that have most rows; all are parameters, and with over TOTAL / `sample`
languages each has the less. Of each text runs of words
spread evenly over all of it are learned from. Prediction reads text only, in batches of bounded size.

Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing can be learned; ties go to the
language first in code-point order; repeated rows are rows of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import bounded_sample, split_of

FEATURES = 1 << 15
CHAIN = 64
#: Rows of a language to fit on, their bytes, and rows of all languages together.
SAMPLE, SAMPLE_BYTES, TOTAL = 300, 16 << 20, 60_000
#: Languages to learn at most: those with most rows.
LANGUAGES = 256
TRAIN_WORDS = 60_000

_WORDS = re.compile(r"[^\W\d_]{1,40}")


def words_of(text: str | None) -> list[str]:
    found = _WORDS.findall((text or "").lower())
    if text and not text.isascii():  # \w also has numerals that are no letters
        found = [w for w in found if w.isalpha() or any(map(str.isalpha, w))]
    return found


def features_of(word: str) -> list[int]:
    """Hashed affixes of one to three characters, n-grams of three and four bytes, and the word itself if it is short."""
    raw = f"^{word}$".encode("utf-8", "surrogatepass")
    mask = FEATURES - 1
    out = [crc32(word[:k].encode("utf-8", "surrogatepass"), 1) & mask for k in (1, 2, 3)]
    out += [crc32(word[-k:].encode("utf-8", "surrogatepass"), 2) & mask for k in (1, 2, 3)]
    out += [crc32(raw[k : k + 3], 3) & mask for k in range(len(raw) - 2)]
    out += [crc32(raw[k : k + 4], 4) & mask for k in range(len(raw) - 3)]
    if len(word) < 8:
        out.append(crc32(raw, 5) & mask)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: dict[str, np.ndarray]  # shares by language
    lexical: np.ndarray  # languages x languages
    transitions: np.ndarray
    first: np.ndarray

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log potentials of words, whatever their context."""
        size = len(self.languages)
        if not words:
            return np.zeros((0, size), dtype=np.float32)
        lists = [features_of(w) for w in words]
        counts = np.array(list(map(len, lists)))
        flat = np.fromiter((x for y in lists for x in y), dtype=np.int64, count=int(counts.sum()))
        starts = np.cumsum(counts) - counts
        out = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(counts)[:, None]
        unknown = np.zeros(size)
        return (out + np.stack([self.lexicon.get(w, unknown) for w in words]) @ self.lexical).astype(np.float32)


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None, pairs: bool = False):
    """Marginals (sequence, place, label) of chains padded to the same length, and the expected label pairs if asked for.

    Parts of longer chains have what reaches their first places, by label (`start`, in place of `first`), and what comes
    back to their last ones (`end`).
    """
    start = np.exp(first - first.max()) if start is None else start
    n, length, size = potentials.shape
    psi = np.exp(potentials - potentials.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha = np.empty_like(psi)
    alpha[:, 0] = psi[:, 0] * start
    alpha[:, 0] /= np.maximum(alpha[:, 0].sum(axis=1, keepdims=True), 1e-30)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * psi[:, t]
        alpha[:, t] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
    beta = np.ones_like(psi)
    if end is not None:
        beta *= end[:, None, :]
    expected = np.zeros((size, size))
    for t in range(length - 2, -1, -1):
        ahead = psi[:, t + 1] * beta[:, t + 1]
        b = ahead @ step.T
        b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-30)
        inside = (t < lengths - 1)[:, None]
        beta[:, t] = np.where(inside, b, beta[:, t])
        if pairs:
            both = alpha[:, t][:, :, None] * step * ahead[:, None, :]
            both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-30)
            expected += (both * inside[:, :, None]).sum(axis=0)
    marginals = alpha * beta
    marginals /= np.maximum(marginals.sum(axis=2, keepdims=True), 1e-30)
    return (marginals, expected) if pairs else marginals


def block_matrices(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """For each block what goes from the labels of the place before it to those of its last one; of a chain's opening block, from its first place on."""
    n, length, size = potentials.shape
    psi = np.exp(potentials - potentials.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    out = np.where(opening[:, None, None], np.eye(size, dtype=psi.dtype), step) * psi[:, 0][:, None, :]
    for t in range(1, length):
        longer = (out.reshape(-1, size) @ step).reshape(n, size, size) * psi[:, t][:, None, :]
        longer /= np.maximum(longer.max(axis=(1, 2), keepdims=True), 1e-30)
        out = np.where((t < lengths)[:, None, None], longer, out)
    return out / np.maximum(out.max(axis=(1, 2), keepdims=True), 1e-30)


def spread(words: list[str], most: int, run: int = 16) -> list[str]:
    """At most about `most` of the words, in runs that are spread evenly over all of them."""
    if len(words) <= most:
        return words
    runs = max(1, most // run)
    return [w for k in range(runs) for w in words[k * (len(words) - run) // max(1, runs - 1) :][:run]]


def fit(texts: dict[str, list[str]], epochs: int = 4, chain: int = 16, sequences: int = 4000, batch: int = 200, rate: float = 0.3, seed: int = 3) -> Model:
    """A model of texts by language."""
    languages = sorted(texts)
    size, rng = len(languages), np.random.default_rng(seed)
    streams = []
    for language in languages:
        stream: list[str] = []
        for text in texts[language]:
            # each text gives a like part of the words, so one long text doesn't stand for its language
            stream += spread(words_of(text), max(50, TRAIN_WORDS // max(1, len(texts[language]))))
        streams.append(stream or ["a"])
    counts = [Counter(s) for s in streams]
    lexicon = {}
    for word in set().union(*counts):
        of = np.array([c[word] / len(s) for c, s in zip(counts, streams, strict=True)])
        if sum(c[word] for c in counts) >= 3:
            lexicon[word] = (of / of.sum()).astype(np.float32)
    weights, lexical = np.zeros((FEATURES, size)), np.zeros((size, size))
    model = Model(languages, weights, lexicon, lexical, np.zeros((size, size)), np.zeros(size))
    if size == 1:
        return model
    squares = [np.full_like(x, 1e-2) for x in (weights, lexical, model.transitions, model.first)]
    none = np.zeros(size)
    for _ in range(epochs):
        for _ in range(sequences // batch):
            labels = np.empty((batch, chain), dtype=np.int64)
            words: list[str] = []
            for s in range(batch):
                cuts = sorted(rng.choice(np.arange(2, chain), size=rng.integers(0, 3), replace=False).tolist())
                for lo, hi in zip([0, *cuts], [*cuts, chain], strict=True):
                    k = int(rng.integers(size))
                    at = int(rng.integers(max(1, len(streams[k]) - chain)))
                    part = streams[k][at : at + hi - lo]
                    part += part[:1] * (hi - lo - len(part))
                    words += part
                    labels[s, lo:hi] = k
            lists = [features_of(w) for w in words]
            sizes = np.array(list(map(len, lists)))
            flat = np.fromiter((x for y in lists for x in y), dtype=np.int64, count=int(sizes.sum()))
            scale = 1 / np.sqrt(sizes)
            lex = np.stack([lexicon.get(w, none) for w in words])
            # words count without their entry half of the time, so the lexicon doesn't hide the other features
            lex *= rng.random((len(words), 1)) < 0.5
            potentials = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0) * scale[:, None] + lex @ lexical
            marginals, expected = forward_backward(potentials.reshape(batch, chain, size), np.full(batch, chain), model.transitions, model.first, pairs=True)
            gold = np.eye(size)[labels]
            gap = (gold - marginals).reshape(-1, size)
            into = np.zeros_like(weights)
            np.add.at(into, flat, np.repeat(gap * scale[:, None], sizes, axis=0))
            seen = np.zeros((size, size))
            np.add.at(seen, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
            grads = [into / batch - 1e-5 * weights, lex.T @ gap / batch - 1e-5 * lexical, (seen - expected) / batch - 1e-4 * model.transitions, gap.reshape(batch, chain, size)[:, 0].mean(axis=0)]
            for p, g, q in zip((weights, lexical, model.transitions, model.first), grads, squares, strict=True):
                q += g * g
                p += rate * g / np.sqrt(q)
    model.weights = weights.astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, most: int = LANGUAGES) -> Model | None:
    """The model of at most `sample` rows of each language whose crc32(id) modulo `mod` isn't `held`; None if there are none."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (split_of("id", mod) != held))
    common = known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most).select("label")
    each = max(1, min(sample, TOTAL // max(1, common.count())))
    rows = bounded_sample(known.join(F.broadcast(common), "label", "left_semi"), each, sample_bytes).orderBy("label", "h").collect()  # `each` rows of each language
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row.label, []).append(row.text)
    return fit(texts) if texts else None


class Labeller:
    """Labels texts, remembering the potentials of words; emptied when it holds `most`."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not fresh:
            return
        start = len(self.ids)
        if start + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(fresh)), self.table.shape[1]), dtype=np.float32)])
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            self.table[start + lo : start + lo + len(some)] = self.model.potentials(some)
        self.ids.update(zip(fresh, range(start, start + len(fresh)), strict=True))

    def ids_of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.ids) > self.most:
            self.clear()
        self.learn(words)
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))

    def marginal_sums(self, potentials: list[np.ndarray], chain: int = CHAIN) -> np.ndarray:
        """Sums of the words' marginals of each text, by blocks of `chain` words."""
        n = np.array(list(map(len, potentials)))
        size = len(self.model.languages)
        out = np.zeros((len(n), size))
        blocks = -(-n // chain)
        if not blocks.sum():
            return out
        flat = np.concatenate(potentials)
        owner = np.repeat(np.arange(len(n)), blocks)
        opening = np.cumsum(blocks) - blocks
        within = np.arange(len(owner)) - np.repeat(opening, blocks)
        start = np.repeat(np.cumsum(n) - n, blocks) + within * chain
        lengths = np.minimum(np.repeat(n, blocks) - within * chain, chain)
        transitions = self.model.transitions.astype(np.float32)
        step = np.exp(transitions - transitions.max())
        first = np.exp(self.model.first - self.model.first.max()).astype(np.float32)

        def padded(some: np.ndarray) -> np.ndarray:
            places = start[some][:, None] + np.arange(int(lengths[some].max()))
            values = flat[np.minimum(places, len(flat) - 1)]
            values[np.arange(values.shape[1]) >= lengths[some][:, None]] = 0
            return values

        # messages over whole blocks, from the first block of each chain on and from its last one back
        before = np.broadcast_to(first, (len(owner), size)).copy()
        after = np.ones((len(owner), size), dtype=np.float32)
        at_once, matrices_at_once = max(16, 16_384 // size), max(16, 65_536 // size**2)  # memory alike for few languages and many
        long = np.flatnonzero(blocks[owner] > 1)
        if len(long):
            matrices = np.empty((len(owner), size, size), dtype=np.float32)
            for lo in range(0, len(long), matrices_at_once):
                some = long[lo : lo + matrices_at_once]
                matrices[some] = block_matrices(padded(some), lengths[some], transitions, within[some] == 0)
            chains = np.flatnonzero(blocks > 1)
            chains = chains[np.argsort(-blocks[chains], kind="stable")]
            falling = -blocks[chains]
            message = np.broadcast_to(first, (len(chains), size)).copy()
            for k in range(int(blocks.max()) - 1):
                some = chains[: np.searchsorted(falling, -k - 1, side="left")]  # more than k + 1 blocks
                m = np.einsum("ni,nij->nj", message[: len(some)], matrices[opening[some] + k])
                message = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30)
                before[opening[some] + k + 1] = message @ step
            # the shorter chains join in as the walk comes to their last blocks
            message = np.ones((len(chains), size), dtype=np.float32)
            for k in range(int(blocks.max()) - 1, 0, -1):
                count = np.searchsorted(falling, -k, side="left")  # more than k blocks
                some = chains[:count]
                m = np.einsum("nij,nj->ni", matrices[opening[some] + k], message[:count])
                message[:count] = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30)
                after[opening[some] + k - 1] = message[:count]
        for lo in range(0, len(owner), at_once):
            some = np.arange(lo, min(lo + at_once, len(owner)))
            marginals = forward_backward(padded(some), lengths[some], transitions, self.model.first, before[some], after[some])
            inside = np.arange(marginals.shape[1]) < lengths[some][:, None]
            np.add.at(out, owner[some], (marginals * inside[:, :, None]).sum(axis=1))
        return out

    def label(self, texts: Iterator[str | None], chunk: int = 250_000) -> Iterator[tuple[str, float]]:
        waiting, size = [], 0
        chunk = max(10_000, chunk * 16 // max(16, len(self.model.languages) ** 2))
        for text in texts:
            ids = self.ids_of(text)
            waiting.append(self.table[ids])
            size += len(ids)
            if size >= chunk:
                yield from self._named(waiting)
                waiting, size = [], 0
        yield from self._named(waiting)

    def _named(self, potentials: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        for row in self.marginal_sums(potentials):
            total = row.sum()
            yield (self.model.languages[int(row.argmax())], float(min(1.0, row.max() / total))) if total > 0 else ("und", 0.0)


_LABELLERS: dict[int, Labeller] = {}


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` with the language of each whole text and its share of the words."""
    if model is None:
        return docs.withColumns({lang: F.lit("und"), score: F.lit(0.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        labeller = _LABELLERS.get(id(model))
        if labeller is None or labeller.model is not model:
            _LABELLERS.clear()
            labeller = _LABELLERS[id(model)] = Labeller(model)
        for batch in batches:
            found = list(labeller.label(x.as_py() for x in batch.column(batch.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, lang, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{lang}` string, `{score}` double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    model = train(docs, id_col, text_col, lang_col, mod, held, sample, sample_bytes)
    found = identify(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return found.select(F.col("id").alias(id_col), (split_of("id", mod) == held).alias("held_out"), "lang_pred", "score")
