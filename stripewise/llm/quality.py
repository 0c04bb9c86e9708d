"""A quality classifier on random-indexing word vectors.

Every token has a sparse index vector of random signs, fixed by its hash. A token's vector is the sum of the index vectors
of its neighbours in the training texts, normalised; a document is pooled as the mean and the spread of its tokens'
vectors, beside a few shares of surface forms. A network of two layers turns that into a logit, and a temperature fitted on rows that the
training did not see turns the logit into a probability.

The model is fitted on the driver on at most `sample` labelled rows and `sample_bytes` of their text, chosen by a hash among those
that have a document and are not held out; both bounds are parameters. Tokens that the sample lacks take their own index vector
by shape. Scoring reads every whole text, in batches, and very long ones in pieces that end at white space.

Defined results: null and empty texts are scored like texts without tokens; rows of one id are scored each by its own text; if no
label can be learned from (none, or one class only), scores are the share of label 1, or 0.5; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import bounded_sample, split_of

DIM = 64
SPARSE = 4
#: Rows to fit on at most, and bytes of their texts. Characters of a piece of a long text.
SAMPLE, SAMPLE_BYTES = 5000, 64 << 20
PIECE = 200_000
#: Of the fitted rows, every so many are kept from training, for the temperature.
CALIBRATION = 5

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACE = re.compile(r"\s")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_vectors(hashes: np.ndarray, dim: int = DIM, sparse: int = SPARSE) -> np.ndarray:
    """Random-sign vectors with `sparse` entries, fixed by the hashes."""
    out = np.zeros((len(hashes), dim), dtype=np.float32)
    rows = np.arange(len(hashes))
    for k in range(sparse):
        bits = _mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        np.add.at(out, (rows, (bits % np.uint64(dim)).astype(np.int64)), np.where(bits >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


def shape_of(token: str) -> str:
    """A coarse form: runs of capitals, small letters, digits and other signs, with a mark for length."""
    kind = "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x" if token[0].isalpha() else "9" if token[0].isdigit() else token[0]
    return f"{kind}{min(len(token), 8) // 2}"


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


class Vectors:
    """Token vectors by token, with the vectors of shapes for tokens that the model doesn't know."""

    def __init__(self, model: Model):
        self.model = model
        self.ids: dict[str, int] = dict(model.vocabulary)
        self.shapes = {s: k for s, k in model.shapes.items()}

    def id_of(self, token: str) -> int:
        k = self.ids.get(token)
        if k is None:
            k = self.shapes.get(shape_of(token), len(self.model.vectors) - 1)
            if len(self.ids) < 300_000:
                self.ids[token] = k
        return k

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean and spread of the tokens' vectors, and the surface shares."""
        get, learn = self.ids.get, self.id_of
        surface, parts, times, total = Surface(), [], [], 0
        for piece in pieces_of(text or ""):
            tokens = tokens_of(piece)
            if tokens:
                ids, counts = np.unique(np.fromiter((k if (k := get(t)) is not None else learn(t) for t in tokens), dtype=np.int64, count=len(tokens)), return_counts=True)
                parts.append(ids)
                times.append(counts)
                total += len(tokens)
            surface.add(piece, tokens)
        if not total:
            return np.zeros(2 * DIM + 8, dtype=np.float32)
        some, counts = parts[0], times[0]
        if len(parts) > 1:
            some, where = np.unique(np.concatenate(parts), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate(times))
        weights = counts.astype(np.float32) / total
        vectors = self.model.vectors[some]
        mean = weights @ vectors
        spread = np.sqrt(np.maximum(weights @ (vectors * vectors) - mean * mean, 0))
        return np.concatenate([mean, spread, surface.shares()]).astype(np.float32)


def pieces_of(text: str, size: int | None = None) -> Iterator[str]:
    """The text in pieces of about `size` characters that end at white space, so that no token is cut."""
    size = size or PIECE
    at = 0
    while at < len(text):
        if len(text) - at <= size:
            yield text[at:]
            return
        end = _SPACE.search(text, at + size)
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end


class Surface:
    """Shares that the order of tokens and their case hold, each between 0 and 1, of a text given piece by piece."""

    def __init__(self) -> None:
        self.tokens = self.words = self.capital = self.same = self.letters = self.length = self.lines = 0
        self.last: str | None = None
        self.distinct: set[str] = set()

    def add(self, text: str, tokens: list[str]) -> None:
        words = [t for t in tokens if t[0].isalnum() or t[0] == "_"]
        self.tokens += len(tokens)
        self.words += len(words)
        self.capital += sum(map(str.isupper, words))
        self.same += sum(map(str.__eq__, words[1:], words)) + bool(words and words[0] == self.last)
        self.letters += sum(map(len, words))
        self.length += len(text)
        self.lines += text.count("\n")
        self.distinct.update(words)
        self.last = words[-1] if words else self.last

    def shares(self) -> np.ndarray:
        m = max(1, self.words)
        return np.array(
            [
                (self.tokens - self.words) / self.tokens,
                self.capital / m,
                self.same / m,
                len(self.distinct) / m,
                min(1.0, self.letters / m / 12),
                self.letters / self.length,
                min(1.0, self.lines / m),
                min(1.0, m / 200),
            ],
            dtype=np.float32,
        )


@dataclass
class Model:
    vocabulary: dict[str, int]
    shapes: dict[str, int]
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        # rounded, since the last bits of a product depend on how many rows share the batch
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50))), 9)


def learn_vectors(texts: list[str], vocabulary_size: int = 50_000, window: int = 2, least: int = 3) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """Vocabulary, shapes and vectors; the last vector, of what is unknown altogether, is zero."""
    import xxhash

    # texts become arrays of token numbers one by one: the driver never holds all their tokens as strings
    seen: dict[str, int] = {}
    streams = [np.array([seen.setdefault(t, len(seen)) for t in tokens_of(text)], dtype=np.int32) for text in texts]
    names = list(seen)
    totals = np.bincount(np.concatenate([*streams, np.zeros(0, np.int32)]), minlength=len(names))
    common = sorted(np.flatnonzero(totals >= least).tolist(), key=lambda k: (-totals[k], names[k]))[:vocabulary_size]
    shapes = sorted({shape_of(t) for t in names})
    vocabulary = {names[t]: k for k, t in enumerate(common)}
    shape_ids = {s: len(common) + k for k, s in enumerate(shapes)}
    form_of = np.array([shape_ids[shape_of(t)] for t in names], dtype=np.int64)
    id_of = form_of.copy()
    id_of[common] = np.arange(len(common))
    rows = len(common) + len(shapes) + 1
    names = [*(names[t] for t in common), *(f"\0{s}" for s in shapes), "\0"]
    index = index_vectors(np.array([xxhash.xxh64_intdigest(t) for t in names], dtype=np.uint64))
    context = np.zeros((rows, DIM), dtype=np.float64)
    for stream in streams:
        if len(stream) < 2:
            continue
        form, ids = form_of[stream], id_of[stream]
        for step in range(1, window + 1):
            if len(ids) > step:
                left, right = ids[:-step], ids[step:]
                for a, b in ((left, right), (right, left)):
                    add = index[b]
                    order = np.argsort(a, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0])
                    context[a[order][starts]] += np.add.reduceat(add[order], starts, axis=0)
                # shapes learn from all tokens of the form
                for a, b in ((form[:-step], right), (form[step:], left)):
                    order = np.argsort(a, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0])
                    context[a[order][starts]] += np.add.reduceat(index[b][order], starts, axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (context / np.maximum(norm, 1e-9) + 0.5 * index / np.sqrt(SPARSE)).astype(np.float32)
    vectors[-1] = 0
    return vocabulary, shape_ids, vectors


def fit(texts: list[str], labels: list[int], hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Vectors, network and temperature; of both classes the network sees equal weight no more than the data give."""
    y = np.array(labels, dtype=np.float64)
    width = 2 * DIM + 8
    blank = dict(centre=np.zeros(width), scale=np.ones(width), w1=np.zeros((width, hidden)), b1=np.zeros(hidden), w2=np.zeros(hidden), b2=0.0, temperature=1.0)
    if len(set(labels)) < 2:
        return Model({}, {}, np.zeros((1, DIM), np.float32), constant=float(y.mean()) if len(y) else 0.5, **blank)
    vocabulary, shapes, vectors = learn_vectors(texts)
    model = Model(vocabulary, shapes, vectors, **blank)
    pool = Vectors(model)
    x = np.stack([pool.pooled(t) for t in texts]).astype(np.float64)
    held = np.arange(len(y)) % CALIBRATION == 0
    train = ~held if len(set(y[~held])) == 2 else np.ones(len(y), bool)
    model.centre, model.scale = x[train].mean(0), x[train].std(0) + 1e-3
    z, t = (x[train] - model.centre) / model.scale, y[train]

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 64):
            some = order[lo : lo + 64]
            h = np.tanh(z[some] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50)))
            d = (p - t[some]) / len(some)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[some].T @ back + decay * params[0], back.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])

    if held.any():
        logits, target = model.logits(x[held]), y[held]
        losses = {c: float(np.mean(np.logaddexp(0, logits / c) - target * logits / c)) for c in np.exp(np.linspace(-2, 3, 101))}
        model.temperature = float(min(losses, key=losses.get))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, held: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of at most `sample` labelled rows whose crc32(id) modulo `mod` isn't `held`."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(split_of("id", mod) != held)
    # labels without a document don't use up the sample; ids alone are read for this
    present = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    present = present.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(present), "id")  # 2 * `sample` rows
    rows = bounded_sample(rows.withColumn("all", F.lit(0)), sample, sample_bytes, group="all").orderBy("h").collect()
    return fit([r.text for r in rows], [r.label for r in rows])


_POOLS: dict[int, Vectors] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the score of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        pool = _POOLS.get(id(model))
        if pool is None or pool.model is not model:
            _POOLS.clear()
            pool = _POOLS[id(model)] = Vectors(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            x = np.stack([pool.pooled(t.as_py()) for t in texts]) if batch.num_rows else np.zeros((0, len(model.centre)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, held: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    model = train(docs, labels, id_col, text_col, mod=mod, held=held, sample=sample, sample_bytes=sample_bytes)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return scored.select(F.col("id").alias(id_col), (split_of("id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
