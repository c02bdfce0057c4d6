"""Toxicity with a convolutional text classifier over hashed word embeddings.

Filters of several widths slide over the words; each keeps its greatest response in the text (max pooling), and
a linear layer scores the responses. All is trained by stochastic gradient descent in numpy on a bounded sample.
The first dimension of the embeddings starts from how much more often a word occurs in toxic texts of one part
of the sample; another part trains, so that chance words of the first are unlearned. Two halves change roles, which
gives two sets of filters side by side; a third part, that neither has seen, calibrates. A word is the sum
of the embeddings of several hashes, as one bucket alone is shared by chance in a long text. A filter is linear
in the embeddings, so for scoring it becomes a table of responses by bucket and position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import bounded, give_back, materialize, small_batches

#: Hashes of a word, buckets of each (bucket 0 of all is the padding), dimensions, filter widths and filters of each in a half.
HASHES, BUCKETS, WIDTH, WIDTHS, FILTERS = 3, 1 << 15, 8, (1, 2, 3), 6
#: Bounds of the training sample: documents of each label, and words of one; of a longer text a run of so many.
PER_LABEL, MAX_WORDS = 2500, 20_000
EPOCHS, RATE, SEED = 6, 0.05, 7
#: Part of the sample that calibrates; the halves of the rest start the embeddings and train.
CALIBRATE = 0.2
#: Part of the gap below the last value taken for toxic that still counts as toxic; below a half, doubt favours a text.
MARGIN = 0.25
#: Toxic calibration documents that a language needs for a threshold of its own.
LEAST_OWN = 8
_TOKEN = re.compile(r"[^\W\d_]+")
#: Words whose buckets a worker remembers.
_MEMORY = 200_000
#: Buckets whose responses are worked out at a time.
_ROWS = 4096


class Encoder:
    """Buckets of a text's lower-cased words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """One row a word, one column a hash."""
        known, out = self.known, []
        if len(known) >= _MEMORY:
            known.clear()
        for w in _TOKEN.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        h = np.array(out, np.uint64)
        bits = np.uint64(BUCKETS.bit_length() - 1)
        return np.stack([((h >> np.uint64(k) * bits) & np.uint64(BUCKETS - 1)).astype(np.int64) + 1 + k * BUCKETS for k in range(HASHES)], axis=1)


@dataclass
class Model:
    """Embeddings, filters by width (position, dimension, filter), their biases, output weights and thresholds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: dict[str, float] = field(default_factory=dict)
    table: np.ndarray | None = None

    def weights(self) -> np.ndarray:
        """All positions of all filters side by side: (dimension, position and filter)."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def fold(self) -> None:
        """Turn the filters into one table: a bucket's row has its response at every position of every filter."""
        weights = self.weights()
        self.table = np.empty((len(self.embedding), weights.shape[1]), np.float32)
        for k in range(0, len(self.embedding), _ROWS):  # all at once would take twice the table besides
            self.table[k : k + _ROWS] = self.embedding[k : k + _ROWS] @ weights

    def responses(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest responses, where): over all windows, the text padded at its end by the widest filter less one."""
        padded = np.concatenate((words, np.zeros((WIDTHS[-1], HASHES), np.int64)))
        if self.table is None:
            each = self.embedding[padded].sum(axis=1) @ self.weights()
        else:
            each = self.table[padded[:, 0]]
            for h in range(1, HASHES):
                each += self.table[padded[:, h]]
        n, at, pooled, where = max(1, len(words)), 0, [], []
        for width, bias in zip(WIDTHS, self.biases, strict=True):
            m = len(bias)
            r = each[:n, at : at + m]
            for j in range(1, width):
                r = r + each[j : j + n, at + j * m : at + (j + 1) * m]
            at += width * m
            best = r.argmax(axis=0)
            pooled.append(np.maximum(r[best, np.arange(m)] + bias, 0))
            where.append(best)
        return np.concatenate(pooled), np.concatenate(where)

    def score(self, words: np.ndarray) -> float:
        """Score of a text's buckets, 0 to 1; 0.5 is the threshold calibrated over all languages."""
        z = float(self.responses(words)[0] @ self.out + self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """z-scores of the log odds that a bucket occurs in a toxic rather than another text; equal texts count once."""
    counts, totals, seen = np.zeros((2, HASHES * BUCKETS + 1)), np.zeros(2), set()
    for words, y in zip(rows, labels, strict=True):
        key = (xxhash.xxh128_digest(words.tobytes()), y)
        if key not in seen:
            seen.add(key)
            counts[y, np.unique(words)] += 1
            totals[y] += 1
    odds = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
    z = odds / np.sqrt(1 / (counts[1] + 1) + 1 / (counts[0] + 1))
    return np.where(counts.sum(axis=0) >= 2, z, 0.0)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Least value to reach for label 1, of the greatest F1 (of equal ones the middle), a part of the way to the next lower value."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    last = np.flatnonzero(np.append(z[:-1] > z[1:], True))
    hits = np.cumsum(y)[last]
    f1 = 2 * hits / (last + 1 + max(1, y.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = last[best[len(best) // 2]]
    return float(z[k] - MARGIN * (z[k] - z[k + 1])) if k + 1 < len(z) else float(z[k] - 1)


def _half(rows: list[np.ndarray], labels: np.ndarray, first: np.ndarray, fit: list[int], seed: int) -> Model:
    """A network whose embeddings start from the rows of first and that is trained on those of fit."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (HASHES * BUCKETS + 1, WIDTH))
    embedding[:, 0] = _start([r for r, k in zip(rows, first, strict=True) if k], labels[first]) / (4 * HASHES)
    embedding[0] = 0
    filters = [rng.normal(0, 0.05, (w, WIDTH, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = abs(f[:, 0, :]) + 0.5 / len(f)
    model = Model(embedding, filters, [np.zeros(FILTERS) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1), -1.0)
    weight = len(fit) / (2 * np.maximum(1, np.bincount(labels[fit], minlength=2))) if fit else np.ones(2)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            words, y = np.concatenate((rows[i], np.zeros((WIDTHS[-1], HASHES), np.int64))), labels[i]
            pooled, where = model.responses(rows[i])
            error = (1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30))) - y) * min(weight[y], 5)
            back = error * model.out * (pooled > 0)
            model.out -= rate * error * pooled
            model.bias -= rate * error
            for k, f in enumerate(model.filters):
                own, at = back[k * FILTERS : (k + 1) * FILTERS], where[k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(f)):
                    seen = words[at + j]
                    step = np.clip(rate * own[:, None] * f[j].T, -0.5, 0.5) / HASHES
                    f[j] -= rate * (own[:, None] * model.embedding[seen].sum(axis=1)).T
                    np.add.at(model.embedding, seen, -np.repeat(step[:, None], HASHES, axis=1))
                model.biases[k] -= rate * own
            model.embedding[0] = 0
    return model


def _beside(a: Model, b: Model) -> Model:
    """One network with the filters of both, each over its own dimensions of the embedding; its score is their mean's."""
    filters = []
    for f, g in zip(a.filters, b.filters, strict=True):
        none = np.zeros_like(f)
        filters.append(np.concatenate((np.concatenate((f, none), axis=1), np.concatenate((none, g), axis=1)), axis=2))
    biases = [np.concatenate(x) for x in zip(a.biases, b.biases, strict=True)]
    out = np.concatenate([x[k * FILTERS : (k + 1) * FILTERS] / 2 for k in range(len(WIDTHS)) for x in (a.out, b.out)])
    return Model(np.concatenate((a.embedding, b.embedding), axis=1), filters, biases, out, (a.bias + b.bias) / 2)


def train(sample: list[tuple[int, str | None, np.ndarray]]) -> Model:
    """Fit to (label, language, buckets) rows. Languages only set thresholds; no score depends on them.

    The hash of its words says which part of the sample a text belongs to, so that copies belong to the same.
    """
    rows = [words for _, _, words in sample]
    labels = np.array([y for y, _, _ in sample], np.int64)
    part = np.array([xxhash.xxh64_intdigest(words.astype("<i4").tobytes(), SEED) / 2**64 for words in rows])
    held = part >= 1 - CALIBRATE
    halves = [part < (1 - CALIBRATE) / 2, (part >= (1 - CALIBRATE) / 2) & ~held] if len(rows) else [np.zeros(0, bool)] * 2
    fits = [[i for i in np.flatnonzero(h) if len(rows[i])] for h in halves]
    model = _beside(_half(rows, labels, halves[0], fits[1], SEED), _half(rows, labels, halves[1], fits[0], SEED + 1))
    model.fold()
    check = [i for i in range(len(rows)) if held[i]] or list(range(len(rows)))
    z = np.array([model.responses(rows[i])[0] @ model.out + model.bias for i in check])
    y = labels[check]
    if y.any():
        model.bias -= (cut := _threshold(z, y))
        for lang in {lang for _, lang, _ in sample if lang is not None}:
            own = np.array([sample[i][1] == lang for i in check])
            if y[own].sum() >= LEAST_OWN:
                model.languages[lang] = float(1 / (1 + np.exp(-np.clip(_threshold(z[own] - cut, y[own]), -30, 30))))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Train on a sample of the labelled rows that learn selects, drawn by the hash of their id.

    About PER_LABEL ids of each label, their different texts, and 4 * PER_LABEL rows at most; of a text of over
    MAX_WORDS words a run of so many, its place drawn by hash. Of several labels of an id the greatest counts; null
    labels and ids without a document are left out, null and empty texts are texts without words. Without labels the
    model scores all texts alike. Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(learn)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.filter("y IN (0, 1)").groupBy("y").count().collect()}
    part = F.when(F.col("y") == 1, min(1.0, PER_LABEL / counts.get(1, 1))).when(F.col("y") == 0, min(1.0, PER_LABEL / counts.get(0, 1)))
    known = materialize(known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < part * 1_000_000), "toxic-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.join(bounded(known, known.count()), "id").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.groupBy("y", "key").agg(F.min("lang").alias("lang"), F.first("text").alias("text"))
    rows = rows.orderBy(F.xxhash64("key"), "y").limit(4 * PER_LABEL).select("y", "lang", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            words = [window(encoder(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("lang"), pa.array([w.astype("<i4").tobytes() for w in words], pa.binary())], names=["y", "lang", "words"])

    got = rows.mapInArrow(encode, "y int, lang string, words binary").collect()
    sample = sorted(((r["y"], r["lang"], np.frombuffer(r["words"], "<i4").reshape(-1, HASHES)) for r in got), key=lambda r: (xxhash.xxh64_intdigest(r[2].tobytes()), r[0], r[1] or ""))
    model = train(sample)
    del got, sample
    give_back()
    return model


def window(words: np.ndarray) -> np.ndarray:
    """The words, or of more than MAX_WORDS a run of so many at a place that their hash draws."""
    if len(words) <= MAX_WORDS:
        return words
    start = xxhash.xxh64_intdigest(np.ascontiguousarray(words).tobytes()) % (len(words) - MAX_WORDS + 1)
    return words[start : start + MAX_WORDS]


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, the columns of keep, score (0 to 1), predicted (score >= 0.5) and rejected.

    Whole texts are scored; null and empty texts are scored as texts without words. rejected compares the same
    score with the threshold of the row's language where calibration gave it one, else with 0.5. Repeated rows
    are scored each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keep = keep or {}
    rows = docs.select(F.col(id_col), *(c.alias(k) for k, c in keep.items()), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    # scoring needs the folded table alone, which travels in half the bytes
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, embedding=model.embedding[:1], table=model.table.astype(np.float16)))
    give_back()
    names = rows.columns[:-2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, m = Encoder(), shared.value
        m.table = m.table.astype(np.float32, copy=False)
        for b in batches:
            s = np.array([m.score(encoder(t.as_py())) for t in b.column("__text")], float)
            cut = np.array([m.languages.get(x.as_py(), 0.5) for x in b.column("__lang")], float)
            arrays = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= cut)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *arrays], names=[*names, "score", "predicted", "rejected"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-2])
    return rows.mapInArrow(score, f"{schema}score double, predicted int, rejected boolean")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the model does not reject, all columns as they are, whatever their names.

    Null and empty texts are judged as texts without words, very long ones whole, repeated rows alike; an empty
    table gives no rows.
    """
    named = {f"c{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(F.lit(0).alias("one"), *(c.alias(k) for k, c in named.items()))
    kept = score_toxicity(rows, model, id_col="one", text_col=place[text_col], lang_col=place[lang_col], keep={k: F.col(k) for k in named})
    return kept.filter(~F.col("rejected")).select(*(F.col(k).alias(c) for c, k in place.items()))
