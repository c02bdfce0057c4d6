"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the character n-grams of every word, its edges marked. The mean of their embeddings goes through a
linear softmax; both are trained by stochastic gradient descent in numpy on a bounded sample. As the model is
linear in the embeddings, embedding and softmax fold into one table of logits by bucket, and a text is scored by
summing rows of it. Each sampled text also gives a fragment of a few words, so that short texts are learned. A
temperature and the score below which a prediction is rejected are calibrated on a part of the sample that
training doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import small_batches

#: Buckets of subwords (a power of two) and dimensions of their embeddings.
BUCKET_BITS, WIDTH = 14, 16
#: Lengths of n-grams, edges included.
GRAMS = (1, 2, 3, 4)
#: Bounds of the training sample: different texts of each language and of all, and the least of each that all have room for.
PER_LANGUAGE, MAX_SAMPLE, LEAST = 400, 2400, 8
EPOCHS, RATE = 12, 0.5
#: Part of the sample kept for calibration, and the accuracy that accepted predictions shall have there.
CALIBRATION, ACCURACY = 0.25, 0.98
#: Most words of a fragment.
FRAGMENT = 16
#: Code points of a text handled at a time.
_CHUNK = 1 << 20
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, a chunk at a time; nothing for a text without a letter."""
    data = (text or "").lower()
    for k in range(0, len(data), _CHUNK):
        points = np.frombuffer(data[k : k + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        if not letter.any():
            continue
        edged = np.concatenate(([0], np.where(letter, points, 0), [0])).astype(np.uint64)
        edged = edged[np.concatenate(([True], (edged[1:] > 0) | (edged[:-1] > 0)))]
        inner = edged > 0
        for n in GRAMS:
            m = len(edged) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            whole = np.ones(m, bool) if n > 2 else inner[:m].copy()
            if n == 2:
                whole |= inner[1 : m + 1]
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + edged[j : j + m]
                if 0 < j < n - 1:
                    whole &= inner[j : j + m]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield (h[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in buckets(text):
        total += np.bincount(b, minlength=len(total))
    at = np.flatnonzero(total)
    return at, total[at]


def fragment(text: str | None) -> str:
    """Up to FRAGMENT words from some place of a text, both chosen by its hash."""
    words = (text or "").split()
    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    start = h % max(1, len(words))
    return " ".join(words[start : start + 1 + (h >> 32) % FRAGMENT])


@dataclass
class Model:
    """Languages, logits by bucket, bias, temperature and the least score that is accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """None for a text without a letter."""
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score, accepted)."""
        own = self.logits(text) if self.languages else None
        if own is None:
            return "und", 0.0, False
        p = softmax(own / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fit a model to (language, key, buckets, counts) rows and calibrate it on every fourth or so of the keys.

    A text and its fragment have one key, its hash, so that no text that calibrates has trained.
    """
    languages = sorted({lang for lang, *_ in sample})
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (len(languages), WIDTH)), np.zeros(len(languages))
    place = {lang: k for k, lang in enumerate(languages)}
    rows = [(place[lang], at, n / n.sum()) for lang, _, at, n in sample if len(at)]
    kept = np.array([key % 2**32 < CALIBRATION * 2**32 for _, key, at, _ in sample if len(at)], bool)
    fit = [r for r, k in zip(rows, kept, strict=True) if not k] or rows
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            y, at, share = fit[i]
            mean = share @ embedding[at]
            error = softmax(weights @ mean + bias)
            error[y] -= 1
            back = weights.T @ error
            weights -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            # a bucket's share of the mean is small, so its step is scaled by the number of distinct buckets
            embedding[at] -= rate * min(len(at), 200) * share[:, None] * back
    model = Model(languages, (embedding @ weights.T).astype(np.float32), bias)
    held = [r for r, k in zip(rows, kept, strict=True) if k] or rows
    if held and languages:
        logits = np.array([share @ model.table[at] + bias for _, at, share in held])
        truth = np.array([y for y, _, _ in held])
        grid = np.geomspace(0.05, 20, 80)
        loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= ACCURACY)
        model.least = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a sample of the rows that learn selects and that have a language, drawn by the hash of their text.

    About PER_LANGUAGE different texts of every language, MAX_SAMPLE of all but LEAST of each, and twice that at
    most; whole texts, however long. Equal texts of a language count once, null and letterless ones teach nothing,
    and a table without a labelled row gives a model that answers und. Other columns don't matter.
    """
    small_batches(docs.sparkSession)
    labelled = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    labelled = labelled.filter("text IS NOT NULL").withColumn("key", F.xxhash64(F.lit("sample"), "text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy("lang").collect()
    each = min(PER_LANGUAGE, max(LEAST, MAX_SAMPLE // max(1, len(counts))))
    part = F.lit(0)
    for r in counts:
        part = F.when(F.col("lang") == r["lang"], F.lit(int(1_000_000 * min(1.0, each / max(1, r["n"]))))).otherwise(part)
    drawn = labelled.filter(F.pmod("key", F.lit(1_000_000)) < part).groupBy("lang", "key").agg(F.first("text").alias("text"))
    rows = drawn.orderBy(F.xxhash64("key"), "lang").limit(2 * each * max(1, len(counts)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [features(t) for t in texts] + [features(fragment(t)) for t in texts]
            arrays = [pa.array([f[k].astype("<i4").tobytes() for f in found], pa.binary()) for k in (0, 1)]
            names = [pa.array(b.column(c).to_pylist() * 2, t) for c, t in (("lang", pa.string()), ("key", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*names, *arrays], names=["lang", "key", "at", "n"])

    got = rows.mapInArrow(count, "lang string, key long, at binary, n binary").collect()
    rows = sorted((r["lang"], r["key"], bytes(r["at"]), bytes(r["n"])) for r in got)
    return train([(lang, key // 1_000_000, *(np.frombuffer(x, "<i4").astype(np.int64) for x in found)) for lang, key, *found in rows])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, the columns of keep, lang_pred, score (0 to 1) and accepted.

    Whole texts are scored, very long ones in pieces. lang_pred is und, with score 0 and not accepted, if the text is null or has no letter
    or if no language was learned; else the likeliest learned language, of equal ones the first. Repeated rows are
    scored each; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keep = keep or {}
    rows = docs.select(F.col(id_col), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column("__text")]
            arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *arrays], names=[*names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double, accepted boolean")
