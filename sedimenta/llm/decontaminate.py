"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a window of words that looks at some positions and ignores the others, so that a window
with a replaced word still hits where a mask ignores it. Benchmark windows are hashed under every mask into a
sorted table; documents are scanned against it where they lie. Each hit fixes an item and an offset; along that
diagonal the best segment of equal and replaced words is found and kept if it is long and alike enough.
Benchmark items travel in blocks of a fixed number of words, one block at a time, so the broadcast never grows;
documents are scanned once a block, never shuffled, and a passage that a third of the corpus holds costs no more
than any other. Short items, and all of them in exact mode, have masks that no overlap can escape.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize, small_batches

#: Masks of five words: contiguous, and spaced ones that skip one or two words.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 5, 6), (0, 1, 4, 6, 7))
#: Equal words that a segment needs (their share of an item that has fewer), and their share of its words.
MIN_WORDS, SIMILARITY = 10, 0.8
#: Up to this many words an item has the exact masks.
SHORT_ITEM = 12
#: Words of benchmark items that are compared at a time.
BLOCK_WORDS = 2_000_000
#: Diagonals that hits are turned into at a time.
_HITS = 1 << 20
#: Greatest number of flags, and flags a seed, that tell which hashes a table cannot hold; only speed depends on them.
_FLAGS, _SPARSE = 1 << 22, 32
_TOKEN = re.compile(r"[^\W_]+")


def needed(words: int) -> int:
    """Equal words that an overlap with an item of so many words needs."""
    return min(MIN_WORDS, math.ceil(SIMILARITY * words - 1e-9))


def exact_masks(words: int) -> tuple[tuple[int, ...], ...]:
    """A mask that every overlap with an item of so many words hits.

    Of k equal words among e replaced ones, some ceil(k / (e + 1)) stand side by side. With e at most a quarter of
    k that is 3 or more from 10 words on, and for 6 to 12 words too; of 5 words 2; 4 or fewer all have to be equal.
    """
    return (tuple(range(words if words < 5 else 2 if words == 5 else 3)),)


def masks_of(words: int, exact: bool) -> tuple[tuple[int, ...], ...]:
    return exact_masks(words) if exact or words <= SHORT_ITEM else MASKS


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _TOKEN.findall((text or "").lower())


class Index:
    """Seed hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], exact: bool = False) -> None:
        self.vocabulary: dict[str, int] = {}
        words = [(i, tokens(t)) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.items = [i for i, _ in words]
        self.codes = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64) for _, w in words]
        self.powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(1 + max(m[-1] for m in MASKS))], np.uint64)
        using: dict[tuple[int, ...], list[int]] = {}
        for k, codes in enumerate(self.codes):
            for mask in masks_of(len(codes), exact):
                using.setdefault(mask, []).append(k)
        self.masks, self.tables = list(using), []
        for mask, owned in using.items():
            hashes, owners, places = [], [], []
            for k in owned:
                h, at = self.hashes(self.codes[k], mask)
                hashes.append(h)
                owners.append(np.full(len(at), k))
                places.append(at)
            h, o, p = (np.concatenate(x) for x in (hashes, owners, places))
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], o[order], p[order]))
        self.flags: list[np.ndarray] | None = None

    def products(self, codes: np.ndarray) -> list[np.ndarray]:
        """What each word adds to a hash as the first, second ... word that a mask sees."""
        plain = codes.astype(np.uint64) + np.uint64(1)
        return [plain * p for p in self.powers[: max(map(len, self.masks), default=0)]]

    def hashes(self, codes: np.ndarray, mask: tuple[int, ...], products: list[np.ndarray] | None = None, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the windows whose seen words are all known; with flags only of those that they let pass."""
        n = len(codes) - mask[-1]
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        products = self.products(codes) if products is None else products
        h = products[0][:n].copy()
        for o, p in zip(mask[1:], products[1:], strict=False):
            h += p[o : o + n]
        h ^= h >> np.uint64(29)
        at = np.arange(n) if flags is None else np.flatnonzero(flags[h.view(np.int64) & (len(flags) - 1)])
        for o in mask:
            at = at[codes[at + o] >= 0]
        return h[at], at

    def flagged(self) -> list[np.ndarray]:
        """For each table, whether it holds a hash that ends in these bits; made where it is used, so that it need not travel."""
        if self.flags is None:
            self.flags = []
            for table, _, _ in self.tables:
                flags = np.zeros(min(_FLAGS, 1 << max(16, (_SPARSE * len(table)).bit_length())), bool)
                flags[table.view(np.int64) & (len(flags) - 1)] = True
                self.flags.append(flags)
        return self.flags

    def find(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item, first word in the text, words, equal words, similarity): the best segment of each item in a text."""
        words = tokens(text)
        get = self.vocabulary.get
        codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        products = self.products(codes)
        diagonals: set[tuple[int, int]] = set()
        for mask, (table, owners, places), flags in zip(self.masks, self.tables, self.flagged(), strict=True):
            h, at = self.hashes(codes, mask, products, flags)
            if not len(h) or not len(table):
                continue
            low, high = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            n = (high - low)[hit]
            cuts = np.searchsorted(np.cumsum(n), np.arange(_HITS, n.sum() + 1, _HITS))  # words that both repeat meet often
            for part in np.split(np.arange(len(hit)), cuts):
                m = n[part]
                pick = np.repeat(low[hit[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                found = np.unique(np.stack((owners[pick], np.repeat(at[hit[part]], m) - places[pick]), axis=1), axis=0)
                diagonals.update(map(tuple, found.tolist()))
        best: dict[int, tuple[int, int, int, float]] = {}
        for k, start in diagonals:
            found = self._segment(codes, self.codes[k], start)
            if found and (k not in best or (found[2], -found[0]) > (best[k][2], -best[k][0])):
                best[k] = found
        return [(self.items[k], *best[k]) for k in sorted(best)]

    def _segment(self, codes: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int, float] | None:
        first, last = max(0, -start), min(len(item), len(codes) - start)
        equal = codes[start + first : start + last] == item[first:last]
        # each equal word counts 1 - SIMILARITY, each other one -SIMILARITY: a segment of sum >= 0 is alike enough
        sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - SIMILARITY, -SIMILARITY)))).round(9)
        low = np.minimum.accumulate(sums)
        # the longest alike segment from each end: the first position whose sum is no more than the end's
        begins = np.searchsorted(-low, -sums, "left")
        lengths = np.arange(len(sums)) - begins
        ends = np.flatnonzero(lengths == lengths.max())[:1]
        for end in ends:
            begin = int(begins[end])
            part = np.flatnonzero(equal[begin:end])
            if len(part) >= needed(len(item)):
                begin, end = begin + int(part[0]), begin + int(part[-1]) + 1
                return start + first + begin, end - begin, len(part), len(part) / (end - begin)
        return None


def _blocks(benchmark: DataFrame, limit: int, exact: bool) -> Iterator[Index]:
    """Indexes of items in turn, each of at most about limit words; the driver holds one partition at a time."""
    items: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.toLocalIterator():
        items.append((row["item"], row["text"]))
        size += len(row["text"]) // 4
        if size >= limit:
            yield Index(items, exact)
            items, size = [], 0
    if items:
        yield Index(items, exact)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    exact: bool = False,
) -> DataFrame:
    """One row for every document and benchmark item that overlap, best segment each: id, item, start, words, equal, similarity.

    A segment aligns words of both without gaps; it needs MIN_WORDS equal words (of a shorter item SIMILARITY of its
    words) that make up SIMILARITY of its words. exact leaves no such overlap out; without it items of over
    SHORT_ITEM words are looked for by spaced seeds, which miss few. start counts words of the text from 0. Null and
    empty texts and items overlap nothing; very long ones are compared whole. Repeated rows are reported each, equal
    items by their own ids. Other columns are ignored; either table may be empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, start int, words int, equal int, similarity double"
    found = None
    for index, last in _with_last(_blocks(items, block_words, exact)):
        shared = spark.sparkContext.broadcast(index)
        part = rows.mapInArrow(_scanner(shared), schema)
        if not last:  # the next block takes this one's place in memory
            part = materialize(part, "overlaps")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "words", "equal", "similarity")


def _with_last(blocks: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    """Every block, and whether it is the last."""
    now = next(blocks, None)
    while now is not None:
        after = next(blocks, None)
        yield now, after is None
        now = after


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    exact: bool = False,
) -> DataFrame:
    """The rows of docs that overlap no benchmark item, as contaminated tells, all columns as they are.

    Null and empty texts stay, very long ones are compared whole, repeated rows share their lot; other columns may
    have any names. Either table may be empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = docs.schema
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    for index, last in _with_last(_blocks(items, block_words, exact)):
        shared = spark.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_sieve(shared, schema.fieldNames().index(text_col)), schema)
        if not last:
            docs = materialize(docs, "uncontaminated")
            shared.destroy()
    return docs


def _sieve(index, place):
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not index.value.find(t.as_py()) for t in b.column(place)], pa.bool_()))

    return sieve


def _scanner(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(k, *f) for k, t in enumerate(b.column("text")) for f in index.value.find(t.as_py())]
            if hits:
                rows, *columns = zip(*hits, strict=True)
                kinds = (None, pa.int32(), pa.int32(), pa.int32(), pa.float64())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *arrays], names=["id", "item", "start", "words", "equal", "similarity"])

    return scan
