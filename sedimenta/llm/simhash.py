"""SimHash near-duplicate detection with anchor points of a covering code.

The anchors are the words of a product code over 61 of the 64 fingerprint bits: two perfect Golay codes of
length 23 (covering radius 3) and one perfect Hamming code of length 15 (radius 1), 2^35 anchors in all. The
nearest anchor of a fingerprint, within the covering radius, is its home. A fingerprint visits every anchor
within covering radius plus threshold: if x and y differ in t bits, then y is at most t further than x from the
home of x, so y visits it. Fingerprints are compared only at an anchor that is the home of one of them, each
pair once. A fingerprint has 1 home and about 150 visits, whatever the number of documents.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import bounded, discard, materialize, small_batches
from sedimenta.llm.components import connected_components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Shingles hashed and counted, and bytes split into words, at a time.
_CHUNK = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_POWERS = (np.empty(0, np.uint64), np.empty(0, np.uint64))
#: Bits of the code blocks, from bit 0 of the fingerprint; generator polynomials of the Golay and the Hamming code.
BLOCKS = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1))
#: For similarity rather than bits: 64-bit words of a fingerprint, tables, and the perfect Hamming code that covers
#: the 31 bits of a table with 2^26 anchors.
WORDS, TABLES, TABLE_CODE = 8, 48, ((31, 0b100101, 1),)
#: Words of a shingle and Jaccard similarity from which texts are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Standard deviations of chance by which a fingerprint's bits may exceed what the similarity lets differ.
CHANCE = 6
#: Rarest shared shingles of a text by which a pair is told to have met before. Only speed depends on them.
FIRST = 32
#: About so many documents tell which shingles are frequent, and so many shingles are told. Only speed depends on them.
SAMPLE, FREQUENT = 4000, 50_000


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, A-Z lower-cased, a chunk at a time; of all words if they are fewer."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    ends = (starts[width : width + n] - 1).tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        pairs = zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK], strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def _majority(hashes: Iterator[np.ndarray], words: int) -> np.ndarray:
    """Bits, lowest first, that over half of the hashes set; hashes have one 64-bit word, mixed to as many as asked."""
    counts, n = np.zeros(64 * words, np.int64), 0
    for h in hashes:
        n += len(h)
        wide = h[:, None] if words == 1 else _mixed(h[:, None], np.arange(words, dtype=np.uint64))
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return counts * 2 > n if n else np.zeros(64 * words, bool)


def _mixed(h: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Another 64 bits of a hash, by k odd steps and a multiply-shift mix."""
    h = h + np.asarray(k, np.uint64) * np.uint64(_ODD)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles as a signed integer; 0 for a text without words."""
    bits = _majority(shingle_hashes(text, shingle, seed), 1)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of each at least."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        _POWERS = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64)))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased: polynomials of their bytes, taken as differences of running sums."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").lower(), 0, [np.empty(0, np.uint64)]
    while at < len(data):
        cut = _SPACE.search(data, at + _CHUNK)  # a word is never cut
        end = cut.start() if cut else len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = (x != 32) & ((x < 9) | (x > 13))
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(len(x))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=sums[1:])
        out.append(_mixed((sums[ends] - sums[starts]) * inverse[starts], 1))
        at = end
    return np.concatenate(out)


def distinct_shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct hashes, sorted, of runs of word hashes; of all words if they are fewer. Nothing for no words."""
    if not len(words):
        return words
    width = min(shingle, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        h = h * np.uint64(_ODD) + words[j : j + len(h)]
    h = np.sort(_mixed(h, 1))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def wide_fingerprint(words: np.ndarray, shingle: int, wide: int = WORDS) -> np.ndarray:
    """64-bit words of a SimHash over the distinct shingles of word hashes, so that repeated lines don't outweigh the rest."""
    distinct = distinct_shingles(words, shingle)
    bits = _majority((distinct[k : k + _CHUNK] for k in range(0, len(distinct), _CHUNK)), wide)
    return np.packbits(bits, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) of every document; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), fps], names=["id", "fp"])

    return rows.mapInArrow(batch, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _remainder(words: np.ndarray, length: int, generator: int) -> np.ndarray:
    """Syndrome: the remainder of words, as polynomials over GF(2), by the generator."""
    words, degree = words.copy(), generator.bit_length() - 1
    for k in range(length - 1, degree - 1, -1):
        words ^= np.where(words >> k & 1, generator << (k - degree), 0)
    return words


@functools.lru_cache(maxsize=8)
def _errors(length: int, generator: int, radius: int, extra: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For excess 0 to extra: (offsets, counts, patterns), the error patterns of each syndrome in CSR form.

    Excess 0 has patterns of weight up to the radius, excess k those of weight radius + k. Each pattern added to
    a word of its syndrome gives a code word at that distance.
    """
    out = []
    for k in range(extra + 1):
        weights = range(radius + 1) if k == 0 else [radius + k]
        patterns = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(length), w)], np.int64)
        syndromes = _remainder(patterns, length, generator)
        order = np.argsort(syndromes, kind="stable")
        counts = np.bincount(syndromes, minlength=1 << (generator.bit_length() - 1))
        out.append((np.concatenate(([0], np.cumsum(counts)[:-1])), counts, patterns[order]))
    return out


def anchors(fps: np.ndarray, threshold: int, code: tuple[tuple[int, int, int], ...] = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, anchor) for every anchor within the covering radius plus threshold, by block."""
    blocks, shift = [], 0
    for length, generator, radius in code:
        words = fps >> shift & ((1 << length) - 1)
        blocks.append((shift, words, _remainder(words, length, generator), _errors(length, generator, radius, threshold)))
        shift += length
    rows, found = [], []
    for excess in itertools.product(range(threshold + 1), repeat=len(blocks)):
        if sum(excess) > threshold:
            continue
        row, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for (at, words, syndromes, errors), e in zip(blocks, excess, strict=True):
            offsets, counts, patterns = errors[e]
            n = counts[syndromes[row]]
            start = np.repeat(np.cumsum(n) - n, n)
            row, anchor = np.repeat(row, n), np.repeat(anchor, n)
            pick = patterns[offsets[syndromes[row]] + np.arange(len(row)) - start]
            anchor |= (words[row] ^ pick) << at
        rows.append(row)
        found.append(anchor)
    return np.concatenate(rows), np.concatenate(found)


def _at_anchors(fps: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp): homes for threshold 0, else visits."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("fp").to_numpy(zero_copy_only=False)
            row, anchor = anchors(own, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(batch, "anchor long, fp long")


def near_links(fps: DataFrame, threshold: int) -> DataFrame:
    """(a, b) for every two distinct fingerprints at most threshold bits apart, once.

    Spark takes the visits to be as few as the fingerprints and would send them all through the driver, so the join is
    told to shuffle.
    """
    small_batches(fps.sparkSession)
    home = _at_anchors(fps, 0).withColumnRenamed("fp", "a")
    visit = _at_anchors(fps, threshold).withColumnRenamed("fp", "b").hint("merge")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return home.join(visit, (home.anchor == visit.anchor) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2
) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id and n_links.

    Documents link if their fingerprints differ in at most threshold bits; component_id is the smallest id
    reachable, null only if all ids there are null; n_links counts the other distinct fingerprints linked.
    Texts that are null or have no word have fingerprint 0. Equal texts and repeated rows share a fingerprint,
    which is compared once. Extra columns are ignored; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    groups = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    links = materialize(near_links(groups, threshold), "simhash-links")
    roots = connected_components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    known = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(ends, "fp", "left")
    known = materialize(known.withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = materialize(known.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    labels = known.join(least, "root").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    labels = materialize(labels, "simhash-labels")
    return fps.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def _names(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def table_words(wide: np.ndarray, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """(text, table): the bits of wide fingerprints that each table looks at, 31 of them drawn once and for all."""
    length, rng = TABLE_CODE[0][0], np.random.default_rng(seed)
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little")
    powers = 1 << np.arange(length, dtype=np.int64)
    picks = [rng.choice(64 * WORDS, length, replace=False) for _ in range(tables)]
    return np.stack([bits[:, p].astype(np.int64) @ powers for p in picks], axis=1)


def most_differing(similarity: float, words: int = WORDS) -> int:
    """Bits in which fingerprints of texts so alike differ at most, but for chance.

    A block replaced leaves the shingle sets at a cosine of 2s / (1 + s), the least that a Jaccard similarity s
    allows; each bit then differs with the angle's share of a half turn.
    """
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * words
    return min(n, math.floor(n * part + CHANCE * math.sqrt(n * part * (1 - part))))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles of SHINGLE words, sorted."""
    return distinct_shingles(word_hashes(text), SHINGLE)


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several documents of a sample hold, sorted by hash; they only order shingles."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("text").mapInArrow(batch, "h long")
    top = sample.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    top = np.array([(r.h, r["count"]) for r in top], np.int64).reshape(-1, 2)
    hashes = np.ascontiguousarray(top[:, 0]).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top[order, 1]


def rarest(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a text, rarest first, of which two texts alike share one at least: all but similarity of them, and one more.

    Any order that is the same for all texts will do; that of frequency keeps boilerplate last.
    """
    if not len(own):
        return own
    hashes, counts = frequent
    rank = np.zeros(len(own), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        rank = np.where(hashes[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]


def _described(docs: DataFrame, shingle: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(row, s0, s1, n, rare, w0, w1 ...): hashes and size of the shingle set, its rarest shingles, wide fingerprint."""
    small_batches(docs.sparkSession)
    names = _names(WORDS)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide, sets, sizes, rare = [], [], [], []
            for t in b.column("text"):
                words = word_hashes(t.as_py())
                own = distinct_shingles(words, SHINGLE)
                wide.append(wide_fingerprint(words, shingle))
                sets.append([xxhash.xxh64_intdigest(own.tobytes(), k) for k in (1, 2)])
                sizes.append(len(own))
                rare.append(rarest(own, frequent, similarity).view(np.int64))
            wide = np.array(wide, np.int64).reshape(-1, WORDS)
            sets = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [b.column("row"), *(pa.array(sets[:, k]) for k in range(2)), pa.array(sizes, pa.int64()), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(wide[:, k]) for k in range(WORDS))], names=["row", "s0", "s1", "n", "rare", *names])

    return docs.mapInArrow(batch, ", ".join(["row long, s0 long, s1 long, n long, rare array<long>", *(f"{w} long" for w in names)]))


def _at_tables(nodes: DataFrame, tables: int) -> DataFrame:
    """(h, node): the anchor of every table within whose covering radius a wide fingerprint lies; one, as the code is perfect."""
    names = _names(WORDS)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.stack([b.column(w).to_numpy(zero_copy_only=False) for w in names], axis=1)
            own = b.column("node").to_numpy(zero_copy_only=False)
            for t, bits in enumerate(table_words(wide, tables).T):
                row, anchor = anchors(bits, 0, TABLE_CODE)
                yield pa.RecordBatch.from_arrays([pa.array(anchor | (t << TABLE_CODE[0][0])), pa.array(own[row])], names=["h", "node"])

    return nodes.select("node", *names).mapInArrow(batch, "h long, node long")


def _sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, set) of the asked texts."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t.as_py()).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("row"), sets], names=["node", "set"])

    return texts.join(bounded(asked, asked.count()), "row").mapInArrow(batch, "node long, set array<long>")


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose whole texts have that Jaccard similarity: the exact check that follows any search."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "similar-asked")
    sets = materialize(_sets(texts, asked), "similar-texts")
    discard(asked)
    one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}s")) for x in "ab")
    common, both = F.size(F.array_intersect("as", "bs")), F.size("as") + F.size("bs")
    links = materialize(pairs.join(one, "a").join(two, "b").filter(common * (1 + similarity) >= both * F.lit(similarity) - 1e-9).select("a", "b"), "similar-links")
    discard(sets)
    return links


def _near(most: int) -> Column:
    """Whether fingerprints a.w0 ..., b.w0 ... differ in at most that many bits."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in _names(WORDS))) <= most


def _can_reach(similarity: float) -> Column:
    """Whether sets a, b whose first common shingle is this one, at a.pos and b.pos of their orders, can be so alike.

    All their common shingles then lie from there on, and similarity asks for a share of both sizes.
    """
    common = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return common * (1 + similarity) >= (F.col("a.n") + F.col("b.n")) * F.lit(similarity) - 1e-9


def _first_met() -> Column:
    """Whether a.h is the first shingle that a and b share, as far as the first ones of both tell; if they tell nothing, true."""
    common = F.array_intersect("a.first", "b.first")
    return (F.size(common) == 0) | (F.try_element_at(common, F.lit(1)) == F.col("a.h"))


def similar_groups(
    docs: DataFrame, *, id_col: str, text_col: str = "text", shingle: int = 3, similarity: float = SIMILARITY, tables: int = TABLES, rest: bool = True
) -> DataFrame:
    """(node, root) of the documents that a smaller id makes redundant; ids are unique longs.

    Texts link if the Jaccard similarity of their five-word shingles reaches similarity, which is checked on the
    whole texts of every pair that a search proposes. Two searches propose pairs:

    1. Anchors. Every table looks at 31 bits of the wide SimHash; a text goes to the anchor of a covering code
       within whose radius those bits lie. At an anchor every text is compared with the least one.
    2. The rest (rest=True), as anchors alone may miss some. Two texts so alike share one of their rarest shingles,
       a fifth of each text's and one more, in any order common to all. Any two that share one, that the first
       search left in different groups and whose fingerprints don't differ by more than similarity and CHANCE
       standard deviations allow, are compared: at the first shingle that they share, if enough shingles follow it
       in both for that similarity. A pair goes uncompared only if it is in one group already.

    Neither search has a cap, and nothing depends on the number of documents. Equal shingle sets are one node
    throughout, so that groups of copies cost one text. Null texts and texts without words are alike. A text of
    fewer than five words is one shingle. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    names, most = _names(WORDS), most_differing(similarity)
    fps = materialize(_described(docs, shingle, _frequent(docs, docs.count()), similarity), "similar-sets")
    members = materialize(fps.select("row", "s0", "s1"), "similar-rows")
    least = materialize(members.groupBy("s0", "s1").agg(F.min("row").alias("node")), "similar-least")
    nodes = materialize(fps.filter("n > 0").join(least.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "rare", *names), "similar-nodes")
    discard(fps)
    prints = nodes.select("node", *names)

    def close(pairs: DataFrame) -> DataFrame:
        told = pairs.join(prints.alias("a"), F.col("x") == F.col("a.node")).join(prints.alias("b"), (F.col("y") == F.col("b.node")) & _near(most))
        return told.select(F.col("x").alias("a"), F.col("y").alias("b"))

    held = _at_tables(prints, tables).repartition("h")
    rep = held.groupBy("h").agg(F.min("node").alias("rep"), F.max("node").alias("last")).filter("rep < last").select("h", "rep")
    pairs = materialize(held.join(rep, "h").filter("node <> rep").select(F.col("node").alias("x"), F.col("rep").alias("y")).distinct(), "similar-met")
    links = _alike(materialize(close(pairs), "similar-pairs"), docs, similarity)
    if rest:
        roots = materialize(connected_components(links), "similar-roots")
        rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", F.posexplode("rare").alias("pos", "h"))
        rooted = rooted.repartition("h")
        mixed = rooted.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("last")).filter("least < last").select("h")
        shared = materialize(rooted.join(mixed, "h"), "similar-shared")
        first = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "h"))), 1, FIRST)["h"].alias("first"))
        held = materialize(shared.join(first, "node").join(prints, "node"), "similar-open")
        discard(shared)
        apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
        more = held.alias("a").join(held.alias("b"), apart & _can_reach(similarity) & _near(most) & _first_met())
        more = more.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
        more = materialize(more.join(links, ["a", "b"], "left_anti"), "similar-rest")
        discard(held)
        links = links.unionByName(_alike(more, docs, similarity))

    roots = connected_components(links)
    grouped = least.join(roots, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    grouped = materialize(grouped, "similar-members")
    discard(nodes)
    return members.join(grouped, ["s0", "s1"]).filter("row <> root").select(F.col("row").alias("node"), "root")


def without_duplicates(docs: DataFrame, *, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, the first as docs lie, with all its columns.

    Rows are numbered, so that null and repeated ids don't matter: of repeated rows, too, one stays. Texts that
    are null or have no word are alike. Very long texts are compared whole. Other columns are kept as they are,
    whatever their names; an empty table gives no rows.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "dedup-rows")
    texts = rows.select("row", F.col(f"doc.`{text_col}`").alias("text"))
    gone = materialize(similar_groups(texts, id_col="row", similarity=similarity).select(F.col("node").alias("row")), "dedup-gone")
    return rows.join(bounded(gone, gone.count()), "row", "left_anti").select("doc.*")
