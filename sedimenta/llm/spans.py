"""Spans of regular expressions in whole texts, as DataFrame expressions.

A span is struct(start, rank, end, kind): code points, end exclusive; rank is the kind's place in the listed
order, so that sorting spans orders them by start, then kind. While a text is at hand spans also have match, their
text, and before, the end of what lies between them and the match before. Work grows with the length of a text and
with its number of spans, times a constant or a logarithm: nothing looks from every span at the whole text or at
all other spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose lengths are added up at once; keeps the work for m matches near m times this.
_BLOCK = 128
#: Code points before a match that are kept, and those of a piece of text that redaction cuts.
REACH, _PIECE = 24, 1024
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For an array of ints, the sum (or another join, of which 0 is neutral) of those before each element."""
    zero = F.lit(0)

    def with_totals(n: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(n) - 1) / _BLOCK).cast("int"))
        return let(F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)), zero, join)), lambda totals: nested(n, totals))

    def nested(n: Column, totals: Column) -> Column:
        # blocks of blocks, so that a million matches still cost some hundred steps each
        before = let(totals, lambda t: _in_blocks(t, join))
        return let(before, lambda by_block: F.transform(n, lambda _, i: join(F.get(by_block, F.floor(i / _BLOCK).cast("int")), F.aggregate(F.slice(n, i - i % _BLOCK + 1, i % _BLOCK), zero, join))))

    return let(values, lambda n: F.when(F.size(n) == 0, n).otherwise(with_totals(n)))


def _in_blocks(totals: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The join of the totals before each, by way of the joins of their own blocks."""
    zero = F.lit(0)
    blocks = F.sequence(zero, F.floor((F.size(totals) - 1) / _BLOCK).cast("int"))
    outer = F.transform(blocks, lambda b: F.aggregate(F.slice(totals, F.lit(1), b * _BLOCK), zero, join))
    return let(outer, lambda o: F.transform(totals, lambda _, i: join(F.get(o, F.floor(i / _BLOCK).cast("int")), F.aggregate(F.slice(totals, i - i % _BLOCK + 1, i % _BLOCK), zero, join))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, match, before)> of a pattern's leftmost non-overlapping matches.

    The pattern is Java's, never matches an empty string, and should be free of nested backtracking. before has the
    last REACH code points between the match before and this one.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(f: Column) -> Column:
        return let(F.transform(f, F.char_length), lambda n: let(gaps, lambda g: shift(f, n, g)))

    def shift(f: Column, n: Column, g: Column) -> Column:
        own = F.transform(F.slice(g, F.lit(1), F.size(n)), lambda x: F.struct(F.char_length(x).alias("n"), F.right(x, F.lit(REACH)).alias("before")))
        return let(own, lambda o: parts(f, n, o))

    def parts(f: Column, n: Column, o: Column) -> Column:
        starts = F.zip_with(_running(F.zip_with(o, n, lambda a, b: a["n"] + b)), o, lambda a, b: F.struct((a + b["n"]).alias("start"), b["before"].alias("before")))
        return F.zip_with(starts, f, lambda s, m: F.struct(s["start"].alias("start"), m.alias("match"), s["before"].alias("before")))

    return let(found, lambda f: F.when(F.size(f) == 0, F.lit(None)).otherwise(place(f)))


def spans(text: Column, kind: str, rank: int, pattern: str, keep: Callable[[Column], Column], hint: Column) -> Column:
    """Spans of kind, with match and before, for the matches that keep accepts; hint is false only for texts without a match."""

    def span(m: Column) -> Column:
        end = m["start"] + F.char_length(m["match"])
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match"), m["before"].alias("before"))

    kept = F.transform(F.filter(matches(text, pattern), lambda m: keep(m["match"])), span)
    kind_of = f"array<{SPAN[:-1]},match:string,before:string>>"
    return F.coalesce(F.when(hint & F.rlike(text, F.lit(pattern)), kept), F.lit(None).cast(kind_of), F.array().cast(kind_of))


def bare(found: Column) -> Column:
    """Spans without match and before."""
    return F.transform(found, lambda s: F.struct(*(s[k].alias(k) for k in ("start", "rank", "end", "kind"))))


def _last_before(found: Column, place: Column) -> Column:
    """Of sorted spans, the last that starts before a place, null if none does; halves the range at every step."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(found) + 1)).cast("int"))
    middle = lambda r: F.floor((r["low"] + r["high"]) / 2).cast("int")

    def halve(r: Column, _: Column) -> Column:
        left = F.get(found, middle(r))["start"] < place
        low = F.when((r["low"] < r["high"]) & left, middle(r) + 1).otherwise(r["low"])
        high = F.when((r["low"] < r["high"]) & ~left, middle(r)).otherwise(r["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.size(found).alias("high"))
    return F.get(found, F.aggregate(steps, whole, halve, lambda r: r["low"]) - 1)


def overlaps(found: Column, start: Column, end: Column) -> Column:
    """Whether start..end shares a code point with one of found: sorted spans that don't overlap each other."""
    return F.coalesce(_last_before(found, end)["end"] > start, F.lit(False))


def crosses(found: Column, start: Column, end: Column) -> Column:
    """Whether one of found lies partly within start..end and partly outside."""
    return F.coalesce(_last_before(found, start)["end"] > start, F.lit(False)) | F.coalesce(_last_before(found, end)["end"] > end, F.lit(False))


def within(found: Column, start: Column, end: Column) -> Column:
    """Whether start..end lies within one of found."""
    return F.coalesce(_last_before(found, start + 1)["end"] >= end, F.lit(False))


def joined(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    text = F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """text[start:end] out of pieces of equal length."""
        first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
        head = F.substring(F.get(pieces, first), start % _PIECE + 1, F.least(end - start, F.lit(_PIECE)))
        rest = F.concat(F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(pieces, last), F.lit(1), end - last * _PIECE))
        return F.when(end <= start, F.lit("")).when(first == last, head).otherwise(F.concat(head, rest))

    def replaced(spans: Column, until: Column) -> Column:
        """until: for each span the greatest end before it."""
        firsts = F.filter(F.zip_with(spans, until, lambda s, u: F.struct(s.alias("s"), u.alias("u"))), lambda x: x["s"]["start"] >= x["u"])
        last = F.greatest(F.element_at(until, -1), F.element_at(spans, -1)["end"])

        def build(pieces: Column) -> Column:
            parts = F.transform(firsts, lambda x: F.concat(cut(pieces, x["u"], x["s"]["start"]), F.lit("<"), F.upper(x["s"]["kind"]), F.lit(">")))
            return F.concat(F.array_join(parts, ""), cut(pieces, last, F.char_length(text)))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), build)

    def ordered(spans: Column) -> Column:
        return let(_running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), lambda until: replaced(spans, until))

    return F.when(F.size(found) == 0, text).otherwise(let(F.array_sort(found), ordered))
