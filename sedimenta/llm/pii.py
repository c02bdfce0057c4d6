"""Personal data by weak supervision, in DataFrame expressions only.

Four base patterns always count. Looser candidates (numbers in groups, spelled-out addresses, titled names)
are judged by a model: regex, gazetteer and context labelers vote on every candidate and base match of the
corpus; expectation-maximisation over the counts of vote patterns (at most 3^5 a kind) estimates how reliable
each labeler is, and the posterior of every pattern; naive Bayes over span features, trained on the
posteriors, decides on the candidates, so that one whose labelers all abstain is judged too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize
from sedimenta.llm.spans import SPAN, bare, joined, matches, overlaps, redact, spans

# Kinds in the listed order and their patterns. Runs are possessive, and a match of email or ip
# begins at the start of a run, so that long runs cost no more than their length.
BASE = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Candidates of the method, by kind.
ADDED = ("number", "mailtext", "name")
NUMBER = r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9A-Za-z-])"
MAILTEXT = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,24}){1,4}"
NAME = r"(?<![A-Za-z])(?:" + "|".join(_TITLES := (
    "Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Sir", "Dame", "Lady", "Lord", "Rev", "Hon", "Capt", "Sgt", "Herr", "Frau", "Hr", "Fr",
    "Mme", "Mlle", "Me", "Sr", "Sra", "Srta", "Don", "Do\u00f1a", "Sig", "Dott", "Ing", "Pan", "Pani", "Dhr", "Mevr",
)) + r")\.?\x20[A-Z]\p{Ll}{1,30}(?:\x20[A-Z]\p{Ll}{1,30})?"

# Fixed values, gazetteers and context words of the labelers: top-level domains (all of two letters are countries),
# titles, and the country codes of telephone numbers.
DOMAINS = r"(?i)(?:[a-z]{2}|com|net|org|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|cat|post|tel|asia|app|dev|online|shop|site|store|tech|xyz|cloud|blog|email)$"
TITLES = r"^(?:" + "|".join(_TITLES) + r")\b"
CODES = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])[\x20(.-]"
CONTEXT = r"(?i)(?:phone|tel|call|mobile|fax|contact|mail|write|card|visa|ssn|passport|name|dear|from)[\x20.:#=-]{0,4}$"
AGAINST = r"(?i)(?:version|ver|build|page|order|item|part|isbn|section|fig|table|pp?|no|v)[\x20.:#=-]{0,3}$"
LABELERS = ("shape", "digits", "gazetteer", "context", "against")
FEATURES = ("f_kind", "f_digits", "f_groups", "f_length", "f_sep", "f_shape", "f_before")
#: Candidates at least this likely are added.
ACCEPT = 0.5


def _digits(m: Column) -> Column:
    return F.char_length(F.regexp_replace(m, "[^0-9]", ""))


def _shape(m: Column) -> Column:
    """Runs of digits as 9, of letters as a, of anything else as x; eight of them at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"\p{L}+", "a"), r"[^a0-9]+", "x"), r"[0-9]+", "9"), 1, 8)


def _before(before: Column) -> Column:
    """What kind of character stands before a span: none, a letter, a digit, a mark; and whether a space lies between."""
    last = F.right(F.rtrim(before), F.lit(1))
    kind = F.when(last == "", "none").when(F.rlike(last, F.lit(r"\p{L}")), "letter").when(F.rlike(last, F.lit("[0-9]")), "digit").when(F.rlike(last, F.lit("[:=#(]")), last).otherwise("mark")
    return F.concat(kind, F.when(F.endswith(before, F.lit(" ")), F.lit(" ")).otherwise(F.lit("")))


def _octets(m: Column) -> Column:
    return F.rlike(m, F.lit(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$"))


def _card(m: Column) -> Column:
    plain = F.regexp_replace(m, "[ -]", "")
    return F.char_length(plain).between(12, 19) & F.call_function("luhn_check", plain)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind in a text that isn't null."""
    digit = F.rlike(text, F.lit(r"[0-9](?:[\x20-]?+[0-9]){11}"))
    return {
        "email": spans(text, "email", 0, EMAIL, lambda m: F.lit(True), F.contains(text, F.lit("@"))),
        "ip": spans(text, "ip", 1, IP, _octets, F.lit(True)),
        "card": spans(text, "card", 2, CARD, _card, digit),
        "phone": spans(text, "phone", 3, PHONE, lambda m: _digits(m).between(9, 15), F.contains(text, F.lit("+"))),
    }


def candidate_spans(text: Column) -> Column:
    """Spans of the added kinds, before judgement."""
    keep = lambda m: F.lit(True)
    number = spans(text, "number", 4, NUMBER, lambda m: _digits(m).between(7, 15), F.lit(True))
    at = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    return F.concat(number, spans(text, "mailtext", 5, MAILTEXT, keep, at), spans(text, "name", 6, NAME, keep, F.lit(True)))


def _described(found: Column) -> Column:
    """Spans with the labelers' votes (1, -1 or 0 to abstain) and the features of the final classifier."""

    def describe(s: Column) -> Column:
        m, before = s["match"], s["before"]
        digits, numeric = _digits(m), s["kind"].isin("ip", "card", "phone", "number")
        vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
        shape = vote(F.rlike(m, F.lit(r"^(?:\+[0-9]{1,3}\x20)?\(?[0-9]{3}\)?[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}$|@|[\[(]at[\])]")), numeric & F.rlike(m, F.lit(r"^[0-9]{1,2}[.-]|\.[0-9]{1,2}\.")))
        counted = vote(numeric & digits.between(9, 15), numeric & (digits < 8))
        gazetteer = vote(F.rlike(m, F.lit(f"{CODES}|{TITLES}|{DOMAINS}")), s["kind"].isin("email", "mailtext", "name"))
        context = vote(F.rlike(before, F.lit(CONTEXT)), F.lit(False))
        against = vote(F.lit(False), F.rlike(before, F.lit(AGAINST)))
        groups = F.least(F.regexp_count(m, F.lit(r"[\x20.-]")), F.lit(6))
        sep = F.coalesce(F.nullif(F.regexp_extract(m, r"[^0-9A-Za-z]", 0), F.lit("")), F.lit("none"))
        features = (s["kind"], F.least(digits, F.lit(16)).cast("string"), groups.cast("string"), F.least(F.floor(F.char_length(m) / 4), F.lit(10)).cast("string"), F.when(F.rlike(sep, F.lit("^[ -~]+$")), sep).otherwise("other"), _shape(m), _before(before))
        return F.struct(
            F.struct(*(s[k].alias(k) for k in ("start", "rank", "end", "kind"))).alias("span"),
            *(v.cast("int").alias(k) for k, v in zip(LABELERS, (shape, counted, gazetteer, context, against), strict=True)),
            *(v.alias(k) for k, v in zip(FEATURES, features, strict=True)),
        )

    return F.transform(found, describe)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40) -> tuple[float, list[dict], dict]:
    """(prior, reliabilities, posterior by pattern) of a two-class model with independent labelers.

    reliabilities[j] has P(vote of labeler j | class) by (vote, class). Votes are -1, 0 or 1. The start says that
    labelers are right more often than not, which also fixes which class is which.
    """
    names = [p for p, _ in patterns]
    post = {p: 1 / (1 + math.exp(-1.0 * sum(p))) for p in names}
    total = sum(n for _, n in patterns)
    prior, rel = 0.5, [{} for _ in (names[0] if names else ())]
    for _ in range(rounds):
        yes = sum(n * post[p] for p, n in patterns)
        prior = (yes + 1) / (total + 2)
        for j, r in enumerate(rel):
            for v in (-1, 0, 1):
                hit = sum(n * post[p] for p, n in patterns if p[j] == v)
                all_v = sum(n for p, n in patterns if p[j] == v)
                r[v, 1] = (hit + (2 if v == 1 else 1)) / (yes + 4)
                r[v, 0] = (all_v - hit + (2 if v == -1 else 1)) / (total - yes + 4)
        for p in names:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rel[j][v, 1] / rel[j][v, 0]) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return prior, rel, post


def train(described: DataFrame) -> tuple[float, dict[tuple[str, str], float], list[dict]]:
    """(bias, weights, reliabilities): log-odds of the final classifier by (feature, value), from described spans.

    What reaches the driver are counts by vote pattern and by feature value: a few thousand rows at most.
    """
    counts = described.groupBy(*LABELERS).count().collect()
    prior, rel, post = expectation_maximisation([(tuple(r[k] for k in LABELERS), r["count"]) for r in counts])
    if not counts:
        return -1.0, {}, rel
    chance = F.coalesce(*(F.when(F.array(*LABELERS) == F.array(*map(F.lit, p)), F.lit(q)) for p, q in post.items()))
    soft = described.withColumn("p", chance)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES)))
    sums = soft.select("p", pairs.alias("x")).groupBy("x.feature", "x.value").agg(F.sum("p").alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    yes = sum(r["yes"] for r in sums) / len(FEATURES)
    n = sum(r["n"] for r in sums) / len(FEATURES)
    weight = {(r["feature"], r["value"]): math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["n"] - r["yes"] + 1) / (n - yes + 2)) for r in sums}
    return math.log((yes + 1) / (n - yes + 1)), weight, rel


def find_pii(docs: DataFrame, *, text_col: str = "text", accept: float = ACCEPT, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with base (spans by kind), found (sorted spans, base and added) and its columns under "row".

    carry names the columns that are kept, all by default; leaving the text out spares writing it.

    Null text counts as empty and gives no spans. Very long texts are searched whole, in time that grows with their
    length and number of spans. A candidate that touches a base span is not added; accepted candidates of different
    kinds may overlap. Repeated rows are judged alike; an empty table gives no rows. Columns of docs are nested, so
    that no name clashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = (F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))
    rows = docs.select(F.struct(*carried).alias("row"), F.col(text_col).alias("text"))
    by_kind = base_spans(text)
    rows = rows.select("row", "text", F.struct(*(by_kind[k].alias(k) for k in BASE)).alias("base"), candidate_spans(text).alias("loose"))
    described = _described(F.concat(*(F.col(f"base.{k}") for k in BASE), "loose"))
    rows = rows.select("row", F.struct(*(bare(F.col(f"base.{k}")).alias(k) for k in BASE)).alias("base"), described.alias("described"))
    rows = materialize(rows, "pii-spans")
    all_base = F.concat(*(F.col(f"base.{k}") for k in BASE))
    bias, weights, _ = train(rows.select(F.explode("described").alias("d")).select("d.*"))
    cut = math.log(accept / (1 - accept))

    def accepted(d: Column) -> Column:
        score = F.lit(bias)
        for f in FEATURES:
            table = [F.when(d[f] == v, F.lit(w)) for (g, v), w in sorted(weights.items()) if g == f]
            score = score + F.coalesce(*table, F.lit(0.0))
        return d["span"]["kind"].isin(*ADDED) & (score >= cut)

    def apart(d: Column) -> Column:
        touched = [overlaps(F.col(f"base.{k}"), d["span"]["start"], d["span"]["end"]) for k in BASE]
        return ~(touched[0] | touched[1] | touched[2] | touched[3])

    added = F.transform(F.filter(F.col("described"), lambda d: accepted(d) & apart(d)), lambda d: d["span"])
    return rows.select("row", "base", F.array_sort(F.concat(all_base, added)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, base counts, hash of the base spans and all spans, from what find_pii returns."""
    base = F.concat(*(F.col(f"base.{k}") for k in BASE))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redact_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind; spans that overlap become one.

    Null texts stay null, empty and very long ones are handled whole, repeated rows alike; other columns are kept as
    they are, whatever their names; an empty table gives no rows.
    """
    found = find_pii(docs, text_col=text_col)
    text = F.col(f"row.{text_col}")
    clean = F.when(text.isNotNull(), redact(text, F.col("found")))
    return found.select(*((clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


__all__ = ["SPAN", "digest", "find_pii", "matches", "redact_pii"]
