"""URL filter: host and path rules, and for the rest a ratio of two character language models.

The accepted and the rejected model are variable-order Markov models over 64 symbols, each trained on the URLs
that rules or seeds decide; the order of a prediction falls back from two characters to one and none where a
context is rare. A model is a table over all 64^3 trigrams, so its size never grows with the corpus: it travels
as one array value, and pages are judged where they lie, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize
from sedimenta.llm.spans import let

# Verdict, host and path of each rule.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Host words of URLs that train the rejected model beside the rules' own.
SEEDS = (
    r"casino|\bbets?\b|betting|poker|jackpot|lotter[iy]|roulette|slots?\b|pills|pharma|viagra|cialis|diet|weightloss|spam|\bads?-|adserv|banner|popup|tracker|"
    r"clickbait|doubleclick|porn|xxx|\bsex|escort|nude|loan|payday|forex|bitcoin-|crypto-|prize|winner|\bwin\b|giveaway|free-?gift|cheap-|discount-|replica|warez|torrent|crack-|keygen"
)
#: Of the training URLs every so many-th by hash calibrates the cut and trains nothing.
HELD = 4
#: Symbols: 0 the edge of a URL, then those of the text; anything else is the last.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#:%+~,;@!*'()$|[]{}"
BASE = 64
#: Weight of the lower order in the smoothing, and bins of the calibration.
BACKOFF, BINS = 4.0, 200


def _host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = None
    for verdict, name, start in ordered:
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        value = F.struct(F.lit(f"{name}{start}").alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _codes(url: Column) -> Column:
    """Symbols of a URL between two edges at its start and one at its end."""
    chars = F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), ""), lambda c: c != "")
    own = F.transform(chars, _symbol)
    return F.concat(F.array(F.lit(0), F.lit(0)), own, F.array(F.lit(0)))


def _symbol(c: Column) -> Column:
    place = F.instr(F.lit(SYMBOLS), c)
    return F.when(place > 0, place).otherwise(BASE - 1)


def _trigrams(url: Column) -> Column:
    """Codes (first * 64 + second) * 64 + third of all trigrams; a URL of n characters has n + 1."""
    return let(_codes(url), lambda s: F.zip_with(
        F.zip_with(F.slice(s, F.lit(1), F.size(s) - 2), F.slice(s, F.lit(2), F.size(s) - 2), lambda a, b: (a * BASE + b) * BASE),
        F.slice(s, F.lit(3), F.size(s) - 2), lambda ab, c: ab + c))


def _model(grams: DataFrame) -> DataFrame:
    """(code, ratio): log P(third | first, second) of the accepted model less that of the rejected, for all 64^3 codes.

    grams has (label, code, n): at most 2 * 64^3 rows, whatever the corpus.
    """
    labels = ("allow", "block")
    tri = grams.groupBy("code").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"{k}_3") for k in labels))
    third, second = F.col("code") % BASE, F.floor(F.col("code") / BASE) % BASE
    tri = materialize(tri, "url-trigrams")
    bi = tri.groupBy((F.col("code") % (BASE * BASE)).alias("bi")).agg(*(F.sum(f"{k}_3").alias(f"{k}_2") for k in labels))
    uni = tri.groupBy(third.alias("uni")).agg(*(F.sum(f"{k}_3").alias(f"{k}_1") for k in labels))
    ctx2 = tri.groupBy(F.floor(F.col("code") / BASE).alias("ctx2")).agg(*(F.sum(f"{k}_3").alias(f"{k}_c2") for k in labels))
    ctx1 = tri.groupBy(second.alias("ctx1")).agg(*(F.sum(f"{k}_3").alias(f"{k}_c1") for k in labels))
    total = tri.agg(*(F.coalesce(F.sum(f"{k}_3"), F.lit(0)).alias(f"{k}_0") for k in labels))
    codes = tri.sparkSession.range(BASE**3).withColumnRenamed("id", "code")
    codes = codes.withColumns({"bi": F.col("code") % (BASE * BASE), "uni": F.col("code") % BASE, "ctx2": F.floor(F.col("code") / BASE), "ctx1": F.floor(F.col("code") / BASE) % BASE, "one": F.lit(1)})
    for part, key in ((tri, "code"), (bi, "bi"), (uni, "uni"), (ctx2, "ctx2"), (ctx1, "ctx1"), (total.withColumn("one", F.lit(1)), "one")):
        codes = codes.join(F.broadcast(part), key, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")

    def chance(k: str) -> Column:
        p1 = (zero(f"{k}_1") + 1) / (zero(f"{k}_0") + BASE)
        p2 = (zero(f"{k}_2") + BACKOFF * p1) / (zero(f"{k}_c1") + BACKOFF)
        return (zero(f"{k}_3") + BACKOFF * p2) / (zero(f"{k}_c2") + BACKOFF)

    return codes.select("code", (F.ln(chance("allow")) - F.ln(chance("block"))).alias("ratio"))


def judge_urls(
    pages: DataFrame,
    *,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    seeds: str = SEEDS,
) -> DataFrame:
    """Every row of pages, its columns under "row", with host, path, rule, verdict, score and cut.

    score is the log-likelihood of the accepted model less that of the rejected, by character; without a rule, a
    URL is allowed if its score is at least cut, which separates the classes with the least mean error on training
    URLs that the models haven't seen, a part by hash. Null or empty URLs are scored as empty strings, very long
    ones whole, repeated rows alike; without held URLs of both classes all is allowed. Columns of pages are nested,
    so that no name clashes. An empty table gives no rows.
    """
    url = F.col(f"row.`{url_col}`")
    host, path = _host_path(url)
    judged = pages.select(F.struct(*pages.columns).alias("row")).select("row", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", _rule(F.col("host"), F.col("path"), rules))
    label = F.coalesce(F.col("hit.verdict"), F.when(F.rlike("host", F.lit(seeds)), F.lit("block")))
    train = judged.select(label.alias("label"), url.alias("url")).filter("label IS NOT NULL").groupBy("label", "url").agg(F.count(F.lit(1)).alias("n"))
    train = materialize(train.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0), "url-train")
    grams = train.filter("NOT held").select("label", "n", F.explode(_trigrams(F.col("url"))).alias("code")).groupBy("label", "code").agg(F.sum("n").alias("n"))
    table = _model(grams).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("model"))
    table = materialize(table, "url-model")

    def score(u: Column) -> Column:
        both = F.struct("model", _trigrams(u).alias("codes"))
        total = lambda x: F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + F.get(x["model"], c)) / F.size(x["codes"])
        return let(both, total)

    # the model is one value of 64^3 doubles, a scalar of the query
    model, width = table.scalar().alias("model"), 0.05
    bins = train.filter("held").select("*", model).select("label", "n", F.floor(score(F.col("url")) / width).alias("bin"))
    bins = bins.withColumn("bin", F.greatest(F.least("bin", F.lit(BINS // 2)), F.lit(-BINS // 2))).groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    cut = _best_cut([(r["bin"], r["label"], r["n"]) for r in bins]) * width
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= cut, F.lit("allow")).otherwise("block"))
    judged = judged.select("*", model).withColumn("score", score(url))
    return judged.select("row", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score", F.lit(cut).alias("cut"))


def _best_cut(bins: list[tuple[int, str, int]]) -> int:
    """Lowest bin from which URLs are allowed, with the least mean error; of equal ones the middle."""
    total = {k: sum(n for _, label, n in bins if label == k) for k in ("allow", "block")}
    if not all(total.values()):
        return -BINS
    errors = {}
    for cut in range(-BINS // 2, BINS // 2 + 1):
        lost = sum(n for b, k, n in bins if k == "allow" and b < cut) / total["allow"]
        kept = sum(n for b, k, n in bins if k == "block" and b >= cut) / total["block"]
        errors[cut] = round(lost + kept, 12)
    best = [c for c, e in errors.items() if e == min(errors.values())]
    return best[len(best) // 2]
