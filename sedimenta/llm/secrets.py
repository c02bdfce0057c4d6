"""Secrets, told apart from widely copied examples by how many repositories and owners hold them.

Three base patterns always count. Looser candidates (long mixed tokens, bearer tokens, private key headers) are
added only where the corpus speaks for a live credential: the hash of the value is aggregated over the corpus
by distinct repositories and distinct owners, and values that many owners hold are examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize
from sedimenta.llm.spans import SPAN, bare, crosses, joined, let, matches, overlaps, spans, within

# Kinds in the listed order and their patterns, with possessive runs.
BASE = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

# Candidates of the method, by kind.
ADDED = ("bearer", "pem", "mixed")
BEARER = r"(?<![A-Za-z])Bearer\x20++[A-Za-z0-9._~+/-]{16,}+=*+"
# A key up to its END line, or without one the lines of base64 that follow; line ends may be escaped.
PEM = (
    r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----(?:[\s\\nr]*+[A-Z][A-Za-z-]{1,30}:[^\r\n\\]*+){0,8}+"
    r"(?:[A-Za-z0-9+/=\s\\]*+-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----|(?:(?:\s|\\[nr]){0,4}+[A-Za-z0-9+/]{16,}+=*+){0,512}+)"
)
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+=*+"
#: A value with more owners or repositories than this is an example.
MAX_OWNERS, MAX_REPOS = 1, 3


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind in a text that isn't null."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    every = lambda m: F.lit(True)
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return {
        "assign": spans(text, "assign", 0, ASSIGN, value, sign),
        "access": spans(text, "access", 1, ACCESS, every, F.contains(text, F.lit("AKIA"))),
        "hex": spans(text, "hex", 2, HEX, every, F.lit(True)),
    }


def candidate_spans(text: Column) -> Column:
    """Spans of the added kinds, before the corpus is asked."""
    every = lambda m: F.lit(True)
    classes = lambda m: F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[A-Z]")) & (F.regexp_count(m, F.lit("[0-9]")) >= 3)
    keys = spans(text, "pem", 4, PEM, every, F.contains(text, F.lit("-----BEGIN")))
    mixed = spans(text, "mixed", 5, MIXED, classes, F.lit(True))
    # the lines of a key are no values of their own
    own = let(F.struct(keys.alias("keys"), mixed.alias("mixed")), lambda x: F.concat(x["keys"], F.filter(x["mixed"], lambda s: ~within(x["keys"], s["start"], s["end"]))))
    return F.concat(spans(text, "bearer", 3, BEARER, every, F.contains(text, F.lit("Bearer"))), own)


def ownership(values: DataFrame) -> DataFrame:
    """(hash, repos, owners): distinct repositories and owners of each hash, null ones counting as one each.

    Equal (hash, repository) pairs are dropped before the count, so a hash that a third of the corpus holds is
    summed within each task first.
    """
    pairs = values.select("hash", "repo", "owner").distinct()
    repos = pairs.select("hash", F.struct("repo").alias("x")).distinct().groupBy("hash").agg(F.count("x").alias("repos"))
    owners = pairs.select("hash", F.struct("owner").alias("x")).distinct().groupBy("hash").agg(F.count("x").alias("owners"))
    return repos.join(owners, "hash")


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row a document: id, base (spans by kind), found (sorted spans, base and added), live and copied.

    repo and owner are columns of docs; by default each different text is a repository, so that copies of a document
    don't count, and its source the owner. live holds the base and added spans whose value (of a private key, its whole text without line ends) at most max_owners owners and max_repos repositories
    hold, copied the other base spans. A candidate is added if it is live and touches no base span; a key may hold some. Null text
    counts as empty; repeated rows are kept and count as one repository; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    repo = F.xxhash64(text_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    rows = docs.select(F.col(id_col).alias("id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"))
    by_kind = base_spans(text)
    rows = rows.select("id", "repo", "owner", F.struct(*(by_kind[k].alias(k) for k in BASE)).alias("base"), candidate_spans(text).alias("loose"))

    def hashed(s: Column) -> Column:
        key = F.regexp_replace(s["match"], r"\s|\\[nr]", "")
        value = F.when(s["kind"] == "assign", F.regexp_extract(s["match"], ASSIGN, 2)).when(s["kind"] == "pem", key).otherwise(s["match"])
        return F.struct(F.struct(*(s[k].alias(k) for k in ("start", "rank", "end", "kind"))).alias("span"), F.xxhash64(value).alias("hash"))

    found = F.transform(F.concat(*(F.col(f"base.{k}") for k in BASE), "loose"), hashed)
    base = F.struct(*(bare(F.col(f"base.{k}")).alias(k) for k in BASE))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "repo", "owner", base.alias("base"), found.alias("all"))
    rows = materialize(rows, "secret-spans")  # row numbers are fixed from here on
    values = materialize(rows.select("row", "repo", "owner", F.explode("all").alias("x")).select("row", "repo", "owner", "x.*"), "secret-values")
    counts = materialize(ownership(values), "secret-owners")
    mine = values.select("row", "span", "hash").join(counts, "hash")
    is_live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    sort = F.when(~is_live, F.col("span"))
    judged = mine.groupBy("row").agg(F.collect_list(F.when(is_live, F.col("span"))).alias("live_all"), F.collect_list(sort).alias("copied_all"))
    # most documents hold no candidate and need no join
    none = F.lit(None).cast(f"array<{SPAN}>")
    busy = rows.filter(F.size("all") > 0).join(judged, "row", "left")
    rows = rows.filter(F.size("all") == 0).withColumns({"live_all": none, "copied_all": none}).unionByName(busy)
    live, copied = (F.coalesce(c, F.array().cast(f"array<{SPAN}>")) for c in ("live_all", "copied_all"))
    all_base = F.concat(*(F.col(f"base.{k}") for k in BASE))

    def apart(s: Column) -> Column:
        touched = [F.when(s["kind"] == "pem", crosses(F.col(f"base.{k}"), s["start"], s["end"])).otherwise(overlaps(F.col(f"base.{k}"), s["start"], s["end"])) for k in BASE]
        return ~(touched[0] | touched[1] | touched[2])

    added = F.filter(live, lambda s: s["kind"].isin(*ADDED) & apart(s))
    of_base = lambda found: F.filter(found, lambda s: s["kind"].isin(*BASE))
    return rows.select(
        F.col("id").alias(id_col), "base", F.array_sort(F.concat(all_base, added)).alias("found"),
        F.array_sort(F.concat(of_base(live), added)).alias("live"), F.array_sort(of_base(copied)).alias("copied"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, base counts, hash of the base spans, all spans, and how many are live, from what find_secrets returns."""
    base = F.concat(*(F.col(f"base.{k}") for k in BASE))
    return found.select(
        id_col,
        *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_copied"),
    )


__all__ = ["digest", "find_secrets", "matches", "ownership"]
