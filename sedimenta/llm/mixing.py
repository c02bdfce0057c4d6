"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash of its id, source and text. The words of every source are summed by bucket of
the leading hash bits; the bucket in which a source's budget ends is split by the next bits, and so on until the
bucket holds a single hash. Rows that share it are told apart in the same way by the hash of their row number.
Documents below the threshold are taken: no sort, and no row is moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm._shared import bounded, materialize, word_count

#: Bits of the hash, and those that one level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 10


def document_hash(*cols: Column) -> Column:
    """First 60 bits of an MD5 digest as a long."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Targets of sources (skey, source, source_size): share of all sizes by weight, at most cap times a source's own.

    Weights repeat over sources by code point, null last. With sources ordered by cap over weight, a source is
    at its cap if the level that would fill it and all later ones exceeds that ratio; the largest level is the
    one at which the others stop. One row a source meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("skey"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    target = F.least(F.col("ceiling"), F.max("level").over(Window.partitionBy()) * F.col("weight"))
    return s.select("skey", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, cells: DataFrame, n: int, key: str) -> DataFrame:
    """(skey, rest, base, words, low, high, rows): of every cell (skey, rest, base) the bucket of key where rest ends.

    base words come before rows; low and high are the least and greatest key of the bucket, which end up equal.
    Cells whose rest all rows together don't reach have none.
    """
    run = Window.partitionBy("skey").orderBy("bucket")
    cells = cells.select("skey", "rest", "base", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.join(bounded(cells, n), "skey").filter(F.shiftright(key, shift + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("skey", "rest", "base", F.shiftright(key, shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")
        )
        hist = hist.withColumn("until", F.col("base") + F.sum("words").over(run)).withColumn("start", F.col("until") - F.col("words"))
        edge = hist.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("until")))
        cells = materialize(edge.select("skey", "rest", F.col("start").alias("base"), F.col("bucket").alias("prefix"), "words", "low", "high", "rows"), "mix-cells")
        if cells.filter(F.col("low") < F.col("high")).isEmpty():
            break
    return cells


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row a document: id, source, size, source_size, target (of its source), copies and taken, and doc, a struct
    of the columns that carry names.

    A document is taken whole: floor(target / source_size) times, and once more if the middle of its interval in
    hash order lies within the rest of the target, so that a source misses its target by at most half of one
    document. Null text has size 0, very long ones are counted whole; a null source is a source of its own; sources
    of size 0 have target 0. Of rows equal in id, source and text as many are taken once more as the rest has room
    for, so that reruns agree on how many. Other columns are ignored; an empty table gives no rows.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    kept = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("boolean")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("skey"), word_count(F.col(text_col)).alias("size"), kept.alias("doc"),
        document_hash(F.col(id_col), key, F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(2**HASH_BITS - 1)).alias("tie"),
    )
    rows = materialize(rows, "mix-docs")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = source_targets(sizes, weights, share, cap).withColumn("full", full.cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-plan")
    n = plan.count()

    edge = _boundary(rows, plan.select("skey", "rest", F.lit(0.0).alias("base")), n, "h")
    tied = edge.filter("rows > 1").select("skey", "rest", "base", F.col("low").alias("at"))
    same = rows.join(bounded(tied.select("skey", "at"), n), "skey").filter(F.col("h") == F.col("at"))
    ties = _boundary(same, tied, n, "tie")
    half = lambda: F.col("base") + F.col("words") / 2 <= F.col("rest")
    ties = ties.select("skey", F.when(half(), F.col("low")).otherwise(F.col("low") - 1).alias("tie_until"))
    one = F.when(half(), F.lit(2**HASH_BITS)).otherwise(F.lit(-1))  # a hash of one row, whose tie is not asked
    edge = edge.join(bounded(ties, n), "skey", "left").select("skey", F.col("low").alias("until"), F.coalesce("tie_until", one).alias("tie_until"))
    plan = plan.join(edge, "skey", "left")
    below = (F.col("h") < F.col("until")) | ((F.col("h") == F.col("until")) & (F.col("tie") <= F.col("tie_until")))
    copies = F.col("full") + F.coalesce(below, F.lit(False)).cast("long")
    return rows.join(bounded(plan, n), "skey").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["doc"] if carry else []),
    )


#: The same mix by sorting and running sums.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), r AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || skey || '|' || md5(text)), 1, 15))::BIGINT AS h FROM d
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM r GROUP BY skey
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (SELECT skey, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), g AS (
  SELECT r.*, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY skey ORDER BY h ROWS UNBOUNDED PRECEDING) AS until
  FROM r JOIN p USING (skey)
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN until - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""
