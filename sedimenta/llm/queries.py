"""Queries op1 to op10 and the pipeline, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.llm import decontaminate, langid, licenses, maxscore, mixing, pii, secrets, simhash, toxicity, urls
from sedimenta.llm._shared import table


def id_checksum(name):
    """crc32 of an id as text, that of an empty string for null."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def op1_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op2_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=2)


def op4_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_maxscore(spark, sf_dir):
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64)


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = id_checksum("doc_id") % 4 == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model, keep={"held_out": held_out})


def op8_secrets(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_toxicity(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), id_checksum("doc_id") % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model, keep={"held_out": held_out})


def op10_url_filter(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score", "cut")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_maxscore": op5_maxscore,
    "op6_decontaminate": op6_decontaminate,
    "op7_langid": op7_langid,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
}
ORACLES = {"op2_mix_sources": mixing.ORACLE, "op5_maxscore": maxscore.ORACLE}
