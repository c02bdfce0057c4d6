"""A corpus from documents: five stages, each over all that the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that overlap a benchmark go,
personal data are replaced in the texts, and sources are mixed to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import decontaminate, mixing, pii, simhash, toxicity
from sedimenta.llm._shared import materialize, table
from sedimenta.llm.queries import id_checksum


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones that aren't held out, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_checksum("doc_id") % 5 != 0)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that links of similarity 0.8 or more join."""
    return simhash.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by their kind; n_chars is that of the new text."""
    clean = pii.redact_pii(docs)
    if "n_chars" not in clean.columns:
        return clean
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with all their columns, and copies (how often each is taken), taken (words), source_size
    and target of its source; those not taken go, but for texts without words. A column of docs of such a name stays,
    the mix's own then begins with mix_."""
    mixed = mixing.mix_sources(docs, carry=docs.columns)
    own = {c: f"mix_{c}" if c in docs.columns else c for c in ("copies", "taken", "source_size", "target")}
    kept = mixed.filter("copies > 0 OR size = 0")
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns), *(F.col(c).alias(name) for c, name in own.items()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact),
    ("mixing", mix),
]
#: SQL has no classifier, SimHash or span model; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
