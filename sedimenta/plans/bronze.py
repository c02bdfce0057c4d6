"""Bronze: raw files appended with lineage and content hashes, once each."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import config
from sedimenta.functions.identity import add_trip_id, content_hash
from sedimenta.sources.versioned import VersionedTable

LOG = logging.getLogger("sedimenta.bronze")
# Types of known columns, where files disagree; dates stay text.
LONGS = ("VendorID", "passenger_count", "RatecodeID", "PULocationID", "DOLocationID", "payment_type")
DOUBLES = (
    "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount",
    "congestion_surcharge", "Airport_fee", "cbd_congestion_fee", "pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude",
)
STRINGS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")
GPS = DOUBLES[-4:]
OFFICIAL = "official_tlc"


def normalize_input(df: DataFrame) -> DataFrame:
    """Known columns cast to one type each, coordinates present, others as they are. No value is judged."""
    types = dict.fromkeys(LONGS, "long") | dict.fromkeys(DOUBLES, "double") | dict.fromkeys(STRINGS, "string")
    known = {c: F.col(c).cast(t) for c, t in types.items() if c in df.columns}
    absent = {c: F.lit(None).cast("double") for c in GPS if c not in df.columns}
    df = df.withColumns(known | absent)
    if "record_source" not in df.columns:
        df = df.withColumn("record_source", F.lit(OFFICIAL))
    return df if "trip_id" in df.columns else add_trip_id(df)


def add_bronze_metadata(df: DataFrame, input_path: str, batch_id: str) -> DataFrame:
    """Lineage columns; the hash covers every column that df has before them."""
    return df.withColumns(
        {
            "source_file": F.col("_metadata.file_path") if df.inputFiles() else F.lit(None).cast("string"),
            "source_path": F.lit(str(input_path)),
            "ingest_batch_id": F.lit(batch_id),
            "ingested_at": F.current_timestamp(),
            "raw_record_hash": content_hash(df.columns),
        }
    )


def already_ingested(spark: SparkSession, table_path: str | Path, batch_id: str) -> bool:
    """Whether the table holds a row of the batch; the batch bounds of its files spare most of the search."""
    table = VersionedTable(spark, table_path)
    if not table.exists():
        return False
    return not table.read(skip={"ingest_batch_id": (batch_id, batch_id)}).filter(F.col("ingest_batch_id") == batch_id).isEmpty()


def ingest_batch(spark: SparkSession, input_path: str | Path, table_path: str | Path, batch_id: str) -> int:
    """Append one file or folder as a batch; rows written, from the commit's own count."""
    if not Path(input_path).exists():
        raise FileNotFoundError(f"Input does not exist: {input_path}")
    table = VersionedTable(spark, table_path)
    rows = normalize_input(spark.read.parquet(str(input_path)))
    version = table.append(add_bronze_metadata(rows, str(input_path), batch_id), evolve=True)
    metrics = table.commit_row(version)["operationMetrics"]
    return int(metrics["numOutputRows"])


def default_inputs(source_dir: Path = config.SOURCE_DIR, fixture: Path = config.DIRTY_FIXTURE) -> list[Path]:
    """Monthly files in order, then the fixture."""
    months = sorted(source_dir.glob(config.MONTHLY))
    if not months:
        raise FileNotFoundError(f"No monthly files in {source_dir}")
    if not fixture.exists():
        raise FileNotFoundError(f"Fixture does not exist: {fixture}")
    return [*months, fixture]


def run_bronze(spark: SparkSession, inputs: list[str | Path] | None = None, output_path: str | Path = config.BRONZE, batch_id: str | None = None) -> dict:
    """Ingest inputs that aren't in the table yet. A batch's id is its file's stem, or batch_id for a single input."""
    inputs = list(inputs) if inputs else list(default_inputs())
    if batch_id is not None and len(inputs) != 1:
        raise ValueError("batch_id needs exactly one input")
    written, skipped = {}, []
    for path in inputs:
        name = batch_id or Path(path).stem
        if already_ingested(spark, output_path, name):
            skipped.append(name)
        else:
            written[name] = ingest_batch(spark, path, output_path, name)
    state = VersionedTable(spark, output_path).snapshot()
    total = sum(json.loads(a["stats"])["numRecords"] for a in state.files.values())
    summary = {"ingested": written, "skipped": skipped, "rows_written": sum(written.values()), "bronze_rows": total}
    LOG.info(json.dumps({"event": "bronze", **summary}))
    return summary
