from __future__ import annotations

import json

import pytest
from helpers import RAW
from pyspark.sql import functions as F

from sedimenta.functions.identity import add_trip_id
from sedimenta.plans import bronze
from sedimenta.sources import fixture
from sedimenta.sources.versioned import VersionedTable

ROW = (1, 132, 236, 17.5, "2025-11-01 10:00:00", "2025-11-01 10:40:00", 70.0)


def ids(spark, *rows):
    return [r.trip_id for r in add_trip_id(spark.createDataFrame(list(rows), RAW)).collect()]


def test_trip_id_depends_on_identity_columns_only(spark):
    moved = (*ROW[:4], "2025-11-01 10:00:01", *ROW[5:])
    dearer = (*ROW[:6], 99.0)
    same, again, other, priced = ids(spark, ROW, ROW, moved, dearer)
    assert same == again == priced != other and len(same) == 64


def test_null_positions_and_bad_dates_stay_apart(spark):
    a, b, c = ids(spark, (None, 1, *ROW[2:]), (1, None, *ROW[2:]), (1, 1, 1, 1.0, "not-a-date", None, 1.0))
    assert len({a, b, c}) == 3


def test_dirty_values_survive_and_types_widen(spark):
    rows = spark.createDataFrame([(1, 2, 3, 1.0, "not-a-date", "x", -1.0)], RAW)
    out = bronze.add_bronze_metadata(bronze.normalize_input(rows), "in.parquet", "b")
    row, types = out.first(), dict(out.dtypes)
    assert row.tpep_pickup_datetime == "not-a-date" and row.fare_amount == -1.0
    assert types["PULocationID"] == types["VendorID"] == "bigint" and types["pickup_latitude"] == "double"
    assert row.record_source == "official_tlc" and row.trip_id and len(row.raw_record_hash) == 64


def test_existing_lineage_is_kept(spark):
    rows = spark.createDataFrame([ROW], RAW).withColumns({"trip_id": F.lit("fixed"), "record_source": F.lit("generated_fixture")})
    row = bronze.normalize_input(rows).first()
    assert (row.trip_id, row.record_source) == ("fixed", "generated_fixture")


def test_ingest_is_idempotent_and_evolves(spark, tmp_path):
    a, b, out = tmp_path / "m1.parquet", tmp_path / "m2.parquet", tmp_path / "bronze"
    spark.createDataFrame([ROW, ROW], RAW).write.parquet(str(a))
    spark.createDataFrame([(*ROW, 2.5)], RAW + ", cbd_congestion_fee double").write.parquet(str(b))
    first = bronze.run_bronze(spark, [a, b], out)
    again = bronze.run_bronze(spark, [a, b], out)
    assert first["ingested"] == {"m1": 2, "m2": 1} and again["ingested"] == {} and again["skipped"] == ["m1", "m2"]
    assert again["bronze_rows"] == 3
    rows = VersionedTable(spark, out).read()
    assert rows.filter("cbd_congestion_fee = 2.5").count() == 1 and rows.filter("source_file LIKE '%part-%'").count() == 3
    with pytest.raises(ValueError, match="exactly one"):
        bronze.run_bronze(spark, [a, b], out, "x")
    with pytest.raises(FileNotFoundError):
        bronze.ingest_batch(spark, tmp_path / "none", out, "x")


def test_default_inputs(tmp_path):
    with pytest.raises(FileNotFoundError, match="monthly"):
        bronze.default_inputs(tmp_path, tmp_path / "f")
    for m in ("02", "01"):
        (tmp_path / f"yellow_tripdata_2025-{m}.parquet").touch()
    with pytest.raises(FileNotFoundError, match="Fixture"):
        bronze.default_inputs(tmp_path, tmp_path / "f")
    (tmp_path / "f").touch()
    assert [p.name[-10:-8] for p in bronze.default_inputs(tmp_path, tmp_path / "f")[:2]] == ["01", "02"]


def test_dirty_fixture(spark, tmp_path):
    schema = "VendorID int, tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, trip_distance double, PULocationID int, DOLocationID int, fare_amount double, tip_amount double, total_amount double"
    rows = spark.range(1500).selectExpr("1", "timestamp'2025-11-01 10:00:00' + make_interval(0,0,0,0,0,id) AS p", "timestamp'2025-11-02 10:00:00'", "double(id)", "int(id % 200 + 1)", "7", "10D", "1D", "12D")
    source = tmp_path / "s.parquet"
    spark.createDataFrame(rows.rdd, schema).coalesce(1).write.parquet(str(source))
    n = fixture.prepare_fixture(spark, source, tmp_path / "dirty.parquet", 1000)
    out = spark.read.parquet(str(tmp_path / "dirty.parquet"))
    assert n == out.count() == 1000 + 44 and len(out.inputFiles()) == 1
    unique = out.dropDuplicates()
    assert unique.filter("tpep_pickup_datetime = 'not-a-date'").count() == len(range(0, 1000, 13))
    assert unique.filter("PULocationID IS NULL").count() == len(range(0, 1000, 17))
    assert unique.filter("fare_amount < 0").count() == len(range(0, 1000, 101))
    clean = {r.trip_id for r in add_trip_id(spark.read.parquet(str(source))).collect()}
    assert {r.trip_id for r in out.collect()} <= clean
    with pytest.raises(ValueError, match="at least 100"):
        fixture.load_sample(spark, source, 99)
    with pytest.raises(FileNotFoundError):
        fixture.load_sample(spark, tmp_path / "none", 100)
    with pytest.raises(ValueError, match="missing"):
        spark.range(3).write.parquet(str(tmp_path / "bad.parquet"))
        fixture.load_sample(spark, tmp_path / "bad.parquet", 100)
    assert json.dumps(fixture.CORRUPTIONS)
