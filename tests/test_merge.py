from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedimenta.operators.evolution import FLAG
from sedimenta.operators.merges import merge_rejected, merge_silver, upsert_audit
from sedimenta.sources.versioned import VersionedTable

SCHEMA = "trip_id string, record_source string, tip_amount double, ingest_batch_id string, ingested_at timestamp"


def trips(spark, *rows, extra=""):
    df = spark.createDataFrame([(k, s, t, b, None, *x) for k, s, t, _, b, *x in rows], SCHEMA + extra)
    times = F.create_map(*[F.lit(v) for r in rows for v in (r[0] + r[4], f"2026-01-01 {r[3]}:00:00")])
    df = df.withColumn("ingested_at", F.to_timestamp(times[F.concat("trip_id", F.coalesce("ingest_batch_id", F.lit("")))]))
    return df.withColumns({"raw_record_hash": F.sha2(F.concat_ws("|", "record_source", F.col("tip_amount").cast("string")), 256), "business_hash": F.sha2(F.col("tip_amount").cast("string"), 256)})


def metrics(spark, path):
    return VersionedTable(spark, path).latest_commit()["operationMetrics"]


@pytest.mark.parametrize(
    ("first", "second", "updated", "inserted", "left"),
    [
        (("X", "official", 3.0, 10, "b1"), ("X", "fixture", 3.0, 11, "b2"), "0", "0", {"X": ("official", 3.0)}),
        (("X", "official", 3.0, 10, "b1"), ("X", "cdc", 4.0, 11, "b2"), "1", "0", {"X": ("cdc", 4.0)}),
        (("X", "official", 4.0, 11, "b2"), ("X", "late", 2.0, 10, "b1"), "0", "0", {"X": ("official", 4.0)}),
        (("X", "official", 4.0, 10, "b1"), ("X", "tie", 2.0, 10, "b2"), "1", "0", {"X": ("tie", 2.0)}),
        (("X", "official", 4.0, 10, "b1"), ("Y", "new", 2.0, 10, "b1"), "0", "1", {"X": ("official", 4.0), "Y": ("new", 2.0)}),
    ],
)
def test_silver_cases(spark, tmp_path, first, second, updated, inserted, left):
    path = tmp_path / "silver"
    merge_silver(spark, trips(spark, first), path)
    merge_silver(spark, trips(spark, second), path)
    m = metrics(spark, path)
    assert (m["numTargetRowsUpdated"], m["numTargetRowsInserted"], m["numSourceRows"]) == (updated, inserted, "1")
    assert {r.trip_id: (r.record_source, r.tip_amount) for r in VersionedTable(spark, path).read().collect()} == left
    assert m["numTargetFilesRemoved"] == ("1" if updated == "1" else "0")


def test_evolution_and_flag(spark, tmp_path):
    path = tmp_path / "silver"
    merge_silver(spark, trips(spark, ("X", "o", 3.0, 10, "b1"), ("Z", "o", 3.0, 10, "b1")), path)
    wider = trips(spark, ("X", "o", 4.0, 11, "b2", 1.5), ("Y", "o", 1.0, 11, "b2", 2.5), extra=", surcharge_fee double")
    merge_silver(spark, wider, path)
    t = VersionedTable(spark, path)
    assert {r.trip_id: (r.tip_amount, r.surcharge_fee) for r in t.read().collect()} == {"X": (4.0, 1.5), "Y": (1.0, 2.5), "Z": (3.0, None)}
    assert "surcharge_fee" not in t.read(0).columns and spark.conf.get(FLAG, None) is None
    merge_silver(spark, trips(spark, ("X", "o", 5.0, 12, "b3"), ("W", "o", 5.0, 12, "b3")), path)
    assert {r.trip_id: r.surcharge_fee for r in t.read().collect()} == {"X": 1.5, "Y": 2.5, "Z": None, "W": None}


def test_only_touched_files_are_rewritten(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.create(spark.range(100).selectExpr("id AS k", "id AS v").repartitionByRange(4, "k"))
    source = spark.createDataFrame([(3, -3), (4, 4), (200, 200)], "k long, v long")
    t.merge(source, ["k"], update_condition="s.v <> t.v")
    m = t.latest_commit()["operationMetrics"]
    want = {"numSourceRows": "3", "numTargetRowsUpdated": "1", "numTargetRowsInserted": "1", "numTargetRowsCopied": "24", "numTargetFilesRemoved": "1", "numTargetFilesAdded": "2", "numTargetRowsDeleted": "0", "numOutputRows": "26"}
    assert m == want
    assert {r.k: r.v for r in t.read().collect()} == {i: i for i in range(100)} | {3: -3, 200: 200}
    t.merge(source, ["k"], update_condition="s.v <> t.v")
    assert t.latest_commit()["operationMetrics"]["numOutputRows"] == "0" and t.version() == 2


def test_repeated_source_keys(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.create(spark.createDataFrame([(1, 1)], "k long, v long"))
    with pytest.raises(ValueError, match="Several source rows"):
        t.merge(spark.createDataFrame([(1, 2), (1, 3)], "k long, v long"), ["k"])
    assert t.version() == 0
    t.merge(spark.createDataFrame([(5, 2), (5, 3)], "k long, v long"), ["k"])
    assert t.read().count() == 3
    with pytest.raises(ValueError, match="not in the table"):
        t.merge(spark.createDataFrame([(1, 2, 3)], "k long, v long, w long"), ["k"])


def test_null_keys_never_match_and_null_order_never_updates(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.create(spark.createDataFrame([(None, 1), (1, 1)], "k long, v long"))
    t.merge(spark.createDataFrame([(None, 9), (1, None)], "k long, v long"), ["k"], update_condition="s.v > t.v")
    assert sorted(map(str, t.read().collect())) == sorted(map(str, spark.createDataFrame([(None, 1), (1, 1), (None, 9)], "k long, v long").collect()))


def test_rejected_insert_once(spark, tmp_path):
    rows = spark.createDataFrame([("b", "h1", 1), ("b", "h1", 1), ("b", "h2", 2)], "ingest_batch_id string, raw_record_hash string, v int")
    for _ in range(2):
        merge_rejected(spark, rows, tmp_path / "r")
    t = VersionedTable(spark, tmp_path / "r")
    assert t.read().count() == 2 and t.version() == 1 and t.read().filter("rejected_at IS NULL").isEmpty()


def test_audit_upsert(spark, tmp_path):
    for n in (1, 2):
        upsert_audit(spark, spark.createDataFrame([(7, n)], "batch_id long, incoming long"), tmp_path / "a")
    assert [tuple(r) for r in VersionedTable(spark, tmp_path / "a").read().collect()] == [(7, 2)]
