from __future__ import annotations

RAW = "VendorID int, PULocationID int, DOLocationID int, trip_distance double, tpep_pickup_datetime string, tpep_dropoff_datetime string, fare_amount double"
BRONZE = (
    "trip_id string, tpep_pickup_datetime string, tpep_dropoff_datetime string, PULocationID long, DOLocationID long, fare_amount double, "
    "trip_distance double, total_amount double, tip_amount double, passenger_count long, payment_type long, record_source string, "
    "pickup_latitude double, pickup_longitude double, dropoff_latitude double, dropoff_longitude double, ingest_batch_id string, ingested_at string, raw_record_hash string"
)
GOOD = {
    "trip_id": "t1", "tpep_pickup_datetime": "2025-11-01 10:00:00", "tpep_dropoff_datetime": "2025-11-01 10:30:00", "PULocationID": 132, "DOLocationID": 236,
    "fare_amount": 50.0, "trip_distance": 15.0, "total_amount": 65.0, "tip_amount": 10.0, "passenger_count": 1, "payment_type": 1, "record_source": "official_tlc",
    "pickup_latitude": None, "pickup_longitude": None, "dropoff_latitude": None, "dropoff_longitude": None, "ingest_batch_id": "b1", "ingested_at": "2026-01-01 00:00:00", "raw_record_hash": "h1",
}
FIXTURE_GPS = {"record_source": "generated_fixture", "pickup_latitude": 40.75, "pickup_longitude": -73.98, "dropoff_latitude": 40.73, "dropoff_longitude": -73.99}


def bronze_rows(spark, *changes):
    from pyspark.sql import functions as F

    names = [c.split()[0] for c in BRONZE.split(", ")]
    rows = [tuple((GOOD | c)[n] for n in names) for c in changes]
    return spark.createDataFrame(rows, BRONZE).withColumn("ingested_at", F.to_timestamp("ingested_at"))
