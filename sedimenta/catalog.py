"""Registered queries of the engine over the test tables, and their DuckDB equivalents.

Trips are made from events: keys from the event's number, times from ts, fares from value. Raw trips are the
same with numbered damage. Tables that a query writes live in a folder of the session that is removed at exit.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.identity import add_business_hash, add_trip_id, trip_id
from sedimenta.operators import diff, profile
from sedimenta.operators.evolution import check_evolution
from sedimenta.operators.gold import apply_gold_filters, build_gold
from sedimenta.operators.quality import deduplicate, validate_and_split, with_reasons
from sedimenta.plans import audit, benchmark, bronze, events, skipping
from sedimenta.plans.gold import run_gold
from sedimenta.sources import fixture
from sedimenta.sources.versioned import VersionedTable
from sedimenta.streaming.silver import run_silver

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
YEAR = 2024


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> Path:
    """A fresh folder: in the cluster's shared checkpoint folder if that is a path, else in the machine's."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    local = bool(root) and ":" not in root
    base = Path("/" + root.lstrip("/")) / f"sedimenta-{uuid.uuid4().hex}" if local else Path(tempfile.mkdtemp(prefix="sedimenta-"))
    base.mkdir(parents=True, exist_ok=True)
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


# ----------------------------------------------------------------------- views

TRIPS = """
SELECT event_id, CAST(event_id % 7 + 1 AS BIGINT) AS VendorID, user_id AS PULocationID, CAST(event_id % 265 + 1 AS BIGINT) AS DOLocationID,
       date_trunc('second', ts) AS tpep_pickup_datetime, date_trunc('second', ts) + to_minutes(CAST(event_id % 500 AS INT)) AS tpep_dropoff_datetime,
       (event_id * 7 % 1300) / 10.0::DOUBLE AS trip_distance, value AS fare_amount, (event_id % 11) / 2.0::DOUBLE AS tip_amount,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 5) / 4.0::DOUBLE END AS extra, value + (event_id % 11) / 2.0::DOUBLE AS total_amount,
       CASE WHEN user_id % 20 = 0 THEN NULL ELSE event_id % 3 + 1 END::BIGINT AS payment_type, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 6 END::BIGINT AS passenger_count
FROM events"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    tip = (n % 11) / 2.0
    pickup = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return e.select(
        "event_id",
        (n % 7 + 1).cast("long").alias("VendorID"),
        F.col("user_id").cast("long").alias("PULocationID"),
        (n % 265 + 1).cast("long").alias("DOLocationID"),
        pickup.cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), (n % 500).cast("int"))).cast("timestamp_ntz").alias("tpep_dropoff_datetime"),
        (n * 7 % 1300 / 10.0).alias("trip_distance"),
        F.col("value").alias("fare_amount"),
        tip.alias("tip_amount"),
        F.when(n % 9 != 0, (n % 5) / 4.0).alias("extra"),
        (F.col("value") + tip).alias("total_amount"),
        F.when(F.col("user_id") % 20 != 0, (n % 3 + 1).cast("long")).alias("payment_type"),
        F.when(n % 8 != 0, (n % 6).cast("long")).alias("passenger_count"),
    )


#: Trips with dates as text, coordinates and the numbered damage of the fixture.
DIRTY = f"""
SELECT event_id, VendorID, CASE WHEN event_id % 17 = 0 THEN NULL ELSE PULocationID END AS PULocationID, CASE WHEN event_id % 19 = 0 THEN NULL ELSE DOLocationID END AS DOLocationID,
       CASE WHEN event_id % 13 = 0 THEN 'not-a-date' ELSE strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S') END AS tpep_pickup_datetime,
       CASE WHEN event_id % 29 = 0 THEN '2025-99-99 25:61:00' WHEN event_id % 10 = 0 THEN strftime(tpep_pickup_datetime - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(tpep_dropoff_datetime, '%Y-%m-%d %H:%M:%S') END AS tpep_dropoff_datetime,
       CASE WHEN event_id % 37 = 0 THEN -trip_distance - 1 ELSE trip_distance END AS trip_distance, CASE WHEN event_id % 101 = 0 THEN -1.0::DOUBLE ELSE fare_amount END AS fare_amount,
       tip_amount, extra, CASE WHEN event_id % 41 = 0 THEN 0 ELSE total_amount END AS total_amount, payment_type, CASE WHEN event_id % 43 = 0 THEN -1 ELSE passenger_count END AS passenger_count,
       CASE WHEN event_id % 2 = 0 THEN 'generated_fixture' ELSE 'official_tlc' END AS record_source,
       CASE WHEN event_id % 7 = 0 OR PULocationID IS NULL THEN NULL ELSE 40.75::DOUBLE END AS pickup_latitude, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 40.73::DOUBLE END AS dropoff_latitude
FROM ({TRIPS})"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips(spark, sf_dir).transform(fixture.add_coordinates)
    early, n = F.col("tpep_pickup_datetime") - F.expr("INTERVAL 1 HOUR"), F.col("event_id")
    rows = rows.withColumn("tpep_dropoff_datetime", F.when(n % 10 == 0, early).otherwise(F.col("tpep_dropoff_datetime")))
    rows = rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    rows = fixture.corrupt(rows, "event_id")
    return rows.withColumns(
        {
            "trip_distance": F.when(n % 37 == 0, -F.col("trip_distance") - 1).otherwise(F.col("trip_distance")),
            "total_amount": F.when(n % 41 == 0, F.lit(0.0)).otherwise(F.col("total_amount")),
            "passenger_count": F.when(n % 43 == 0, F.lit(-1)).otherwise(F.col("passenger_count")),
            "record_source": F.when(n % 2 == 0, F.lit("generated_fixture")).otherwise(F.lit("official_tlc")),
        }
    )


REASONS_OF = """
SELECT *, list_filter([
  CASE WHEN trip_id IS NULL OR trim(trip_id) = '' THEN 'missing_trip_id' END, CASE WHEN p IS NULL OR d IS NULL THEN 'invalid_datetime' END, CASE WHEN d < p THEN 'dropoff_before_pickup' END,
  CASE WHEN PULocationID IS NULL OR PULocationID <= 0 OR DOLocationID IS NULL OR DOLocationID <= 0 THEN 'invalid_location' END,
  CASE WHEN fare_amount IS NULL OR isnan(fare_amount) OR fare_amount <= 0 THEN 'invalid_fare' END, CASE WHEN trip_distance IS NULL OR trip_distance < 0 THEN 'invalid_distance' END,
  CASE WHEN total_amount IS NULL OR total_amount <= 0 THEN 'invalid_total_amount' END, CASE WHEN passenger_count < 0 THEN 'invalid_passenger_count' END,
  CASE WHEN record_source = 'generated_fixture' AND NOT coalesce(pickup_latitude BETWEEN 40 AND 41.5 AND dropoff_latitude BETWEEN 40 AND 41.5, false) THEN 'invalid_coordinates' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, try_strptime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S') AS p, try_strptime(tpep_dropoff_datetime, '%Y-%m-%d %H:%M:%S') AS d FROM ({}))"""
REASONS = REASONS_OF.format(f"SELECT *, event_id::VARCHAR AS trip_id FROM ({DIRTY})")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty trips as Bronze rows with fixed lineage."""
    lineage = {"trip_id": F.col("event_id").cast("string"), "ingest_batch_id": F.lit("b1"), "ingested_at": F.timestamp_seconds(F.lit(1767225600)), "raw_record_hash": F.md5(F.col("event_id").cast("string"))}
    return dirty(spark, sf_dir).withColumns(lineage)


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))


def raises(kind: type[Exception], action: Callable[[], object]) -> bool:
    try:
        action()
    except kind:
        return True
    return False


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})



# --------------------------------------------------------- scans and projections


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS n_orders, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
def scan_parquet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("SELECT o_orderkey::BIGINT AS VendorID, o_custkey::BIGINT AS PULocationID, o_totalprice::DOUBLE AS fare_amount, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS tpep_pickup_datetime, o_orderstatus AS kept, 'official_tlc' AS record_source, NULL::DOUBLE AS pickup_latitude FROM orders")
def projection_casts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    renamed = o.select(F.col("o_orderkey").cast("int").alias("VendorID"), F.col("o_custkey").alias("PULocationID"), F.col("o_totalprice").alias("fare_amount"), F.col("o_orderdate").alias("tpep_pickup_datetime"), F.col("o_orderstatus").alias("kept"), F.lit("x").alias("trip_id"))
    return bronze.normalize_input(renamed).select("VendorID", "PULocationID", "fare_amount", "tpep_pickup_datetime", "kept", "record_source", "pickup_latitude")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 120 OR o_totalprice > 400000")
def filter_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey").between(100, 120) | (F.col("o_totalprice") > 400000)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IS DISTINCT FROM 'F'")
def filter_prefix_null_safe(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1") & ~F.col("o_orderstatus").eqNullSafe("F")).select("o_orderkey")


@query("SELECT event_id, CAST(nullif(json_extract_string(props, '$.k'), '') AS BIGINT) AS k, event_type || '!' AS label FROM events WHERE event_id % 23 = 0")
def modulo_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.pmod("event_id", F.lit(23)) == 0)
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat("event_type", F.lit("!")).alias("label"))


@query(f"""
SELECT event_id, sha256(concat_ws('||', VendorID::VARCHAR, PULocationID::VARCHAR, DOLocationID::VARCHAR, trip_distance::VARCHAR,
       strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S'), strftime(tpep_dropoff_datetime, '%Y-%m-%d %H:%M:%S'))) AS trip_id FROM ({TRIPS})""")
def trip_id_sha256(spark, sf_dir):
    return trips(spark, sf_dir).select("event_id", trip_id().alias("trip_id"))


@query(f"""
SELECT event_id, sha256('{{' || concat_ws(',', '"fare_amount":' || floor(fare_amount)::BIGINT, '"tip_amount":' || floor(tip_amount)::BIGINT, '"total_amount":' || floor(total_amount)::BIGINT,
       '"extra":' || floor(extra)::BIGINT, '"passenger_count":' || passenger_count, '"payment_type":' || payment_type) || '}}') AS business_hash FROM ({TRIPS})""")
def business_hash(spark, sf_dir):
    """Of whole amounts, as the two engines don't write all fractions alike."""
    whole = {c: F.floor(c) for c in ("fare_amount", "tip_amount", "total_amount", "extra")}
    return add_business_hash(trips(spark, sf_dir).withColumns(whole)).select("event_id", "business_hash")


@query("""
SELECT o_orderkey::BIGINT AS VendorID, 'b7' AS ingest_batch_id, 'in' AS source_path, 'orders.parquet' AS file,
       sha256('{"VendorID":' || o_orderkey || ',"PULocationID":' || o_custkey || ',"kept":"' || o_orderstatus || '","trip_id":"x","record_source":"official_tlc"}') AS raw_record_hash FROM orders""")
def bronze_lineage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = bronze.normalize_input(o.select(F.col("o_orderkey").alias("VendorID"), F.col("o_custkey").alias("PULocationID"), F.col("o_orderstatus").alias("kept"), F.lit("x").alias("trip_id")))
    file = F.element_at(F.split("source_file", "/"), -1).alias("file")
    return bronze.add_bronze_metadata(rows, "in", "b7").select("VendorID", "ingest_batch_id", "source_path", file, "raw_record_hash")


@query(f"SELECT event_id, PULocationID, DOLocationID, tpep_pickup_datetime, tpep_dropoff_datetime, fare_amount, pickup_latitude, dropoff_latitude FROM ({DIRTY})")
def corrupt_fixture(spark, sf_dir):
    return dirty(spark, sf_dir).select("event_id", "PULocationID", "DOLocationID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "fare_amount", "pickup_latitude", "dropoff_latitude")


# --------------------------------------------------------------------- quality


@query(f"SELECT event_id, array_to_string(reasons, ',') AS reasons FROM ({REASONS})")
def quality_reasons(spark, sf_dir):
    return with_reasons(raw(spark, sf_dir)).select("event_id", F.array_join("rejection_reasons", ",").alias("reasons"))


#: Blank keys, values that are no numbers, and coordinates outside the box or on its edge.
EDGES = f"""
SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE fare_amount END AS fare_amount, CASE WHEN event_id % 4 = 0 THEN 'NaN'::DOUBLE ELSE trip_distance END AS trip_distance,
       CASE WHEN event_id % 6 = 0 THEN 'NaN'::DOUBLE ELSE total_amount END AS total_amount, CASE WHEN pickup_latitude IS NULL THEN NULL WHEN event_id % 9 = 0 THEN 41.6::DOUBLE WHEN event_id % 9 = 1 THEN 41.5::DOUBLE ELSE pickup_latitude END AS pickup_latitude),
       CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN event_id::VARCHAR END AS trip_id FROM ({DIRTY})"""


@query(f"SELECT event_id, array_to_string(reasons, ',') AS reasons FROM ({REASONS_OF.format(EDGES)})")
def quality_edges(spark, sf_dir):
    n, nan = F.col("event_id"), F.lit(float("nan"))
    key = F.when(n % 3 == 0, "  ").when(n % 3 == 1, n.cast("string"))
    odd = {c: F.when(n % k == 0, nan).otherwise(F.col(c)) for c, k in (("fare_amount", 5), ("trip_distance", 4), ("total_amount", 6))}
    latitude = F.when(F.col("pickup_latitude").isNull(), None).when(n % 9 == 0, 41.6).when(n % 9 == 1, 41.5).otherwise(F.col("pickup_latitude"))
    rows = raw(spark, sf_dir).withColumns(odd | {"trip_id": key, "pickup_latitude": latitude})
    return with_reasons(rows).select("event_id", F.array_join("rejection_reasons", ",").alias("reasons"))


@query(f"SELECT event_id, p AS tpep_pickup_datetime, d AS tpep_dropoff_datetime, fare_amount FROM ({REASONS}) WHERE len(reasons) = 0")
def valid_split(spark, sf_dir):
    valid = validate_and_split(raw(spark, sf_dir))[0]
    ntz = (F.col(c).cast("timestamp_ntz").alias(c) for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime"))
    return valid.select("event_id", *ntz, "fare_amount")


@query(f"SELECT event_id, tpep_pickup_datetime AS raw_pickup, tpep_dropoff_datetime AS raw_dropoff, len(reasons)::INT AS n_reasons FROM ({REASONS}) WHERE len(reasons) > 0")
def rejected_split(spark, sf_dir):
    rejected = validate_and_split(raw(spark, sf_dir))[1]
    return rejected.select("event_id", F.col("raw_pickup_datetime").alias("raw_pickup"), F.col("raw_dropoff_datetime").alias("raw_dropoff"), F.size("rejection_reasons").alias("n_reasons"))


@query(f"SELECT reason, count(*)::BIGINT AS count FROM (SELECT unnest(reasons) AS reason FROM ({REASONS})) GROUP BY reason")
def reason_histogram(spark, sf_dir):
    return profile.reason_histogram(validate_and_split(raw(spark, sf_dir))[1])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS place FROM lineitem) WHERE place = 1""")
def dedup_latest(spark, sf_dir):
    keyed = table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    kept = deduplicate(keyed, "key", ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# ----------------------------------------------------------------- aggregations

GOLD_IN = f"SELECT * FROM ({TRIPS}) WHERE fare_amount <= 500 AND trip_distance <= 100 AND date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0 <= 360 AND year(tpep_pickup_datetime) = {YEAR}"
GOLD_OF = """
SELECT PULocationID, hour(tpep_pickup_datetime)::INT AS pickup_hour, count(*)::BIGINT AS trip_count, round(avg(fare_amount), 4) AS avg_fare, sum((payment_type = 1)::BIGINT)::BIGINT AS card_trip_count,
       round(sum(tip_amount) FILTER (payment_type = 1) / nullif(sum(fare_amount) FILTER (payment_type = 1), 0) * 100, 4) AS tip_pct,
       round(avg(fare_amount + coalesce(extra, 0) + coalesce(tip_amount, 0)), 4) AS avg_driver_earnings, round(sum(fare_amount + coalesce(extra, 0) + coalesce(tip_amount, 0)), 2) AS total_driver_earnings
FROM ({}) GROUP BY 1, 2"""
GOLD = GOLD_OF.format(GOLD_IN)
PART = "event_id % 4 <> 0"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(build_gold(trips(spark, sf_dir), YEAR), "avg_fare", "tip_pct", "avg_driver_earnings")
    return rounded(df, "total_driver_earnings", digits=2)


@query(GOLD)
def gold_zone_hour(spark, sf_dir):
    return gold(spark, sf_dir)


@query(f"SELECT event_id, fare_amount, trip_distance FROM ({GOLD_IN})")
def gold_filters(spark, sf_dir):
    return apply_gold_filters(trips(spark, sf_dir), YEAR).select("event_id", "fare_amount", "trip_distance")


@query(f"SELECT count(*)::BIGINT AS groups, sum(trip_count)::BIGINT AS trips FROM ({GOLD})")
def gold_totals(spark, sf_dir):
    return gold(spark, sf_dir).agg(F.count(F.lit(1)).alias("groups"), F.sum("trip_count").alias("trips"))


@query(f"SELECT PULocationID, pickup_hour, trip_count FROM ({GOLD}) ORDER BY trip_count DESC, PULocationID, pickup_hour LIMIT 10")
def topk_groups(spark, sf_dir):
    return profile.top_groups(build_gold(trips(spark, sf_dir), YEAR), 10, "trip_count").select("PULocationID", "pickup_hour", "trip_count")


def gold_run(spark: SparkSession, sf_dir: str) -> tuple[dict, VersionedTable]:
    """Summary and table of Gold from the first of two versions of Silver, whose trips are moved to the year of Gold."""
    root = scratch(spark)
    year = F.expr("INTERVAL 366 DAY")
    rows = trips(spark, sf_dir).withColumns({c: F.col(c) + year for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    silver = VersionedTable(spark, root / "silver")
    silver.create(rows.filter(PART))
    silver.append(rows.filter(f"NOT {PART}"))
    return run_gold(spark, silver.path, root / "gold", 0), VersionedTable(spark, root / "gold")


@query(f"SELECT *, 0::BIGINT AS silver_version, true AS stamped, 1 AS files FROM ({GOLD_OF.format(f'{GOLD_IN} AND {PART}')})")
def gold_of_version(spark, sf_dir):
    _, t = gold_run(spark, sf_dir)
    df = t.read().withColumns({"stamped": F.col("computed_at").isNotNull(), "files": F.lit(t.detail()["numFiles"])}).drop("computed_at")
    return rounded(rounded(df, "avg_fare", "tip_pct", "avg_driver_earnings"), "total_driver_earnings", digits=2)


@query(f"""
SELECT 0::BIGINT AS silver_version, groups, rows_used, rows_total, rows_total - rows_used AS rows_filtered
FROM (SELECT count(*)::BIGINT AS groups, sum(trip_count)::BIGINT AS rows_used FROM ({GOLD_OF.format(f'{GOLD_IN} AND {PART}')})), (SELECT count(*)::BIGINT AS rows_total FROM ({TRIPS}) WHERE {PART})""")
def gold_summary(spark, sf_dir):
    return one_row(spark, gold_run(spark, sf_dir)[0])


@query(f"""
SELECT 'Q1_single_zone' AS name, count(*)::BIGINT AS trips, round(avg(fare_amount), 4) AS avg_fare, round(avg(tip_amount), 4) AS avg_tip FROM ({TRIPS}) WHERE PULocationID = 7
UNION ALL SELECT 'Q2_zone_range', count(*)::BIGINT, round(avg(fare_amount), 4), round(avg(tip_amount), 4) FROM ({TRIPS}) WHERE PULocationID BETWEEN 5 AND 40""")
def zone_stats(spark, sf_dir):
    rows, asked = trips(spark, sf_dir), benchmark.queries(7, 5, 40)
    one, several = (asked[n][2](rows).withColumn("name", F.lit(n)) for n in ("Q1_single_zone", "Q2_zone_range"))
    return rounded(one.unionByName(several), "avg_fare", "avg_tip")


@query(f"SELECT tpep_dropoff_datetime = tpep_pickup_datetime AS is_zero, VendorID, count(*)::BIGINT AS trips, round(avg(trip_distance), 2) AS avg_trip_distance FROM ({TRIPS}) GROUP BY 1, 2")
def profile_by_flag(spark, sf_dir):
    return profile.zero_duration_profile(trips(spark, sf_dir)).drop("avg_fare_amount")


@query(f"""
SELECT count(*)::BIGINT AS total, max(fare_amount) AS most, sum((fare_amount > 500)::BIGINT)::BIGINT AS fare_gt_500, sum((fare_amount > 1000)::BIGINT)::BIGINT AS fare_gt_1000,
       sum((trip_distance > 100)::BIGINT)::BIGINT AS distance_gt_100, sum((trip_distance > 200)::BIGINT)::BIGINT AS distance_gt_200, sum((m <= 0)::BIGINT)::BIGINT AS duration_le_0,
       sum((m > 360)::BIGINT)::BIGINT AS duration_gt_6h, sum((m > 1440)::BIGINT)::BIGINT AS duration_gt_24h, sum((year(tpep_pickup_datetime) <> 2025)::BIGINT)::BIGINT AS pickup_not_2025
FROM (SELECT *, date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0 AS m FROM ({TRIPS}))""")
def conditional_counts(spark, sf_dir):
    row = profile.profile_outliers(trips(spark, sf_dir), ())
    return row.select("total", F.col("fare_amount__max").alias("most"), *profile.thresholds())


@query("SELECT " + ", ".join(f"array_to_string([x::VARCHAR FOR x IN quantile_disc({c}, [0.5, 0.99, 0.999, 0.9999])], ',') AS {c}" for c in profile.COLUMNS)
       + f" FROM (SELECT *, date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0::DOUBLE AS duration_min FROM ({TRIPS}))")
def percentiles_approx(spark, sf_dir):
    """The approximation only brackets the values, which are exact."""
    row = profile.profile_outliers(trips(spark, sf_dir))
    return row.select(*(F.array_join(F.transform(f"{c}__pct", lambda x: x.cast("string")), ",").alias(c) for c in profile.COLUMNS))


@query(f"SELECT quantile_cont(fare_amount, 0.5) AS p50, quantile_cont(fare_amount, 0.99) AS p99, quantile_cont(trip_distance, 0.999) AS d999 FROM ({TRIPS})")
def percentiles_exact(spark, sf_dir):
    p = lambda c, q: F.percentile(c, F.lit(q))
    return trips(spark, sf_dir).agg(p("fare_amount", 0.5).alias("p50"), p("fare_amount", 0.99).alias("p99"), p("trip_distance", 0.999).alias("d999"))


@query("SELECT count(*)::BIGINT - count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS repeated FROM lineitem")
def count_distinct_gap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg((F.count(F.lit(1)) - F.count_distinct("l_orderkey", "l_linenumber")).alias("repeated"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_type, count(*)::BIGINT AS count FROM events GROUP BY 1")
def count_by_category(spark, sf_dir):
    return profile.count_by(table(spark, sf_dir, "events"), "event_type")


@query(f"""
SELECT count(*)::BIGINT AS total, 0::BIGINT AS repeated, sum((tpep_pickup_datetime = 'not-a-date')::BIGINT)::BIGINT AS bad_pickup, sum((tpep_dropoff_datetime LIKE '2025-99%')::BIGINT)::BIGINT AS bad_dropoff,
       sum((PULocationID IS NULL OR DOLocationID IS NULL)::BIGINT)::BIGINT AS null_zone, sum((fare_amount < 0)::BIGINT)::BIGINT AS negative_fare FROM ({DIRTY})""")
def dirty_profile(spark, sf_dir):
    return profile.dirty_profile(raw(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place = 1")
def latest_per_key(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "orders"), "o_custkey", ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 23 = 0")
def union_by_name(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return rows.unionByName(rows.filter(F.pmod("event_id", F.lit(23)) == 0).select("event_type", "event_id"))


# ------------------------------------------------------------------------ diffs

KEYED = "SELECT event_id::VARCHAR AS trip_id, fare_amount, tip_amount, event_id FROM ({})"
AFTER = f"SELECT event_id::VARCHAR AS trip_id, CASE WHEN event_id % 50 = 0 THEN fare_amount + 2 ELSE fare_amount END AS fare_amount, CASE WHEN event_id % 70 = 0 THEN NULL ELSE tip_amount END AS tip_amount, event_id FROM ({TRIPS}) WHERE event_id % 3 <> 1"


def before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trips without every fourth, and trips with some changed."""
    n = F.col("event_id")
    rows = trips(spark, sf_dir).select(n.cast("string").alias("trip_id"), "fare_amount", "tip_amount", "event_id")
    fare = F.when(n % 50 == 0, F.col("fare_amount") + 2).otherwise(F.col("fare_amount"))
    changed = rows.withColumns({"fare_amount": fare, "tip_amount": F.when(n % 70 != 0, F.col("tip_amount"))})
    return rows.filter(n % 4 != 0), changed.filter(n % 3 != 1)


@query(f"""
SELECT a.trip_id, b.fare_amount AS before_fare_amount, a.fare_amount AS after_fare_amount, b.tip_amount AS before_tip_amount, a.tip_amount AS after_tip_amount
FROM ({KEYED.format(TRIPS)}) b JOIN ({AFTER}) a USING (trip_id) WHERE b.event_id % 4 <> 0 AND (a.fare_amount IS DISTINCT FROM b.fare_amount OR a.tip_amount IS DISTINCT FROM b.tip_amount)""")
def changed_records(spark, sf_dir):
    return diff.changed_records(*before_after(spark, sf_dir), limit=None)


@query(f"SELECT trip_id, b.fare_amount AS before_fare_amount, a.fare_amount AS after_fare_amount, b.tip_amount AS before_tip_amount, a.tip_amount AS after_tip_amount FROM ({KEYED.format(TRIPS)}) b JOIN ({AFTER}) a USING (trip_id) WHERE trip_id = '150'")
def changed_record_of_key(spark, sf_dir):
    return diff.changed_records(*before_after(spark, sf_dir), value="150", limit=None)


@query(f"SELECT trip_id, fare_amount, tip_amount FROM ({AFTER}) WHERE event_id % 4 = 0")
def inserted_records(spark, sf_dir):
    return diff.inserted_records(*before_after(spark, sf_dir), limit=None)


@query("SELECT true AS there, false AS absent")
def existence_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return spark.range(1).select(F.lit(diff.key_exists(rows, "o_orderkey", rows.first()["o_orderkey"])).alias("there"), F.lit(diff.key_exists(rows, "o_orderkey", -1)).alias("absent"))


# --------------------------------------------------------------- versioned tables

ORDERS = "o_orderkey", "o_custkey", "o_totalprice"


def orders_table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Version 0: orders with keys not divisible by 3."""
    t = VersionedTable(spark, scratch(spark) / "orders")
    t.create(table(spark, sf_dir, "orders").select(*ORDERS).filter("o_orderkey % 3 <> 0"))
    return t


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order with a higher price, every tenth with the same."""
    rows = table(spark, sf_dir, "orders").select(*ORDERS).filter("o_orderkey % 5 = 0")
    return rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1))


BASE = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
UPSERTED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0"


@query(UPSERTED)
def merge_upsert(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.merge(order_changes(spark, sf_dir), ["o_orderkey"], update_condition="s.o_totalprice <> t.o_totalprice")
    return t.read()


@query(f"{BASE} UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice ELSE o_totalprice + 1 END FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0")
def merge_insert_only(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.merge(order_changes(spark, sf_dir), ["o_orderkey"], update=False)
    return t.read()


@query("SELECT 0::BIGINT AS updated, 0::BIGINT AS inserted, count(*)::BIGINT AS source FROM orders WHERE o_orderkey % 5 = 0")
def merge_replay_noop(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    for _ in range(2):
        t.merge(order_changes(spark, sf_dir), ["o_orderkey"], update_condition="s.o_totalprice <> t.o_totalprice")
    m = t.latest_commit()["operationMetrics"]
    names = {"updated": "numTargetRowsUpdated", "inserted": "numTargetRowsInserted", "source": "numSourceRows"}
    return spark.range(1).select(*(F.lit(int(m[v])).cast("long").alias(k) for k, v in names.items()))


@query(f"SELECT *, CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey % 10 <> 0 OR o_orderkey % 3 = 0) THEN 1.5::DOUBLE END AS surcharge_fee FROM ({UPSERTED})")
def merge_schema_evolution(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    source = order_changes(spark, sf_dir).withColumn("surcharge_fee", F.lit(1.5))
    t.merge(source, ["o_orderkey"], update_condition="s.o_totalprice <> t.o_totalprice", evolve=True)
    return t.read()


@query(BASE)
def time_travel_v0(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.append(order_changes(spark, sf_dir).filter("o_orderkey % 3 = 0"))
    t.overwrite(spark.range(3), replace_schema=True)
    return t.read(0)


@query("SELECT * FROM (VALUES (0::BIGINT, 'WRITE'), (1, 'MERGE'), (2, 'OPTIMIZE'), (3, 'RESTORE')) h(version, operation)")
def history_ops(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.merge(order_changes(spark, sf_dir), ["o_orderkey"])
    t.optimize()
    t.restore(0)
    return t.history_frame().select("version", "operation")


@query(BASE)
def restore_v0(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.overwrite(spark.range(3), replace_schema=True)
    t.restore(0)
    return t.read()


@query("SELECT o_custkey, count(*)::BIGINT AS count FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def overwrite_replace(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.overwrite(t.read().groupBy("o_custkey").count(), replace_schema=True)
    return t.read()


def rewritten(spark: SparkSession, sf_dir: str, columns: list[str] | None) -> VersionedTable:
    t = VersionedTable(spark, scratch(spark) / "orders")
    t.create(table(spark, sf_dir, "orders").select(*ORDERS).repartition(8))
    t.optimize(columns, 1 << 16) if columns else t.optimize()
    return t


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def optimize_preserves_rows(spark, sf_dir):
    return rewritten(spark, sf_dir, None).read()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def zorder_preserves_rows(spark, sf_dir):
    return rewritten(spark, sf_dir, ["o_custkey", "o_orderkey"]).read()


@query("SELECT o_orderkey, o_custkey, o_totalprice, true AS pruned FROM orders WHERE o_custkey BETWEEN 100 AND 120")
def skipping_same_result(spark, sf_dir):
    t = rewritten(spark, sf_dir, ["o_custkey"])
    files = skipping.active_files(t.path, 1)
    pruned = len(files) == 1 or skipping.files_to_read(files, "o_custkey", (100, 120)) < len(files)
    return t.read(skip={"o_custkey": (100, 120)}).filter(F.col("o_custkey").between(100, 120)).withColumn("pruned", F.lit(pruned))


@query("SELECT min(o_orderkey)::BIGINT AS low, max(o_orderkey)::BIGINT AS high, count(*)::BIGINT AS n FROM orders GROUP BY o_orderkey % 2")
def file_ranges(spark, sf_dir):
    """Bounds and rows of two files, from statistics alone."""
    t, rows = VersionedTable(spark, scratch(spark) / "orders"), table(spark, sf_dir, "orders").select(*ORDERS)
    t.create(rows.filter("o_orderkey % 2 = 0").coalesce(1))
    t.append(rows.filter("o_orderkey % 2 = 1").coalesce(1))
    files = skipping.active_files(t.path, 1)
    found = [(low, high, json.loads(files[path])["numRecords"]) for (low, high), path in skipping.ranges_by_file(t.path, 1, "o_orderkey")]
    return spark.createDataFrame(found, "low long, high long, n long")


@query("""
SELECT 2::BIGINT AS files, 2::BIGINT AS appended, (SELECT avg(w) FROM (SELECT max(o_orderkey) - min(o_orderkey) AS w FROM orders GROUP BY o_orderkey % 2)) AS width, count(*)::BIGINT AS n FROM orders""")
def table_detail(spark, sf_dir):
    """Files and mean width of their bounds, rows of the commits' own counts."""
    t, rows = VersionedTable(spark, scratch(spark) / "orders"), table(spark, sf_dir, "orders").select(*ORDERS)
    t.create(rows.filter("o_orderkey % 2 = 0").coalesce(1))
    t.append(rows.filter("o_orderkey % 2 = 1").coalesce(1))
    history = t.history()
    written = sum(int(h["operationMetrics"]["numOutputRows"]) for h in history)
    return one_row(spark, {"files": t.detail()["numFiles"], "appended": len(history), "width": skipping.average_width(t.path, 1, "o_orderkey"), "n": written})


@query("SELECT o_orderkey, o_custkey, o_totalprice, true AS dropped, true AS past_gone FROM orders WHERE o_orderkey % 3 = 0")
def vacuum_keeps_latest(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.overwrite(table(spark, sf_dir, "orders").select(*ORDERS).filter("o_orderkey % 3 = 0"))
    dropped = t.vacuum(1) > 0
    return t.read().withColumns({"dropped": F.lit(dropped), "past_gone": F.lit(raises(FileNotFoundError, lambda: t.restore(0)))})


@query("SELECT unnest(['several_matches', 'unknown_column', 'other_type', 'protected_column', 'existing_table']) AS name, true AS refused")
def write_guards(spark, sf_dir):
    t, changes = orders_table(spark, sf_dir), order_changes(spark, sf_dir)
    now = t.read()
    tried = {
        "several_matches": (ValueError, lambda: t.merge(changes.unionByName(changes), ["o_orderkey"])),
        "unknown_column": (ValueError, lambda: t.append(changes.withColumn("more", F.lit(1)))),
        "other_type": (TypeError, lambda: check_evolution(changes.withColumn("o_totalprice", F.lit("x")), now, ())),
        "protected_column": (ValueError, lambda: check_evolution(changes.drop("o_custkey"), now, ("o_custkey",))),
        "existing_table": (FileExistsError, lambda: t.create(changes)),
    }
    return spark.createDataFrame([(name, raises(*how)) for name, how in tried.items()], "name string, refused boolean")


# -------------------------------------------------------------- streams and audit


def streamed(spark: SparkSession, sf_dir: str, runs: int) -> dict[str, VersionedTable]:
    """Raw trips appended in two batches, the second with changed tips, and streamed in one run or after each."""
    root = scratch(spark)
    paths = {k: root / k for k in ("bronze", "silver", "rejected", "audit")}
    tables = {k: VersionedTable(spark, p) for k, p in paths.items()}
    rows = raw(spark, sf_dir)
    later = rows.filter("event_id % 6 = 0").withColumns({"tip_amount": F.col("tip_amount") + 1, "ingest_batch_id": F.lit("b2"), "ingested_at": F.timestamp_seconds(F.lit(1767312000))})
    for k, part in enumerate((rows.filter("event_id % 5 <> 0"), later)):
        tables["bronze"].append(part)
        if k == 1 or runs == 2:
            run_silver(spark, **paths, checkpoint=root / "checkpoint")
    return tables


STREAMED = f"SELECT event_id::VARCHAR AS trip_id, fare_amount, CASE WHEN event_id % 6 = 0 THEN tip_amount + 1 ELSE tip_amount END AS tip_amount, CASE WHEN event_id % 6 = 0 THEN 'b2' ELSE 'b1' END AS ingest_batch_id FROM ({REASONS}) WHERE len(reasons) = 0 AND (event_id % 5 <> 0 OR event_id % 6 = 0)"
SILVER_COLUMNS = "trip_id", "fare_amount", "tip_amount", "ingest_batch_id"


@query(STREAMED)
def stream_available_now(spark, sf_dir):
    return streamed(spark, sf_dir, 1)["silver"].read().select(*SILVER_COLUMNS)


@query(STREAMED)
def stream_resume(spark, sf_dir):
    return streamed(spark, sf_dir, 2)["silver"].read().select(*SILVER_COLUMNS)


@query(f"""
SELECT 'b1' AS ingest_batch_id, count(*)::BIGINT AS n FROM ({REASONS}) WHERE len(reasons) > 0 AND event_id % 5 <> 0
UNION ALL SELECT 'b2', count(*)::BIGINT FROM ({REASONS}) WHERE len(reasons) > 0 AND event_id % 6 = 0""")
def stream_quarantine(spark, sf_dir):
    return streamed(spark, sf_dir, 1)["rejected"].read().groupBy("ingest_batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT 0::BIGINT AS batch_id, count(*)::BIGINT AS incoming, count(*) FILTER (len(reasons) = 0)::BIGINT AS valid, count(*) FILTER (len(reasons) > 0)::BIGINT AS rejected, count(*) FILTER (len(reasons) = 0)::BIGINT AS winners, 'WRITE' AS silver_operation FROM ({REASONS}) WHERE event_id % 5 <> 0
UNION ALL SELECT 1, count(*), count(*) FILTER (len(reasons) = 0), count(*) FILTER (len(reasons) > 0), count(*) FILTER (len(reasons) = 0), 'MERGE' FROM ({REASONS}) WHERE event_id % 6 = 0""")
def stream_batch_audit(spark, sf_dir):
    return streamed(spark, sf_dir, 1)["audit"].read().select("batch_id", "incoming", "valid", "rejected", "winners", "silver_operation")


LATE = f"""
SELECT event_id::VARCHAR AS trip_id, fare_amount, CASE WHEN event_id % 6 = 0 THEN tip_amount + 1 WHEN event_id % 5 <> 0 THEN tip_amount ELSE tip_amount - 1 END AS tip_amount,
       CASE WHEN event_id % 6 = 0 THEN 'b2' WHEN event_id % 5 <> 0 THEN 'b1' ELSE 'b0' END AS ingest_batch_id FROM ({REASONS}) WHERE len(reasons) = 0 AND (event_id % 5 <> 0 OR event_id % 6 = 0 OR event_id % 7 = 0)"""


@query(LATE)
def stream_late_rows(spark, sf_dir):
    """Rows older than what Silver has change nothing there; those of new keys are kept."""
    tables = streamed(spark, sf_dir, 1)
    older = {"tip_amount": F.col("tip_amount") - 1, "ingest_batch_id": F.lit("b0"), "ingested_at": F.timestamp_seconds(F.lit(1767139200))}
    tables["bronze"].append(raw(spark, sf_dir).filter("event_id % 7 = 0").withColumns(older))
    run_silver(spark, **{k: t.path for k, t in tables.items()}, checkpoint=tables["bronze"].path.parent / "checkpoint")
    return tables["silver"].read().select(*SILVER_COLUMNS)


@query(f"SELECT *, 0::BIGINT AS updated, 0::BIGINT AS inserted FROM ({STREAMED})")
def stream_replay(spark, sf_dir):
    """All of Bronze streamed again, without the checkpoint: no row changes."""
    tables = streamed(spark, sf_dir, 1)
    run_silver(spark, **{k: t.path for k, t in tables.items()}, checkpoint=tables["bronze"].path.parent / "second")
    again = [h["operationMetrics"] for h in tables["silver"].history(2)]
    total = {c: F.lit(sum(int(m[name]) for m in again)).cast("long") for c, name in (("updated", "numTargetRowsUpdated"), ("inserted", "numTargetRowsInserted"))}
    return tables["silver"].read().select(*SILVER_COLUMNS).withColumns(total)


@query(f"""
SELECT bronze, silver, rejected, bronze - silver - rejected AS deduplicated, 0::BIGINT AS duplicate_keys FROM (SELECT
  count(*) FILTER (event_id % 5 <> 0)::BIGINT + count(*) FILTER (event_id % 6 = 0)::BIGINT AS bronze, count(*) FILTER (len(reasons) = 0 AND (event_id % 5 <> 0 OR event_id % 6 = 0))::BIGINT AS silver,
  count(*) FILTER (len(reasons) > 0 AND event_id % 5 <> 0)::BIGINT + count(*) FILTER (len(reasons) > 0 AND event_id % 6 = 0)::BIGINT AS rejected FROM ({REASONS}))""")
def reconciliation(spark, sf_dir):
    tables = streamed(spark, sf_dir, 1)
    return one_row(spark, profile.reconcile(*(tables[k].read() for k in ("bronze", "silver", "rejected"))))


@query(f"""
SELECT 2::BIGINT AS batches, count(*)::BIGINT AS incoming, count(*) FILTER (len(reasons) = 0)::BIGINT AS valid, count(*) FILTER (len(reasons) > 0)::BIGINT AS rejected, count(*) FILTER (len(reasons) = 0)::BIGINT AS winners
FROM (SELECT reasons FROM ({REASONS}) WHERE event_id % 5 <> 0 UNION ALL SELECT reasons FROM ({REASONS}) WHERE event_id % 6 = 0)""")
def audit_totals(spark, sf_dir):
    return profile.audit_totals(streamed(spark, sf_dir, 1)["audit"].read())


@query(f"""
SELECT 'schema' AS mode, true AS own_key, fare_amount + 2 AS fare_amount, tip_amount + 1 + 1 AS tip_amount, 1.5::DOUBLE AS surcharge_fee, tpep_pickup_datetime, 'cdc_demo' AS record_source FROM ({DIRTY}) WHERE event_id = 22
UNION ALL SELECT 'insert', false, fare_amount, tip_amount + 1, NULL, strftime(tpep_pickup_datetime::TIMESTAMP + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S'), 'cdc_demo' FROM ({DIRTY}) WHERE event_id = 22""")
def change_events(spark, sf_dir):
    """Events made of the newer of two rows of a key."""
    rows = raw(spark, sf_dir)
    newer = rows.withColumns({"tip_amount": F.col("tip_amount") + 1, "ingested_at": F.timestamp_seconds(F.lit(1767312000))})
    last = events.latest_of_key(rows.unionByName(newer), "22")
    shown = [F.expr("trip_id = '22'").alias("own_key"), "fare_amount", "tip_amount", "surcharge_fee", "tpep_pickup_datetime", "record_source"]
    schema, insert = (events.build_event(last, m, "22", "s1")[0].withColumn("mode", F.lit(m)) for m in ("schema", "insert"))
    return schema.unionByName(insert, allowMissingColumns=True).select("mode", *shown)


@query(f"SELECT 0::BIGINT AS version, 'WRITE' AS operation, tip_amount FROM ({TRIPS}) WHERE event_id = 5 UNION ALL SELECT 1, 'MERGE', 99.0::DOUBLE")
def point_lookup(spark, sf_dir):
    rows = trips(spark, sf_dir).select(F.col("event_id").cast("string").alias("trip_id"), "fare_amount", "tip_amount")
    t = VersionedTable(spark, scratch(spark) / "trips")
    t.create(rows)
    t.merge(rows.filter("trip_id = '5'").withColumn("tip_amount", F.lit(99.0)), ["trip_id"])
    found = audit.point_lookup(spark, t.path, "5", [0, 1])
    return spark.createDataFrame([(v, at["operation"], r["tip_amount"]) for v, at in found.items() for r in at["rows"]], "version long, operation string, tip_amount double")


@query("SELECT unnest(['history_available', 'historical_version_readable', 'update_evidence', 'insert_evidence', 'schema_column_present', 'schema_value_present', 'delta_log_evidence', 'protocol_evidence', 'non_destructive']) AS name, true AS holds")
def audit_checks(spark, sf_dir):
    rows = trips(spark, sf_dir).select(F.col("event_id").cast("string").alias("trip_id"), "fare_amount", "tip_amount").withColumns({"ingest_batch_id": F.lit("b0"), "record_source": F.lit("official_tlc")})
    t = VersionedTable(spark, scratch(spark) / "trips")
    t.create(rows.filter("trip_id <> '7'"))
    t.merge(rows.filter("trip_id = '5'").withColumn("tip_amount", F.lit(99.0)), ["trip_id"])
    t.merge(rows.filter("trip_id = '7'"), ["trip_id"])
    t.merge(rows.filter("trip_id = '9'").withColumn("surcharge_fee", F.lit(1.5)), ["trip_id"], evolve=True)
    checks = audit.run_audit(spark, t.path)["checks"]
    return spark.createDataFrame(list(checks.items()), "name string, holds boolean")


@query(f"SELECT count(*)::BIGINT AS n, count(DISTINCT trip_id)::BIGINT AS ids, sum((ingest_batch_id = 'events')::BIGINT)::BIGINT AS of_batch FROM (SELECT event_id AS trip_id, 'events' AS ingest_batch_id FROM ({TRIPS}))")
def bronze_ingest_once(spark, sf_dir):
    root = scratch(spark)
    add_trip_id(trips(spark, sf_dir)).write.parquet(str(root / "events.parquet"))
    for _ in range(2):
        bronze.run_bronze(spark, [root / "events.parquet"], root / "bronze")
    rows = VersionedTable(spark, root / "bronze").read()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trip_id").alias("ids"), F.sum((F.col("ingest_batch_id") == "events").cast("long")).alias("of_batch"))


# ------------------------------------------------------- extensions beyond parity


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("SELECT k, 'both' AS side FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'idle' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    all_keys, used = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select("o_custkey")
    return all_keys.intersect(used).withColumn("side", F.lit("both")).unionByName(all_keys.subtract(used).withColumn("side", F.lit("idle")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windowed_stream(spark, sf_dir):
    """Tumbling windows of a stream with a watermark, in update mode: the last count of each window counts."""
    root = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.repartition(4).write.parquet(str(root / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(root / "in"))
    counts = stream.withWatermark("ts", "60 days").groupBy(F.window("ts", "1 day"), "event_type").count()
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(root / "out"))
    counts.writeStream.outputMode("update").option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    last = spark.read.parquet(str(root / "out")).groupBy("window", "event_type").agg(F.max_by("count", "batch").alias("n"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
