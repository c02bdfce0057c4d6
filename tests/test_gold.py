from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedimenta.operators.gold import apply_gold_filters, build_gold
from sedimenta.plans.gold import run_gold
from sedimenta.sources.versioned import VersionedTable

SCHEMA = "PULocationID long, p string, d string, fare_amount double, extra double, tip_amount double, trip_distance double, payment_type long"
# zone, pickup, dropoff, fare, extra, tip, distance, payment; the last of each has what a bound forbids, or a null
KEPT = [
    (48, "2025-07-19 22:03:11", "2025-07-19 22:31:40", 31.4, 2.5, 7.85, 6.2, 1),
    (48, "2025-07-20 22:58:00", "2025-07-20 23:09:30", 12.1, None, 0.0, 1.9, 2),
    (48, "2025-11-02 22:15:00", "2025-11-02 22:44:00", 27.9, 1.0, 4.2, 5.5, 1),
    (161, "2025-01-31 07:45:00", "2025-01-31 07:45:00", 500.0, 0.0, None, 100.0, 2),
]
FORBIDDEN = [
    (7, "2025-07-19 09:00:00", "2025-07-19 09:20:00", 500.01, 0.0, 3.0, 4.0, 1),
    (7, "2025-07-19 09:00:00", "2025-07-19 09:20:00", 18.0, 0.0, 3.0, 100.5, 1),
    (7, "2025-07-19 09:00:00", "2025-07-19 15:00:01", 18.0, 0.0, 3.0, 4.0, 1),
    (7, "2026-01-01 00:00:00", "2026-01-01 00:20:00", 18.0, 0.0, 3.0, 4.0, 1),
    (7, "2025-07-19 09:00:00", "2025-07-19 09:20:00", 18.0, 0.0, 3.0, None, 1),
]
ROWS = [*KEPT[:2], *FORBIDDEN, *KEPT[2:]]


def expected(rows):
    """Metrics by (zone, hour), added up row by row."""
    groups = {}
    for zone, pickup, _, fare, extra, tip, _, payment in rows:
        groups.setdefault((zone, int(pickup[11:13])), []).append((fare, extra or 0.0, tip or 0.0, payment))
    out = {}
    for key, trips in groups.items():
        cards = [t for t in trips if t[3] == 1]
        earned = [sum(t[:3]) for t in trips]
        share = 100 * sum(t[2] for t in cards) / sum(t[0] for t in cards) if cards else None
        out[key] = (len(trips), len(cards), sum(t[0] for t in trips) / len(trips), share, sum(earned), sum(earned) / len(trips))
    return out


def silver(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"tpep_pickup_datetime": F.to_timestamp("p"), "tpep_dropoff_datetime": F.to_timestamp("d")}).drop("p", "d")


def test_filters_and_metrics(spark):
    df = silver(spark)
    assert apply_gold_filters(df).count() == len(KEPT)
    want = expected(KEPT)
    got = {(r.PULocationID, r.pickup_hour): r for r in build_gold(df).collect()}
    assert set(got) == set(want) == {(48, 22), (161, 7)}
    for key, values in want.items():
        r = got[key]
        assert (r.trip_count, r.card_trip_count, r.avg_fare, r.tip_pct, r.total_driver_earnings, r.avg_driver_earnings) == pytest.approx(values)


def test_null_payment_and_zero_fares(spark):
    rows = [(1, *KEPT[0][1:7], None), (2, *KEPT[0][1:3], 0.0, 1.0, 2.0, 3.0, 1)]
    got = {r.PULocationID: r for r in build_gold(silver(spark, rows)).collect()}
    assert got[1].card_trip_count is None and got[1].tip_pct is None and got[2].tip_pct is None


def test_run_pins_a_version(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "s")
    t.create(silver(spark))
    t.append(silver(spark, ROWS[:1]))
    first = run_gold(spark, t.path, tmp_path / "g", 0)
    latest = run_gold(spark, t.path, tmp_path / "g")
    assert first == {"silver_version": 0, "groups": 2, "rows_used": len(KEPT), "rows_total": len(ROWS), "rows_filtered": len(FORBIDDEN)}
    gold = VersionedTable(spark, tmp_path / "g")
    assert latest["rows_used"] == len(KEPT) + 1 and gold.read().filter("silver_version = 1").count() == 2 and gold.detail()["numFiles"] == 1
    with pytest.raises(FileNotFoundError):
        run_gold(spark, tmp_path / "none", tmp_path / "g")
