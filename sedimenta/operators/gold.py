"""Served metrics by pickup zone and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusive upper bounds, year, and the card payment code.
MAX_FARE, MAX_DISTANCE, MAX_MINUTES, YEAR, CARD = 500, 100, 360, 2025, 1
PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def duration_minutes() -> Column:
    seconds = F.unix_timestamp(F.col(DROPOFF).cast("timestamp")) - F.unix_timestamp(F.col(PICKUP).cast("timestamp"))
    return seconds / 60


def apply_gold_filters(df: DataFrame, year: int = YEAR) -> DataFrame:
    """Rows within all bounds. A null in any of them drops the row, zero durations stay."""
    within = (F.col("fare_amount") <= MAX_FARE) & (F.col("trip_distance") <= MAX_DISTANCE)
    return df.filter(within & (duration_minutes() <= MAX_MINUTES) & (F.year(PICKUP) == year))


def build_gold(silver: DataFrame, year: int = YEAR) -> DataFrame:
    """One row for each pickup zone and hour.

    card_trip_count is null, not 0, if no trip has a payment type; tip_pct is the ratio of sums over card trips
    and null without one or with fares of zero. Sums and counts are partly aggregated before the one shuffle.
    """
    card = F.col("payment_type") == CARD
    earned = F.col("fare_amount") + F.coalesce("extra", F.lit(0.0)) + F.coalesce("tip_amount", F.lit(0.0))
    on_card = lambda c: F.sum(F.when(card, F.col(c)))
    trips = apply_gold_filters(silver, year)
    return trips.groupBy("PULocationID", F.hour(PICKUP).alias("pickup_hour")).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.avg("fare_amount").alias("avg_fare"),
        F.sum(card.cast("long")).alias("card_trip_count"),
        (F.try_divide(on_card("tip_amount"), on_card("fare_amount")) * 100).alias("tip_pct"),
        F.avg(earned).alias("avg_driver_earnings"),
        F.sum(earned).alias("total_driver_earnings"),
    )
