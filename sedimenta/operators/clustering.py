"""Z-order clustering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

#: Bits of each column's rank in the Z value.
BITS = 6


def sortable(df: DataFrame, name: str) -> Column:
    """A column as a double that sorts alike; strings by their first six bytes."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_timestamp(col.cast("timestamp")).cast("double")
    return col.cast("double")


def rank(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds a value reaches."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)), F.lit(0))


def z_value(ranks: list[Column], bits: int = BITS) -> Column:
    """Bits of the ranks interleaved, the first column's highest bit first."""
    z = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for r in ranks:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(r, b).bitwiseAND(1).cast("long"))
    return z


def cluster(df: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """df in partitions of neighbouring values of all columns, sorted within each.

    One column is a range partitioning by itself. For more, values become ranks among approximate quantiles,
    so that skew doesn't empty the Z value's bits; nulls rank lowest.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown clustering columns: {', '.join(missing)}")
    if len(columns) == 1:
        return df.repartitionByRange(partitions, F.col(columns[0])).sortWithinPartitions(columns[0])
    keys = df.select(*(sortable(df, c).alias(c) for c in columns))
    steps = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    bounds = keys.approxQuantile(columns, steps, 0.005)
    ranks = [rank(sortable(df, c), sorted(set(own))) for c, own in zip(columns, bounds, strict=True)]
    return df.withColumn("__z", z_value(ranks)).repartitionByRange(partitions, "__z").sortWithinPartitions("__z").drop("__z")
