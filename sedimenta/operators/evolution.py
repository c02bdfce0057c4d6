"""Additive schema evolution."""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Columns that a source of Silver may never lack, as keys, order and provenance hang on them.
PROTECTED = ("trip_id", "ingested_at", "raw_record_hash", "ingest_batch_id", "business_hash")
#: Session setting under which a merge may add columns.
FLAG = "sedimenta.schema.autoMerge"


def check_evolution(source: DataFrame, target: DataFrame, protected: tuple[str, ...] = PROTECTED) -> list[str]:
    """Sorted columns that source adds to target.

    TypeError if a shared column has another type, whatever may be null in it; then ValueError if source lacks a
    protected column.
    """
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ours, theirs = kinds(source), kinds(target)
    both = sorted(ours.keys() & theirs.keys())
    if changed := [f"{n}: {theirs[n]} -> {ours[n]}" for n in both if ours[n] != theirs[n]]:
        raise TypeError(f"Column types may not change: {', '.join(changed)}")
    if lost := [n for n in protected if n not in ours]:
        raise ValueError(f"Source lacks protected columns: {', '.join(lost)}")
    return sorted(set(ours).difference(theirs))


def union_schema(old: StructType, new: StructType) -> StructType:
    """old, then the columns that only new has; all nullable."""
    fields = [*old.fields, *(f for f in new.fields if f.name not in old.names)]
    out = StructType()
    for f in fields:
        out = out.add(f.name, f.dataType, True)
    return out


class schema_auto_merge(AbstractContextManager):  # noqa: N801
    """Allow merges to add columns within the block. Blocks may nest; each leaves the setting as it found it."""

    def __init__(self, spark: SparkSession) -> None:
        self._conf, self._found = spark.conf, []

    def __enter__(self) -> None:
        self._found.append(self._conf.get(FLAG, ""))
        self._conf.set(FLAG, "true")

    def __exit__(self, *error: object) -> None:
        found = self._found.pop()
        self._conf.set(FLAG, found) if found else self._conf.unset(FLAG)


def auto_merge_enabled(spark: SparkSession) -> bool:
    return spark.conf.get(FLAG, "false") == "true"
