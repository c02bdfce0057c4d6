"""Versioned tables on Parquet: ACID writes, time travel, MERGE, compaction, clustering and restore.

Spark writes data files to a fresh folder that nothing refers to; a commit then makes them visible at once.
Reads resolve a snapshot to its list of files on the driver, drop the files whose bounds rule a filter out, and
hand the rest to the Parquet source with the snapshot's schema, so that Catalyst pushes filters and columns
down as for any Parquet scan. The folder has to be on a file system that the driver can list and link in.
"""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections.abc import Mapping
from datetime import UTC, date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.operators.clustering import cluster
from sedimenta.operators.evolution import check_evolution, union_schema
from sedimenta.plans.skipping import Range, overlaps, ranges_of
from sedimenta.sources import commitlog
from sedimenta.sources.commitlog import Action, CommitConflict, Snapshot
from sedimenta.sources.statistics import folder_statistics

#: Size that compaction packs files to, and tries of an append that loses a race.
TARGET_BYTES, RETRIES = 1 << 30, 20
#: Rows of a merge's source, counted, up to which it is sent to every executor instead of shuffling the table.
BROADCAST_ROWS = 100_000
#: Session setting and value under which files carry bounds of timestamps.
TIMESTAMPS = ("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
PROTOCOL = {"minReaderVersion": 1, "minWriterVersion": 2}


class VersionedTable:
    """A table at a path. Methods that write return the new version, or None where there was nothing to do."""

    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path = spark, Path(str(path).removeprefix("file://"))

    # ---------------------------------------------------------------- reading

    def exists(self) -> bool:
        return bool(commitlog.commit_versions(self.path))

    def version(self) -> int:
        return commitlog.commit_versions(self.path)[-1] if self.exists() else -1

    def snapshot(self, version: int | None = None) -> Snapshot:
        return commitlog.snapshot(self.path, version)

    def schema(self, version: int | None = None) -> StructType:
        return _schema(self.snapshot(version))

    def read(self, version: int | None = None, skip: Mapping[str, Range] | None = None) -> DataFrame:
        """A snapshot; skip maps columns to inclusive ranges and leaves out files that hold nothing in them.

        Skipping only drops files: the caller still filters rows.
        """
        if version is not None and version < 0:
            raise ValueError("version must be >= 0")
        state = self.snapshot(version)
        files = [p for p, a in state.files.items() if all(overlaps(a.get("stats"), c, r) for c, r in (skip or {}).items())]
        return self._scan(files, _schema(state))

    def where(self, condition: str | Column, version: int | None = None) -> DataFrame:
        """The rows of a snapshot that a condition holds for, read from the files whose bounds admit it."""
        version = self.version() if version is None else version
        return self.read(version, skip=ranges_of(self.read(version).filter(condition))).filter(condition)

    def read_files(self, paths: list[str], version: int | None = None) -> DataFrame:
        """Exactly the named data files, with the schema of a version."""
        return self._scan(paths, self.schema(version))

    def _scan(self, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(str(self.path / f) for f in files))

    # ---------------------------------------------------------------- history

    def history(self, limit: int | None = None) -> list[dict[str, Any]]:
        """Commits, newest first: version, timestamp, operation, operationParameters, operationMetrics."""
        if limit is not None and limit < 1:
            raise ValueError("limit must be >= 1")
        versions = commitlog.commit_versions(self.path)[::-1][:limit]
        return [self.commit_row(v) for v in versions]

    def commit_row(self, version: int) -> dict[str, Any]:
        info = next((a["commitInfo"] for a in commitlog.read_commit(self.path, version) if "commitInfo" in a), {})
        when = info.get("timestamp")
        return {
            "version": version,
            "timestamp": datetime.fromtimestamp(when / 1000, UTC) if when is not None else None,
            "operation": info.get("operation"),
            "operationParameters": info.get("operationParameters") or {},
            "operationMetrics": info.get("operationMetrics") or {},
        }

    def history_frame(self, limit: int | None = None) -> DataFrame:
        schema = "version long, timestamp timestamp, operation string, operationParameters map<string,string>, operationMetrics map<string,string>"
        return self.spark.createDataFrame([tuple(r.values()) for r in self.history(limit)], schema)

    def latest_commit(self) -> dict[str, Any] | None:
        return next(iter(self.history(1)), None)

    def detail(self) -> dict[str, Any]:
        state = self.snapshot()
        return {**(state.protocol or PROTOCOL), "partitionColumns": [], "numFiles": len(state.files), "sizeInBytes": sum(a["size"] for a in state.files.values())}

    # ---------------------------------------------------------------- writing

    def create(self, df: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """Version 0; an error if the table exists."""
        if self.exists():
            raise FileExistsError(f"Table exists: {self.path}")
        adds, metrics = self._write(df)
        actions = [{"protocol": PROTOCOL}, _metadata(union_schema(StructType(), df.schema)), *_txn(txn), *adds]
        return self._commit(0, "WRITE", {"mode": "ErrorIfExists"}, metrics, actions)

    def append(self, df: DataFrame, evolve: bool = False, txn: tuple[str, int] | None = None) -> int:
        """Add rows; columns that the table lacks are an error unless evolve. Retries behind other writers."""
        if not self.exists():
            return self.create(df, txn)
        adds, metrics = self._write(self._aligned(df, self.schema(), evolve))
        for _ in range(RETRIES):
            state = self.snapshot()
            merged = union_schema(_schema(state), df.schema)
            check_evolution(df, self.spark.createDataFrame([], _schema(state)), ())
            meta = [_metadata(merged)] if merged.names != _schema(state).names else []
            try:
                return self._commit(state.version + 1, "WRITE", {"mode": "Append"}, metrics, [*meta, *_txn(txn), *adds])
            except FileExistsError:
                continue
        raise CommitConflict(f"Append to {self.path} lost {RETRIES} races")

    def overwrite(self, df: DataFrame, replace_schema: bool = False) -> int:
        """Replace all rows; with replace_schema also the schema, else df has to fit it."""
        if not self.exists():
            return self.create(df)
        state = self.snapshot()
        if not replace_schema:
            df = self._aligned(df, _schema(state), False)
        adds, metrics = self._write(df)
        schema = union_schema(StructType(), df.schema)
        meta = [_metadata(schema)] if schema != _schema(state) else []
        removes = [commitlog.remove_action(p) for p in state.files]
        return self._commit_after(state, "WRITE", {"mode": "Overwrite"}, metrics, [*meta, *removes, *adds])

    def _aligned(self, df: DataFrame, schema: StructType, evolve: bool) -> DataFrame:
        """df checked against a schema; missing columns come back as null when read."""
        new = check_evolution(df, self.spark.createDataFrame([], schema), ())
        if new and not evolve:
            raise ValueError(f"Columns not in the table: {', '.join(new)}")
        return df

    def _write(self, df: DataFrame, data_change: bool = True) -> tuple[list[Action], dict[str, str]]:
        """Data files of df in a fresh folder, as add actions with statistics, and the metrics of the write."""
        folder = self.path / "data" / uuid.uuid4().hex
        conf, (name, kind) = self.spark.conf, TIMESTAMPS
        former = conf.get(name)
        conf.set(name, kind)
        try:
            df.write.parquet(str(folder))
        finally:
            conf.set(name, former)
        found = folder_statistics(folder)
        adds = [commitlog.add_action(str(f.relative_to(self.path)), n, s, data_change) for f, n, s in found]
        rows, size = sum(s["numRecords"] for _, _, s in found), sum(n for _, n, _ in found)
        return adds, {"numFiles": str(len(adds)), "numOutputRows": str(rows), "numOutputBytes": str(size)}

    def _commit(self, version: int, operation: str, parameters: dict[str, str], metrics: dict[str, str], actions: list[Action]) -> int:
        info = {"timestamp": int(time.time() * 1000), "operation": operation, "operationParameters": parameters, "operationMetrics": metrics}
        commitlog.publish(self.path, version, [{"commitInfo": info}, *actions])
        return version

    def _commit_after(self, state: Snapshot, operation: str, parameters: dict[str, str], metrics: dict[str, str], actions: list[Action]) -> int:
        """Commit what was computed from state. Behind pure appends a rewrite of other files may follow; else it conflicts."""
        gone = {a["remove"]["path"] for a in actions if "remove" in a}
        for version in range(state.version + 1, state.version + 1 + RETRIES):
            try:
                return self._commit(version, operation, parameters, metrics, actions)
            except FileExistsError:
                won = commitlog.read_commit(self.path, version)
                harmless = operation == "OPTIMIZE" and not any("metaData" in a or a.get("remove", {}).get("path") in gone for a in won)
                if not harmless:
                    raise CommitConflict(f"{operation} of {self.path} from version {state.version} met version {version}") from None
        raise CommitConflict(f"{operation} of {self.path} lost {RETRIES} races")

    # ---------------------------------------------------------------- merge

    def merge(
        self,
        source: DataFrame,
        on: list[str],
        *,
        update_condition: str | None = None,
        update: bool = True,
        evolve: bool = False,
        operation: str = "MERGE",
        protected: tuple[str, ...] = (),
    ) -> int:
        """Upsert by copy-on-write: update matched rows where the condition on s and t holds, insert the others.

        Source columns replace the target's; columns that source lacks keep their value in updates and are null
        in inserts. Several source rows for a matched target row are an error. Only files in which a row
        really changes are rewritten, and only files whose key bounds meet the source's are searched, once; inserts
        go to files of their own. A merge that changes nothing still commits, with zero metrics. The source may lack
        neither a key nor a protected column.
        """
        if not self.exists():
            return self.create(source)
        state = self.snapshot()
        schema = _schema(state)
        new = check_evolution(source, self.spark.createDataFrame([], schema), (*on, *protected))
        if new and not evolve:
            raise ValueError(f"Columns not in the table: {', '.join(new)}")
        merged = union_schema(schema, source.schema)
        source = source.persist()
        try:
            return self._merge(state, source, on, update_condition, update, merged, operation)
        finally:
            source.unpersist()

    def _merge(self, state: Snapshot, source: DataFrame, on: list[str], condition: str | None, update: bool, merged: StructType, operation: str) -> int:
        bounds = source.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(k)).alias(f"{n}_{k}") for k in on for n, f in (("low", F.min), ("high", F.max)))).first()
        candidates = [p for p, a in state.files.items() if all(_may_match(a.get("stats"), k, bounds[f"low_{k}"], bounds[f"high_{k}"]) for k in on)]
        if bounds["n"] <= BROADCAST_ROWS:
            source = F.broadcast(source)
        matched = F.expr(" AND ".join(f"s.`{k}` = t.`{k}`" for k in on))
        # source columns the table is about to gain can't be in the target's files: the merged schema reads them as null
        target = self._scan(candidates, merged).withColumn("__file", F.col("_metadata.file_path")) if candidates else None
        fires = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)

        removes: list[Action] = []
        adds: list[Action] = []
        updated = copied = 0
        if target is not None:
            # the one search: a row for each match, with its file and whether it fires; at most as many as the source has
            fired = fires if update else F.lit(False)
            hits = target.alias("t").join(source.alias("s"), matched).select(*(F.col(f"s.`{k}`").alias(k) for k in on), "__file", fired.alias("__fires")).persist()
            try:
                repeated = source.groupBy(*on).count().filter("count > 1")
                if not repeated.join(hits, on, "left_semi").isEmpty():
                    raise ValueError(f"Several source rows match one target row on {', '.join(on)}")
                touched = hits.filter("__fires").groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
                if touched:
                    updated = sum(r["n"] for r in touched)
                    names = {Path(r["__file"]).name for r in touched}
                    files = [p for p in candidates if Path(p).name in names]
                    adds, metrics = self._write(self._rewritten(files, source, matched, fires, merged))
                    removes = [commitlog.remove_action(p) for p in files]
                    copied = int(metrics["numOutputRows"]) - updated
                inserts, metrics = self._write(source.join(hits.select(*on).distinct(), on, "left_anti"))
            finally:
                hits.unpersist()
        else:
            inserts, metrics = self._write(source)
        inserted = int(metrics["numOutputRows"])
        meta = [_metadata(merged)] if merged.names != _schema(state).names else []
        counts = {
            "numSourceRows": bounds["n"],
            "numTargetRowsInserted": inserted,
            "numTargetRowsUpdated": updated,
            "numTargetRowsCopied": copied,
            "numTargetRowsDeleted": 0,
            "numTargetFilesAdded": len(adds) + len(inserts),
            "numTargetFilesRemoved": len(removes),
            "numOutputRows": inserted + updated + copied,
        }
        parameters = {"predicate": json.dumps(on), "condition": condition or ""}
        return self._commit_after(state, operation, parameters, {k: str(v) for k, v in counts.items()}, [*meta, *removes, *adds, *inserts])

    def _rewritten(self, files: list[str], source: DataFrame, matched, fires, merged: StructType) -> DataFrame:
        """Rows of touched files, with the source's values where the update fires."""
        joined = self._scan(files, merged).alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), matched, "left")
        joined = joined.withColumn("__fires", F.col("s.__hit").isNotNull() & fires)
        value = lambda c: F.when(F.col("__fires"), F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")) if c in source.columns else F.col(f"t.`{c}`")
        return joined.select(*(value(f.name).alias(f.name) for f in merged.fields))

    # ---------------------------------------------------------------- maintenance

    def optimize(self, zorder_by: list[str] | None = None, target_bytes: int = TARGET_BYTES) -> int | None:
        """Pack files toward target_bytes, or with zorder_by rewrite all rows clustered by these columns.

        Compaction takes only files below the target and needs two of them; the rows stay as they are, which
        the commit says with dataChange false.
        """
        state = self.snapshot()
        files = {p: a["size"] for p, a in state.files.items() if zorder_by or a["size"] < target_bytes}
        if not files or (len(files) < 2 and not zorder_by):
            return None
        size = sum(files.values())
        parts = max(1, -(-size // target_bytes))
        df = self._scan(list(files), _schema(state))
        df = cluster(df, zorder_by, parts) if zorder_by else df.coalesce(parts)
        adds, metrics = self._write(df, data_change=False)
        removes = [commitlog.remove_action(p, data_change=False) for p in files]
        counts = {"numRemovedFiles": str(len(removes)), "numAddedFiles": str(len(adds)), "numRemovedBytes": str(size), "numAddedBytes": metrics["numOutputBytes"]}
        return self._commit_after(state, "OPTIMIZE", {"zOrderBy": json.dumps(zorder_by or [])}, counts, [*removes, *adds])

    def restore(self, version: int) -> int:
        """A new commit with the files and schema of an old version; nothing in between is lost."""
        if version < 0:
            raise ValueError("version must be >= 0")
        state, old = self.snapshot(), self.snapshot(version)
        lost = [p for p in old.files if not (self.path / p).exists()]
        if lost:
            raise FileNotFoundError(f"{len(lost)} data files of version {version} are gone, e.g. {lost[0]}")
        removes = [commitlog.remove_action(p) for p in state.files if p not in old.files]
        adds = [{"add": {**a, "dataChange": True}} for p, a in old.files.items() if p not in state.files]
        meta = [{"metaData": {"schemaString": old.schema}}] if old.schema != state.schema else []
        counts = {"numRestoredFiles": str(len(adds)), "numRemovedFiles": str(len(removes))}
        return self._commit_after(state, "RESTORE", {"version": str(version)}, counts, [*meta, *removes, *adds])

    def vacuum(self, keep_versions: int) -> int:
        """Delete data folders that none of the last keep_versions versions refers to; returns how many went.

        Older versions can't be read or restored after that, and writers must be idle: a folder that awaits its
        commit looks the same.
        """
        if keep_versions < 1:
            raise ValueError("keep_versions must be >= 1")
        latest = self.version()
        kept = {Path(p).parent.name for v in range(max(0, latest - keep_versions + 1), latest + 1) for p in self.snapshot(v).files}
        gone = [d for d in (self.path / "data").iterdir() if d.name not in kept]
        for d in gone:
            shutil.rmtree(d)
        return len(gone)

    def applied(self, app: str, number: int) -> bool:
        """Whether a commit carries this application's transaction number or a later one; newest commits are asked first."""
        for version in reversed(commitlog.commit_versions(self.path)):
            marks = [a["txn"]["version"] for a in commitlog.read_commit(self.path, version) if a.get("txn", {}).get("appId") == app]
            if marks:
                return max(marks) >= number  # an application counts up
        return False


def _schema(state: Snapshot) -> StructType:
    return StructType.fromJson(json.loads(state.schema or '{"type": "struct", "fields": []}'))


def _metadata(schema: StructType) -> Action:
    return {"metaData": {"id": uuid.uuid4().hex, "schemaString": schema.json(), "partitionColumns": [], "createdTime": int(time.time() * 1000)}}


def _txn(txn: tuple[str, int] | None) -> list[Action]:
    return [{"txn": {"appId": txn[0], "version": txn[1]}}] if txn else []


def _may_match(stats: str | None, key: str, low: Any, high: Any) -> bool:
    """Whether a file's key bounds meet the source's; all files do if the source's bounds are unknown or of another kind."""
    plain = all(isinstance(x, (int, float, str, date)) for x in (low, high))
    return overlaps(stats, key, (low, high)) if plain else True
