from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sedimenta.operators.clustering import cluster
from sedimenta.operators.evolution import FLAG, PROTECTED, check_evolution, schema_auto_merge
from sedimenta.plans import skipping
from sedimenta.plans.skipping import ranges_of
from sedimenta.sources import commitlog
from sedimenta.sources.commitlog import CommitConflict
from sedimenta.sources.versioned import VersionedTable


def frame(spark, rows, schema="k string, v double"):
    return spark.createDataFrame(rows, schema)


def table(spark, path, n=100, parts=4):
    t = VersionedTable(spark, path)
    t.create(spark.range(n).selectExpr("string(id) AS k", "double(id) AS v", "int(id % 10) AS z").repartitionByRange(parts, "v"))
    return t


def contents(df):
    return sorted(map(str, df.collect()))


def test_create_append_overwrite_and_time_travel(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    assert not t.exists() and t.latest_commit() is None
    assert t.append(frame(spark, [("a", 1.0)])) == 0
    assert t.append(frame(spark, [("b", 2.0)])) == 1
    with pytest.raises(FileExistsError):
        t.create(frame(spark, []))
    with pytest.raises(ValueError, match="not in the table: extra"):
        t.append(frame(spark, [("c", 3.0, 1)], "k string, v double, extra int"))
    assert t.append(frame(spark, [("c", 3.0, 1)], "k string, v double, extra int"), evolve=True) == 2
    with pytest.raises(TypeError):
        t.append(frame(spark, [("c", 3)], "k string, v int"))
    assert t.overwrite(frame(spark, [(7,)], "other int"), replace_schema=True) == 3
    assert [t.read(v).count() for v in range(4)] == [1, 2, 3, 1]
    assert t.read(1).columns == ["k", "v"] and t.read().columns == ["other"]
    assert t.read(2).filter("extra IS NULL").count() == 2
    with pytest.raises(ValueError):
        t.read(-1)
    with pytest.raises(ValueError):
        t.read(9)
    history = t.history()
    assert [r["version"] for r in history] == [3, 2, 1, 0] and len(t.history(2)) == 2
    assert history[0]["operationMetrics"]["numOutputRows"] == "1" and t.history_frame(1).first().operation == "WRITE"
    with pytest.raises(ValueError):
        t.history(0)
    assert t.detail()["numFiles"] == 1 and t.detail()["minReaderVersion"] == 1


def test_restore_and_vacuum(spark, tmp_path):
    t = table(spark, tmp_path / "t", 10, 1)
    t.overwrite(frame(spark, [(1,)], "other int"), replace_schema=True)
    assert t.restore(0) == 2 and t.read().count() == 10 and t.read().columns == ["k", "v", "z"]
    with pytest.raises(ValueError):
        t.restore(-1)
    assert t.vacuum(1) == 1
    with pytest.raises(FileNotFoundError):
        t.restore(1)
    assert t.read().count() == 10


def test_concurrent_appends_all_land(spark, tmp_path):
    t = table(spark, tmp_path / "t", 4, 1)
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: VersionedTable(spark, t.path).append(frame(spark, [(str(i), 1.0, 1)], "k string, v double, z int")), range(14)))
    assert sorted(versions) == list(range(1, 15)) and t.read().count() == 18
    assert t.snapshot(14).files == commitlog.Snapshot(-1).after(14, [a for v in range(15) for a in commitlog.read_commit(t.path, v)]).files
    stamps = [(t.path / "_log" / commitlog.commit_name(v)).stat().st_mtime_ns for v in range(15)]
    assert stamps == sorted(set(stamps)) and (t.path / "_log" / f"{10:020d}.checkpoint").exists()


def test_uncommitted_data_is_invisible_and_conflicts_are_errors(spark, tmp_path):
    t = table(spark, tmp_path / "t", 4, 1)
    t._write(frame(spark, [("x", 1.0, 1)], "k string, v double, z int"))
    assert t.read().count() == 4
    state = t.snapshot()
    t.overwrite(t.read().limit(1))
    with pytest.raises(CommitConflict):
        t._commit_after(state, "MERGE", {}, {}, [commitlog.remove_action(next(iter(state.files)))])
    with pytest.raises(FileExistsError):
        commitlog.publish(t.path, 1, [])
    assert not list((t.path / "_log").glob(".tmp*"))


def test_compaction_clustering_and_skipping_keep_rows(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    rows = spark.range(2000).selectExpr("string(id) AS k", "double(id) AS v", "int((id * 7919) % 200) AS z")
    t.create(rows.repartition(8))
    before = contents(t.read())
    assert t.optimize() == 1 and t.detail()["numFiles"] == 1 and t.optimize() is None
    assert t.optimize(["z"], target_bytes=4000) == 2
    assert contents(t.read()) == contents(t.read(0)) == before
    files = {v: skipping.active_files(t.path, v) for v in range(3)}
    need = {v: skipping.files_to_read(f, "z", (50, 50)) for v, f in files.items()}
    assert need[0] == 8 and need[1] == 1 and need[2] <= 2 < len(files[2])
    assert skipping.average_width(t.path, 2, "z") < skipping.average_width(t.path, 0, "z")
    skipped = t.read(skip={"z": (50, 60)})
    assert len(skipped.inputFiles()) < len(files[2])
    assert contents(skipped.filter("z BETWEEN 50 AND 60")) == contents(rows.filter("z BETWEEN 50 AND 60"))
    info = t.history(2)
    assert json.loads(info[0]["operationParameters"]["zOrderBy"]) == ["z"] and info[1]["operationMetrics"]["numRemovedFiles"] == "8"
    assert all(a["add"]["dataChange"] is False for a in commitlog.read_commit(t.path, 2) if "add" in a)


def test_two_column_clustering_narrows_both(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    rows = spark.range(4000).selectExpr("int((id * 7919) % 500) AS a", "string((id * 104729) % 500) AS b", "CAST(NULL AS DOUBLE) AS c")
    t.create(rows.repartition(8))
    t.optimize(["a", "b"], target_bytes=600)
    assert contents(t.read()) == contents(rows)
    assert skipping.average_width(t.path, 1, "a") < 0.8 * skipping.average_width(t.path, 0, "a")
    with pytest.raises(ValueError, match="Unknown"):
        cluster(rows, ["a", "nope"], 2)


def test_nan_has_no_bounds_and_is_found(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.create(frame(spark, [("a", 1.0), ("b", float("nan")), ("c", 50.0)]).coalesce(1))
    stats = next(iter(t.snapshot().files.values()))["stats"]
    assert skipping.column_range(stats, "v") is None and skipping.column_range(stats, "k") == ("a", "c")
    assert t.read(skip={"v": (100.0, 200.0)}).filter("v > 100").count() == 1


def test_log_of_another_writer(tmp_path):
    (tmp_path / "_log").mkdir()
    stats = lambda a, b: json.dumps({"minValues": {"z": a}, "maxValues": {"z": b}})
    add = lambda p, s=None: json.dumps({"add": {"path": p, "size": 1, **({"stats": s} if s else {})}})
    first = [add("a", stats(1, 265)), "", add("b", stats(2, 264)), add("c%20d", stats(1, 263))]
    second = [json.dumps({"remove": {"path": p}}) for p in ("a", "b", "c%20d")] + [add("z1", stats(1, 100)), add("z2", stats(100, 180)), add("z3", stats(181, 265))]
    for v, lines in enumerate((first, second)):
        (tmp_path / "_log" / commitlog.commit_name(v)).write_text("\n".join(lines))
    (tmp_path / "_log" / "junk.json").touch()
    v0, v1 = (skipping.active_files(tmp_path, v) for v in (0, 1))
    assert set(v0) == {"a", "b", "c d"} and commitlog.commit_versions(tmp_path) == [0, 1]
    assert skipping.files_to_read(v0, "z", (132, 132)) == 3
    assert [skipping.files_to_read(v1, "z", r) for r in ((132, 132), (90, 120), None)] == [1, 2, 3]
    assert skipping.files_to_read({"x": None}, "z", (1, 1)) == 1
    assert [p for _, p in skipping.ranges_by_file(tmp_path, 1, "z")] == ["z1", "z2", "z3"]
    with pytest.raises(FileNotFoundError):
        skipping.active_files(tmp_path, 2)
    (tmp_path / "_log" / commitlog.commit_name(2)).write_text("{}\nnot json")
    with pytest.raises(ValueError, match="Invalid JSON in 0+2.json line 2"):
        commitlog.read_commit(tmp_path, 2)


def test_evolution_guard_and_flag(spark):
    a, b = frame(spark, [], "trip_id string, v double, n int"), frame(spark, [], "trip_id string, v double")
    assert check_evolution(a, b, ("trip_id",)) == ["n"] and check_evolution(b, a, ()) == []
    with pytest.raises(TypeError):
        check_evolution(frame(spark, [], "v string"), b)
    with pytest.raises(ValueError, match="trip_id"):
        check_evolution(frame(spark, [], "v double"), b, ("trip_id",))
    with pytest.raises(ValueError, match="ingested_at, raw_record_hash, ingest_batch_id, business_hash"):
        check_evolution(a, b)
    with pytest.raises(RuntimeError), schema_auto_merge(spark):
        assert spark.conf.get(FLAG) == "true"
        raise RuntimeError
    assert spark.conf.get(FLAG, None) is None


def test_pushdown_reaches_the_scan(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    plan = t.read().filter(F.col("v") > 3).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,3.0)]" in plan and "z:" not in plan.split("ReadSchema")[1]


def test_filters_choose_files(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    for day in range(1, 6):
        rows = [(day * 100 + i, datetime(2025, 3, day, i), date(2025, 3, day), f"n{day}", float(day)) for i in range(10)]
        t.append(spark.createDataFrame(rows, "k long, at timestamp, day date, name string, x double").coalesce(1))
    files = lambda df: len(df.inputFiles())
    for condition, rows, most in (
        ("k = 305", 1, 1), ("k > 309 AND k < 410", 10, 2), ("302 >= k", 23, 3), ("at >= TIMESTAMP '2025-03-05 04:00:00'", 6, 1), ("at < TIMESTAMP '2025-03-02 00:00:00'", 10, 2),
        ("day = DATE '2025-03-02'", 10, 1), ("name = 'n4' AND k % 2 = 0", 5, 1), ("x BETWEEN 2 AND 3", 20, 2), ("k = 305 OR k = 105", 2, 5), ("k + 1 = 306", 1, 5), ("k = 999", 0, 0), ("true", 50, 5),
    ):
        df = t.where(condition)
        assert df.count() == rows, condition
        asked = t.read(skip=ranges_of(t.read().filter(condition)))
        assert files(asked) <= most, condition
    assert t.where("k < 150", 0).count() == 10 and t.where("k > 150", 0).count() == 0


def test_a_merge_searches_the_table_once(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, tmp_path / "t")
    t.create(spark.createDataFrame([(i, "a") for i in range(100)], "k long, v string").repartition(4))
    scans, scan = [], VersionedTable._scan
    monkeypatch.setattr(VersionedTable, "_scan", lambda self, files, schema: scans.append(len(files)) or scan(self, files, schema))
    t.merge(spark.createDataFrame([(5, "b"), (500, "b")], "k long, v string"), ["k"])
    assert scans == [4, 1] or scans[0] == 4 and len(scans) == 2  # the search, then the file to rewrite
    assert t.read().filter("v = 'b'").count() == 2 and t.read().count() == 101


def test_silver_needs_its_protected_columns(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    schema = ", ".join(f"{c} string" for c in PROTECTED)
    t.create(spark.createDataFrame([tuple("abcde")], schema))
    for c in PROTECTED:
        with pytest.raises(ValueError, match=c):
            t.merge(spark.createDataFrame([tuple("abcde")], schema).drop(c), ["trip_id"] if c != "trip_id" else ["ingested_at"], protected=PROTECTED)
