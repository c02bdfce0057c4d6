"""Command line: python -m sedimenta.cli <command> ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Sequence

from sedimenta import config
from sedimenta.operators import profile
from sedimenta.plans import audit, benchmark, bronze, events, gold, pipeline, skipping
from sedimenta.session import create_spark
from sedimenta.sources.fixture import prepare_fixture
from sedimenta.sources.versioned import VersionedTable
from sedimenta.streaming.silver import MAX_BYTES, run_silver


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, **options: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for option, settings in options.items():
            c.add_argument(f"--{option.replace('_', '-')}", **settings)
        return c

    silver, bronze_at = {"default": str(config.SILVER)}, {"default": str(config.BRONZE)}
    add("bronze", "append raw files", input={"action": "append"}, output=bronze_at, batch_id={})
    add("fixture", "write the dirty sample", source={"default": str(config.SOURCE_DIR / config.FIXTURE_MONTH)}, dirty_output={"default": str(config.DIRTY_FIXTURE)}, sample_size={"type": int, "default": 5000})
    c = add("silver", "stream Bronze into Silver", bronze=bronze_at, silver=silver, rejected={"default": str(config.REJECTED)}, audit={"default": str(config.BATCH_AUDIT)}, checkpoint={"default": str(config.CHECKPOINT)}, interval={"default": "60 seconds"}, max_bytes_per_trigger={"default": MAX_BYTES})
    mode = c.add_mutually_exclusive_group()
    mode.add_argument("--once", action="store_true")
    mode.add_argument("--continuous", action="store_true")
    add("gold", "compute Gold", silver=silver, gold={"default": str(config.GOLD)}, silver_version={"type": int})
    add("audit", "prove what merges did", silver=silver, history={"type": int, "default": 100}, update_version={"type": int}, insert_version={"type": int}, trip_id={}, schema_column={"default": "surcharge_fee"}, output={})
    add("pipeline", "run layers in order", stages={"nargs": "+", "choices": ["bronze", "silver", "gold"], "default": ["bronze", "silver", "gold"]}, audit={"action": "store_true"})
    add("benchmark", "compare physical states", silver=silver, runs={"type": int, "default": 5}, output={"default": str(config.EVIDENCE / "benchmark.json")})
    add("rerun", "the point query on two versions", path=silver, versions={"type": int, "nargs": 2, "required": True}, zone={"type": int, "default": 132})
    add("event", "append a change event to Bronze", mode={"required": True, "choices": events.MODES}, trip_id={}, bronze=bronze_at, silver=silver)
    add("check", "reconcile the tables", bronze=bronze_at, silver=silver, rejected={"default": str(config.REJECTED)})
    add("outliers", "profile distributions", silver=silver)
    add("zero-duration", "profile trips that take no time", silver=silver)
    add("top-groups", "greatest Gold groups, and one zone by hour", gold={"default": str(config.GOLD)}, zone={"type": int, "default": 132})
    add("lookup", "one trip at two versions", trip={"required": True}, before={"type": int, "required": True}, after={"type": int, "required": True}, path=silver)
    add("file-stats", "bounds by file", path=silver, versions={"type": int, "nargs": "+", "required": True}, column={"default": "PULocationID"}, value={"type": int}, limit={"type": int, "default": 20})
    add("export-history", "history and batch audit as JSON", silver=silver, audit={"default": str(config.BATCH_AUDIT)}, output={"default": str(config.EVIDENCE / "silver_history.json")})
    return p


def _show(value: object) -> None:
    print(json.dumps(value, indent=2, default=str))


def _file_stats(a: argparse.Namespace) -> None:
    for version in a.versions:
        rows = skipping.ranges_by_file(a.path, version, a.column)
        print(f"version {version}: {len(rows)} files")
        for bounds, path in rows[: a.limit]:
            print("{!s:>10} {!s:>10}  {}".format(*(bounds or ("-", "-")), path))
        if a.value is not None:
            print(f"{a.column} = {a.value}: {skipping.files_to_read(skipping.active_files(a.path, version), a.column, (a.value, a.value))}/{len(rows)} files to read")


def _check(spark, a: argparse.Namespace) -> dict:
    """Reconciliation, rows by source and by reason, the last commits, files and bytes of Silver."""
    bronze_rows, silver, rejected = (VersionedTable(spark, p) for p in (a.bronze, a.silver, a.rejected))
    counts = lambda df: {str(r[0]): r["count"] for r in df.collect()}
    return {
        **profile.reconcile(bronze_rows.read(), silver.read(), rejected.read()),
        "sources": counts(profile.count_by(silver.read(), "record_source")),
        "reasons": counts(profile.reason_histogram(rejected.read())),
        "commits": silver.history(5),
        "table": silver.detail(),
    }


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well; 1 if a stage failed, 2 if the audit could not verify."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    if a.command == "file-stats":
        _file_stats(a)
        return 0
    spark = create_spark(f"sedimenta-{a.command}", a.master)
    read = lambda path: VersionedTable(spark, path).read()
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    try:
        if a.command == "pipeline":
            results = pipeline.run_pipeline(spark, [*a.stages, *["audit"] * a.audit])
            _show(results)
            return int(any(r["status"] != "OK" for r in results))
        if a.command == "audit":
            evidence = audit.run_audit(spark, a.silver, a.history, a.update_version, a.insert_version, a.trip_id, a.schema_column, a.output)
            _show(evidence)
            return 0 if evidence["verification"] == "PASS" else 2
        commands = {
            "bronze": lambda: bronze.run_bronze(spark, a.input, a.output, a.batch_id),
            "fixture": lambda: {"rows": prepare_fixture(spark, a.source, a.dirty_output, a.sample_size)},
            "silver": lambda: run_silver(spark, a.bronze, a.silver, a.rejected, a.audit, a.checkpoint, a.continuous, a.interval, a.max_bytes_per_trigger),
            "gold": lambda: gold.run_gold(spark, a.silver, a.gold, a.silver_version),
            "benchmark": lambda: benchmark.main_benchmark(spark, a.silver, a.runs, a.output),
            "event": lambda: events.append_event(spark, a.mode, a.trip_id, a.bronze, a.silver),
            "check": lambda: _check(spark, a),
            "outliers": lambda: profile.profile_outliers(read(a.silver)).first().asDict(),
            "zero-duration": lambda: rows(profile.zero_duration_profile(read(a.silver))),
            "rerun": lambda: benchmark.rerun(spark, a.path, tuple(a.versions), a.zone),
            "top-groups": lambda: {"top": rows(profile.top_groups(read(a.gold))), "zone": rows(profile.zone_by_hour(read(a.gold), a.zone))},
            "lookup": lambda: audit.point_lookup(spark, a.path, a.trip, (a.before, a.after)),
            "export-history": lambda: audit.export_history(spark, a.silver, a.audit, a.output),
        }
        _show(commands[a.command]())
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
