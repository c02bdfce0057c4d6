"""All layers in order; the first failure stops the run."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession

from sedimenta import config
from sedimenta.plans.audit import run_audit
from sedimenta.plans.bronze import run_bronze
from sedimenta.plans.gold import run_gold
from sedimenta.sources.fixture import prepare_fixture
from sedimenta.streaming.silver import run_silver

LOG = logging.getLogger("sedimenta.pipeline")


def bronze_layer(spark: SparkSession) -> dict:
    if not config.DIRTY_FIXTURE.exists():
        prepare_fixture(spark, config.SOURCE_DIR / config.FIXTURE_MONTH, config.DIRTY_FIXTURE)
    return run_bronze(spark)


def audit_layer(spark: SparkSession) -> dict:
    evidence = run_audit(spark, output=config.EVIDENCE / "audit.json")
    if evidence["verification"] != "PASS":
        raise RuntimeError(f"Audit: {evidence['verification']}")
    return evidence["checks"]


LAYERS: dict[str, Callable[[SparkSession], dict]] = {"bronze": bronze_layer, "silver": run_silver, "gold": run_gold, "audit": audit_layer}


def run_pipeline(spark: SparkSession, stages: Sequence[str], layers: dict[str, Callable[[SparkSession], Any]] | None = None) -> list[dict[str, Any]]:
    """Status, seconds and result of each requested stage, in the order of the layers whatever that of the request."""
    layers = layers or LAYERS
    unknown = set(stages) - set(layers)
    if unknown:
        raise ValueError(f"Unknown stages: {', '.join(sorted(unknown))}")
    results: list[dict[str, Any]] = []
    failed = False
    for name in (n for n in layers if n in stages):
        if failed:
            results.append({"stage": name, "status": "SKIPPED"})
            continue
        began = time.perf_counter()
        try:
            row = {"stage": name, "status": "OK", "result": layers[name](spark)}
        except Exception as error:  # noqa: BLE001  reported to the caller, and it stops the run
            LOG.exception("Stage %s failed", name)
            row, failed = {"stage": name, "status": "FAILED", "error": str(error)}, True
        results.append(row | {"seconds": round(time.perf_counter() - began, 1)})
        LOG.info(json.dumps(results[-1], default=str))
    return results
