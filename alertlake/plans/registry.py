"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertlake.operators import dedup, normalize, scoring
from alertlake.plans import alerts, feeds, learning, stored, texts

_PLANS = (alerts, learning, texts, stored)
QUERIES = {name: fn for plan in _PLANS for name, fn in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = normalize.normalize_alerts(
        feeds.vendor_payloads(spark, sf_dir), ingest_ts="ts", keep=("event_id",))
    unique = dedup.dedup_exact(ok, key=["dedup_key"], order=["timestamp", "event_id"])
    persisted, _ = scoring.route_alerts(scoring.triage(unique))
    return persisted
