"""Keyed tables: upserts, lookups and reports.

Each upsert returns the next state of the table. The batch of updates is reduced
to one row per key first (combined before the shuffle); the stored table is
shuffled only when the reduced batch is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.operators.joins import small_or_plain
from alertlake.operators.ranking import first_per_group, latest_per_group
from alertlake.session import materialize

ALERT_FIXED = ("normalized_title", "raw_data", "source", "mitre_tactic", "created_at")
ALERT_MUTABLE = ("ml_score", "risk_score", "status", "updated_at")


def _merge(current: DataFrame, batch: DataFrame, keys: Sequence[str], changed: dict[str, Column]) -> DataFrame:
    """``current`` with ``changed`` columns taken from ``batch``, plus the new keys of ``batch``.

    ``batch`` has one row per key and is computed once; columns of ``changed`` have the names of
    those they refer to as ``b.<col>``, and only these and the keys meet the stored table.
    """
    columns = current.columns
    batch = materialize(batch, "batch")
    small = small_or_plain(batch.select(*keys, *changed))
    c, b = current.alias("c"), small.alias("b")
    on = [F.col(f"c.{k}") == F.col(f"b.{k}") for k in keys]
    hit = F.col(f"b.{keys[0]}").isNotNull()
    updated = c.join(b, on, "left").select(*[
        F.when(hit, changed[name]).otherwise(F.col(f"c.{name}")).alias(name) if name in changed
        else F.col(f"c.{name}").alias(name) for name in columns])
    known = current.select(*keys).join(small.select(*keys), list(keys), "left_semi")
    fresh = batch.join(known, list(keys), "left_anti").select(*columns)
    return updated.unionByName(fresh)


def upsert_alerts(
    current: DataFrame, updates: DataFrame, *, keys: Sequence[str] = ("tenant_id", "alert_id"), seq: str,
    fixed_columns: Sequence[str] = ALERT_FIXED, mutable: Sequence[str] = ALERT_MUTABLE,
) -> DataFrame:
    """Insert, or on conflict update scores, status and ``updated_at`` only.

    Descriptive columns stay from the first insert. ``keys=("alert_id",)`` gives
    the key without tenant.
    """
    key_cols = list(keys)
    first = [c for c in updates.columns if c in fixed_columns or (c in ("tenant_id", "alert_id") and c not in keys)]
    batch = updates.groupBy(*key_cols).agg(
        F.min_by(F.struct(*first), F.col(seq)).alias("_f"), F.max_by(F.struct(*mutable), F.col(seq)).alias("_m"),
    ).select(*key_cols, "_f.*", "_m.*")
    return _merge(current, batch, key_cols, {m: F.col(f"b.{m}") for m in mutable})


def update_scores(
    current: DataFrame, updates: DataFrame, *, seq: str, keys: Sequence[str] = ("tenant_id", "alert_id"),
    mutable: Sequence[str] = ALERT_MUTABLE,
) -> DataFrame:
    """Update scores of existing alerts; unknown keys are ignored."""
    batch = small_or_plain(updates.groupBy(*keys).agg(
        F.max_by(F.struct(*mutable), F.col(seq)).alias("_m")).select(*keys, "_m"))
    joined = current.join(batch, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) if c in mutable else F.col(c)
        for c in current.columns])


def get_alert(alerts: DataFrame, *, alert_id: str, tenant_id: str) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return alerts.filter((F.col("alert_id") == alert_id) & (F.col("tenant_id") == tenant_id))


def insert_iocs(
    current: DataFrame, new: DataFrame, *, keys: Sequence[str] = ("alert_id", "ioc_type", "value"),
    order: Sequence[str] = ("source", "confidence"),
) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key (insert-ignore)."""
    unique = first_per_group(new, group=keys, order=order)
    return unique.join(current.select(*keys), list(keys), "left_anti")


def upsert_summaries(
    current: DataFrame, updates: DataFrame, *, seq: str, keys: Sequence[str] = ("case_id",),
    nullable: Sequence[str] = ("executive_summary", "analyst_summary"),
    always: Sequence[str] = ("model_version", "updated_at"), first: Sequence[str] = ("tenant_id", "created_at"),
) -> DataFrame:
    """Upsert where a null in the update keeps the stored text."""
    newest = [F.expr(f"max_by(`{c}`, `{seq}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in nullable]
    batch = updates.groupBy(*keys).agg(
        *newest, F.max_by(F.struct(*always), F.col(seq)).alias("_a"), F.min_by(F.struct(*first), F.col(seq)).alias("_f"),
    ).select(*keys, *nullable, "_a.*", "_f.*")
    changed = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"c.{c}")) for c in nullable}
    return _merge(current, batch, list(keys), {**changed, **{c: F.col(f"b.{c}") for c in always}})


def active_model(versions: DataFrame, *, stage: str = "production") -> DataFrame:
    """Latest row in a stage per model family; a null promotion time counts as newest."""
    return latest_per_group(
        versions.filter(F.col("stage") == stage), group=["pipeline"], order=["promoted_at", "id"])


def latest_finished_run(runs: DataFrame, *, status: str = "FINISHED") -> DataFrame:
    return latest_per_group(
        runs.filter(F.col("status") == status), group=["experiment"], order=["end_time", "run_id"], nulls_first=False)


def retention_report(
    df: DataFrame, *, group: Sequence[str], order: Sequence[str], run: str, size: str
) -> DataFrame:
    """Newest run per group, and how many older runs would free how much. Report only."""
    key = F.struct(*[p for c in order for p in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c))])
    agg = df.groupBy(*group).agg(
        F.max_by(F.struct(F.col(run).alias("run"), F.col(size).alias("size")), key).alias("k"),
        F.count(F.lit(1)).alias("runs"), F.sum(size).alias("total"))
    return agg.select(
        *group, F.col("k.run").alias("kept_run"), F.col("k.size").alias("kept_size"),
        (F.col("runs") - 1).alias("prunable_runs"), (F.col("total") - F.col("k.size")).alias("freed"))


def risk_queue(alerts: DataFrame, *, tenant: str, status: str, n: int = 100, tie: Sequence[str] = ("alert_id",)) -> DataFrame:
    """The ``n`` riskiest alerts of a tenant in a status (top-n, no full sort)."""
    return (
        alerts.filter((F.col("tenant_id") == tenant) & (F.col("status") == status))
        .orderBy(F.col("risk_score").desc_nulls_last(), *tie).limit(n))
