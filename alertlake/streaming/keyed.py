"""A keyed table fed by micro-batches: whole snapshots and the few batches after the newest one.

``<root>/delta/v=<batch>`` holds the reduced rows of one batch, ``<root>/base/v=<batch>`` the whole table
after that batch. Every ``fold_every`` batches the table is folded into a new base, so a row is rewritten
once per that many batches, and a read takes one base and fewer than ``fold_every`` small deltas.
All folders are named by the batch id and replaced on retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.tables import ALERT_FIXED
from alertlake.sources.writers import write_snapshot


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions in a folder, ascending: those that Spark has marked as written."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    marks = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS"))
    return sorted(int(m.getPath().getParent().getName()[2:]) for m in marks)


def _reduced(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: fixed columns of the first row, the others of the last."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    first = [c for c in others if c in ALERT_FIXED]
    last = [c for c in others if c not in ALERT_FIXED]
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*first), F.col(order)).alias("_f"), F.max_by(F.struct(*last), F.col(order)).alias("_m"),
    ).select(*keys, "_f.*", "_m.*").select(*keys, *others)


def _state(spark: SparkSession, root: str, keys: Sequence[str], upto: int | None = None) -> DataFrame | None:
    """The table after batch ``upto``, from what was there before it and its delta; else the newest table."""
    bases = [v for v in _versions(spark, f"{root}/base") if upto is None or v < upto]
    deltas = [v for v in _versions(spark, f"{root}/delta") if upto is None or v <= upto]
    since = bases[-1] if bases else -1
    parts = [(since, f"{root}/base/v={since}")] if bases else []
    parts += [(v, f"{root}/delta/v={v}") for v in deltas if v > since]
    if not parts:
        return None
    rows = None
    for version, path in parts:
        part = spark.read.parquet(path).withColumn("_v", F.lit(version).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    return _reduced(rows, keys, "_v") if len(parts) > 1 else rows.drop("_v")


def merge_batch(
    updates: DataFrame, root: str, batch_id: int, *, keys: Sequence[str], seq: str, fold_every: int = 16,
) -> None:
    """Upsert a batch: fixed columns stay from a key's first row, the others follow its newest one.

    ``fixed`` and changing columns are those of :func:`alertlake.operators.tables.upsert_alerts`, to which any
    number of batches is equal. ``seq`` orders the rows of a batch and is not kept.
    """
    spark = updates.sparkSession
    write_snapshot(_reduced(updates, keys, seq), f"{root}/delta", batch_id)
    if (batch_id + 1) % fold_every == 0:
        write_snapshot(_state(spark, root, keys, batch_id), f"{root}/base", batch_id)


def read_table(spark: SparkSession, root: str, *, keys: Sequence[str]) -> DataFrame:
    """The current table: one base and the deltas after it."""
    state = _state(spark, root, keys)
    if state is None:
        raise ValueError(f"no batch was written below {root}")
    return state


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete bases but the newest ``keep``, and the deltas that the oldest kept one holds; gives the deleted folders."""
    bases = _versions(spark, f"{root}/base")[-keep:]
    if len(bases) < keep:
        return []
    gone = [f"{root}/base/v={v}" for v in _versions(spark, f"{root}/base") if v < bases[0]]
    gone += [f"{root}/delta/v={v}" for v in _versions(spark, f"{root}/delta") if v <= bases[0]]
    jvm = spark.sparkContext._jvm
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


