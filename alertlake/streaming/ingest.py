"""Ingestion stream: posted vendor alerts in, canonical alerts out to a topic, each once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertlake import fixed
from alertlake.operators import normalize
from alertlake.streaming.dedup import dedup_stream, state_partitions
from alertlake.streaming.triage import write_alert_stream

NOW = MappingProxyType({"availableNow": True})


def normalize_stream(bodies: DataFrame, *, value: str = "value", vendor_query: str | None = None, tenant_header: str | None = None,
                     ingest_ts: str | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(canonical alerts, rejected bodies with ``reason``) of posted bodies; row by row, no state.

    Bodies without a tenant are rejected (``tenant_required``). Without ``ingest_ts`` an alert without time
    gets the time of its micro-batch.
    """
    received = ingest_ts or "_received"
    rows = bodies if ingest_ts else bodies.withColumn(received, F.current_timestamp())
    posted = normalize.resolve_envelope(rows, body=value, vendor_query=vendor_query, tenant_header=tenant_header)
    has_tenant = F.coalesce(F.col("tenant_id"), F.lit("")) != ""
    ok, rejected = normalize.normalize_alerts(
        posted.where(has_tenant), ts_override="ts_override", ingest_ts=received, keep=keep)
    homeless = posted.where(~has_tenant).withColumn("reason", F.lit("tenant_required"))
    return ok, rejected.unionByName(homeless).select(*bodies.columns, "reason")


def _folder(spark: SparkSession, path: str) -> None:
    """A folder to stream from, which may not be there yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def run_ingest_stream(
    bodies: DataFrame, *, root: str, checkpoint: str, sink: str = "kafka", options: Mapping[str, str] | None = None,
    value: str = "value", vendor_query: str | None = None, tenant_header: str | None = None, ingest_ts: str | None = None,
    id: str | None = None, ttl_seconds: int = 3600, clock: str = "event", lateness_seconds: int = 3600,
    trigger: Mapping[str, Any] = NOW, ordered: bool = False, last: bool = True,
) -> list[StreamingQuery]:
    """Normalise, flag repeats and publish; gives the three running (or, with ``availableNow``, ended) queries.

    ``<root>/outcomes``: every accepted alert with ``deduplicated`` (and ``late``), written by the one query
    that holds the dedup state; ``<root>/rejected``: the other bodies with a reason; the topic (``sink``,
    ``options``): alerts that are no repeats, keyed by ``alert_id``. Publishing follows the outcomes as a
    stream of its own, so a failed topic holds up nothing else and a restart of any of the three goes on from
    its checkpoint: file sinks keep every row once, Kafka as its idempotent producer does. Alerts too late for
    the event clock are published: a repeat is harmless, a lost alert is not.

    ``ordered`` judges alerts in the order of their time over all triggers and runs (see :func:`dedup_stream`): an
    alert is published once the watermark has passed it. A bounded run that is not the ``last`` one leaves newer
    alerts waiting for the next run; the last one judges them all.
    """
    spark = bodies.sparkSession
    keep = [id] if id else []
    ok, rejected = normalize_stream(
        bodies, value=value, vendor_query=vendor_query, tenant_header=tenant_header, ingest_ts=ingest_ts, keep=keep)
    closing = None
    if ordered:
        _folder(spark, f"{checkpoint}/closing")
        closing = spark.readStream.schema("id long").parquet(f"{checkpoint}/closing")
    marked = dedup_stream(
        ok, key=["dedup_key"], ttl_seconds=ttl_seconds, clock=clock, ts="timestamp", id=id or "alert_id", mark=True,
        lateness_seconds=lateness_seconds, ordered=ordered, closing=closing)
    bounded = "availableNow" in trigger or "once" in trigger

    def start(df: DataFrame, name: str) -> StreamingQuery:
        query = df.writeStream.format("parquet").option("path", f"{root}/{name}").option(
            "checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start()
        if bounded:
            query.awaitTermination()
        return query

    with state_partitions(spark):
        queries = [start(marked, "outcomes")]
        if ordered and bounded and last:
            spark.range(1).coalesce(1).write.mode("append").parquet(f"{checkpoint}/closing")
            queries = [start(marked, "outcomes")]
    queries.append(start(rejected, "rejected"))
    _folder(spark, f"{root}/outcomes")
    outcomes = spark.readStream.schema(marked.schema).parquet(f"{root}/outcomes")
    repeat = F.col("deduplicated") & ~F.col("late") if clock == "event" else F.col("deduplicated")
    fresh = outcomes.where(~repeat).select(*fixed.CANONICAL_FIELDS, *keep)
    published = write_alert_stream(fresh, sink=sink, options=options).option(
        "checkpointLocation", f"{checkpoint}/published").trigger(**trigger).start()
    if bounded:
        published.awaitTermination()
    return [*queries, published]
