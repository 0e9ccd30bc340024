"""Alert stream: topic in, triage, stored alerts and enriched topic out."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from alertlake import fixed
from alertlake.operators import normalize, scoring
from alertlake.operators.tables import ALERT_FIXED, ALERT_MUTABLE
from alertlake.streaming import keyed

ALERT_KEYS = ("tenant_id", "alert_id")


def read_alert_stream(
    spark: SparkSession, *, source: str = "kafka", options: Mapping[str, str] | None = None, path: str | None = None,
) -> DataFrame:
    """Messages as a ``value`` text column.

    ``source="kafka"`` starts from the earliest offset and takes a bounded number
    of records per trigger; offsets live in the query's checkpoint. ``"text"``
    reads one message per line from new files.
    """
    settings = dict(options or {})
    if source == "kafka":
        settings = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "1000000", **settings}
        return spark.readStream.format("kafka").options(**settings).load().select(
            F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))
    return spark.readStream.format(source).options(**settings).load(path)


def to_messages(df: DataFrame, *, key: str = "alert_id") -> DataFrame:
    """``key, value`` rows for a topic sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_alert_stream(
    df: DataFrame, *, sink: str = "kafka", options: Mapping[str, str] | None = None, key: str = "alert_id"
) -> DataStreamWriter:
    """Writer for a topic; the Kafka sink waits for all replicas and is idempotent."""
    settings = dict(options or {})
    if sink == "kafka":
        settings = {"kafka.acks": "all", "kafka.enable.idempotence": "true", **settings}
    return to_messages(df, key=key).writeStream.format(sink).options(**settings)


def run_triage_stream(
    messages: DataFrame, *, root: str, checkpoint: str, value: str = "value", ingest_ts: str | None = None,
    trigger: Mapping[str, Any] = MappingProxyType({"availableNow": True}), fold_every: int = 16,
) -> StreamingQuery:
    """Canonical check, triage and routing of messages, with alerts kept by key.

    Each micro-batch is parsed once and scored once, into folders below ``root``: ``persisted`` (all alerts
    with status), ``enriched`` (messages of the forwarded ones), ``rejected`` (faulty messages and scores),
    and the keyed table ``alerts`` (see :mod:`alertlake.streaming.keyed`). Folders are named by the batch id
    and replaced on retry, so a repeated batch changes nothing. Without ``ingest_ts`` a message without time
    gets the time of its batch, which a repeated batch has too. ``trigger``: as of ``DataStreamWriter.trigger``.
    """
    received = ingest_ts or "_received"
    if not ingest_ts:  # one value a batch, kept in the query's log
        messages = messages.withColumn(received, F.current_timestamp())

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"batch={batch_id}"

        def stored(df: DataFrame, folder: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{root}/{folder}/{at}")
            return spark.read.schema(df.schema).parquet(f"{root}/{folder}/{at}")

        checked = stored(normalize.check_messages(batch, value=value, ingest_ts=received), "checked")
        alerts, out_of_bounds = scoring.check_scores(scoring.triage(checked.where("reason is null").select("alert.*")))
        persisted = stored(scoring.route_alerts(alerts)[0], "persisted")
        faulty = checked.where("reason is not null").select(value, "reason", "violations").unionByName(
            out_of_bounds.select(F.to_json(F.struct(*fixed.CANONICAL_FIELDS)).alias(value), "reason", "violations"))
        stored(faulty, "rejected")
        stored(to_messages(scoring.to_enriched(persisted.filter(~F.col("auto_closed")))), "enriched")
        keyed.merge_batch(alert_rows(persisted), f"{root}/alerts", batch_id, keys=ALERT_KEYS, seq="seq", fold_every=fold_every)

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def alert_rows(persisted: DataFrame) -> DataFrame:
    """Rows of the alert table; ``seq`` is the order in which updates of one batch apply."""
    return persisted.select(
        *ALERT_KEYS, *[c for c in ALERT_FIXED if c != "created_at"], F.col("timestamp").alias("created_at"),
        *[c for c in (*ALERT_MUTABLE, "incident_grade") if c != "updated_at"], F.col("timestamp").alias("updated_at"),
        F.struct(F.col("timestamp"), F.xxhash64(*persisted.columns)).alias("seq"))


def stored_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Current state per (tenant, alert): first description, newest scores; reads no batch that was folded in."""
    return keyed.read_table(spark, f"{root}/alerts", keys=ALERT_KEYS)
