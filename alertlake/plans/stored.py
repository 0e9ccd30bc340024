"""Keyed-table and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import tables
from alertlake.plans.alerts import DEDUP_TTL_SQL, NORMALIZED_SQL, SCORED_SQL, _greedy_sql, _scored
from alertlake.plans.feeds import ATTRIBUTES_SQL, alert_attributes, table, topic_messages, vendor_payloads
from alertlake.session import scratch_path
from alertlake.streaming import dedup as stream_dedup
from alertlake.streaming import ingest as stream_ingest
from alertlake.streaming import triage as stream_triage


def _alert_rows(spark, sf_dir):
    a = alert_attributes(spark, sf_dir)
    return a.select(
        "event_id", "alert_id", "tenant_id", F.col("title").alias("normalized_title"),
        F.concat(F.lit('{"k":'), F.col("k"), F.lit("}")).alias("raw_data"), F.col("vendor").alias("source"),
        F.round(F.col("value") / 500, 6).alias("ml_score"), F.round(F.col("value") / 5, 4).alias("risk_score"),
        F.when(F.col("k") % 3 == 0, "Closed_FP").otherwise("Triaged").alias("status"),
        F.col("tactic").alias("mitre_tactic"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def _stored_and_updates(spark, sf_dir):
    """Even events form the stored table (first row per key), odd ones the updates."""
    rows = _alert_rows(spark, sf_dir)
    stored = tables.first_per_group(
        rows.filter(F.col("event_id") % 2 == 0), group=["tenant_id", "alert_id"], order=["event_id"])
    return stored.drop("event_id"), rows.filter(F.col("event_id") % 2 == 1)


def _shown(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


def upsert_alerts(spark, sf_dir):
    stored, updates = _stored_and_updates(spark, sf_dir)
    return _shown(tables.upsert_alerts(stored, updates, seq="event_id"))


def update_scores(spark, sf_dir):
    stored, updates = _stored_and_updates(spark, sf_dir)
    return _shown(tables.update_scores(stored, updates, seq="event_id"))


STORED_SQL = f"""
{ATTRIBUTES_SQL},
x AS (SELECT event_id, alert_id, tenant_id, title AS normalized_title, '{{"k":' || k || '}}' AS raw_data, vendor AS source,
  round(value / 500, 6) AS ml_score, round(value / 5, 4) AS risk_score, CASE WHEN k % 3 = 0 THEN 'Closed_FP' ELSE 'Triaged' END AS status,
  tactic AS mitre_tactic, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM a),
st AS (SELECT * FROM x WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, alert_id ORDER BY event_id) = 1),
uf AS (SELECT * FROM x WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY tenant_id, alert_id ORDER BY event_id) = 1),
ul AS (SELECT * FROM x WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY tenant_id, alert_id ORDER BY event_id DESC) = 1)"""

_UPDATED = """SELECT alert_id, tenant_id, st.normalized_title, st.raw_data, st.source, coalesce(ul.ml_score, st.ml_score) AS ml_score,
  coalesce(ul.risk_score, st.risk_score) AS risk_score, coalesce(ul.status, st.status) AS status, st.mitre_tactic,
  st.t AS created_at, coalesce(ul.t, st.t) AS updated_at FROM st LEFT JOIN ul USING (alert_id, tenant_id)"""

UPSERT_SQL = f"""WITH {STORED_SQL} {_UPDATED} UNION ALL
SELECT alert_id, tenant_id, uf.normalized_title, uf.raw_data, uf.source, ul.ml_score, ul.risk_score, ul.status, uf.mitre_tactic, uf.t, ul.t
FROM uf JOIN ul USING (alert_id, tenant_id) WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.alert_id = uf.alert_id AND st.tenant_id = uf.tenant_id)"""


def get_alert(spark, sf_dir):
    return tables.get_alert(_alert_rows(spark, sf_dir), alert_id="a-8-error", tenant_id="tenant-3").select(
        "event_id", "alert_id", "tenant_id", "status")


def upsert_summaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("tenant_id"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("exec "), "o_orderkey")).alias("executive_summary"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("analyst "), "o_orderkey")).alias("analyst_summary"),
        F.concat(F.lit("v"), F.col("o_orderkey") % 10).alias("model_version"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    first = tables.first_per_group(o, group=["case_id"], order=["seq"])
    later = o.join(first.select("seq"), "seq", "left_anti")
    return tables.upsert_summaries(first.drop("seq"), later, seq="seq")


SUMMARIES_SQL = """
WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN 'exec ' || o_orderkey END AS e, CASE WHEN o_orderstatus <> 'O' THEN 'analyst ' || o_orderkey END AS n,
  strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_custkey AS case_id, min_by(o_orderpriority, o_orderkey) AS tenant_id, max_by(e, o_orderkey) FILTER (WHERE e IS NOT NULL) AS executive_summary,
  max_by(n, o_orderkey) FILTER (WHERE n IS NOT NULL) AS analyst_summary, 'v' || (max(o_orderkey) % 10) AS model_version,
  min_by(d, o_orderkey) AS created_at, max_by(d, o_orderkey) AS updated_at FROM o GROUP BY 1"""


def active_model(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 20).cast("string")).alias("pipeline"),
        F.when(F.col("o_orderstatus") == "O", "production").otherwise("staging").alias("stage"),
        F.when(F.col("o_orderkey") % 100 > 0, F.col("o_orderdate")).alias("promoted_at"))
    return tables.active_model(o).select("id", "pipeline", "stage", F.date_format("promoted_at", "yyyy-MM-dd").alias("promoted_at"))


MODEL_SQL = """
SELECT o_orderkey AS id, o_orderpriority || '/' || (o_custkey % 20) AS pipeline, 'production' AS stage,
  CASE WHEN o_orderkey % 100 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS promoted_at
FROM orders WHERE o_orderstatus = 'O'
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 20
  ORDER BY CASE WHEN o_orderkey % 100 > 0 THEN o_orderdate END DESC NULLS FIRST, o_orderkey DESC) = 1"""


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("FAILED").alias("status"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate")).alias("end_time"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))


def latest_finished_run(spark, sf_dir):
    return tables.latest_finished_run(_runs(spark, sf_dir)).select("experiment", "run_id", "bytes")


def retention_report(spark, sf_dir):
    return tables.retention_report(_runs(spark, sf_dir), group=["experiment"], order=["end_time", "run_id"], run="run_id", size="bytes")


_RUNS_SQL = """r AS (SELECT o_custkey AS experiment, o_orderkey AS run_id, o_orderstatus = 'F' AS fin,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS end_time, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders)"""


def risk_queue(spark, sf_dir):
    rows = _alert_rows(spark, sf_dir).withColumn("risk_score", F.when(F.col("event_id") % 4 > 0, F.col("risk_score")))
    return tables.risk_queue(rows, tenant="tenant-1", status="Triaged", n=500, tie=["alert_id", "event_id"]).select(
        "event_id", "alert_id", "risk_score")


# ------------------------------------------------------------------------- streams
def dedup_stream_event(spark, sf_dir):
    """Three runs of one stream over time-ordered parts of ``events`` equal the batch rule."""
    e = table(spark, sf_dir, "events")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    day = F.dayofmonth("ts")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        e.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        kept = stream_dedup.dedup_stream(
            stream, key=["user_id", "event_type"], ttl_seconds=86400, clock="event", ts="ts", id="event_id")
        with stream_dedup.state_partitions(spark):
            kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
                "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


def _days(df, low, high):
    return df.filter(F.dayofmonth("ts").between(low, high))


def _greedy_stream(spark, source, out, checkpoint, schema):
    stream = spark.readStream.schema(schema).parquet(source)
    marked = stream_dedup.dedup_stream(
        stream, key=["user_id", "event_type"], ttl_seconds=86400, clock="event", ts="ts", id="event_id", mark=True)
    with stream_dedup.state_partitions(spark):
        marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()


def dedup_stream_expiry(spark, sf_dir):
    """Blocks of a day end many times over a month; every seventh event of the first days comes ten days late."""
    e = table(spark, sf_dir, "events")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    behind = (F.dayofmonth("ts") <= 5) & (F.col("event_id") % 7 == 0)
    for part in (_days(e, 1, 10).filter(~behind), _days(e, 11, 20), _days(e, 21, 31).unionByName(e.filter(behind))):
        part.write.mode("append").parquet(source)
        _greedy_stream(spark, source, out, checkpoint, e.schema)
    return spark.read.parquet(out).select("event_id", "deduplicated", "late")


def ingest_stream(spark, sf_dir):
    """Posted bodies in three runs -> normalised, repeats flagged, published; one row per event and fate.

    Alerts of one vendor are two hours older than their events, so some come a run after newer ones of their key.
    """
    p = vendor_payloads(spark, sf_dir)
    body = F.concat(
        F.lit('{"vendor": "'), "vendor", F.lit('", "event": '), "event_id",
        F.when(F.col("event_id") % 50 > 0, F.concat(F.lit(', "tenant_id": "'), "tenant_id", F.lit('"'))).otherwise(""),
        F.lit(', "raw": '), "raw", F.lit("}"))
    source, root, checkpoint = (scratch_path(spark, n) for n in ("posted", "ingest", "checkpoint"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        _days(p, low, high).select(body.alias("value")).write.mode("append").text(source)
        bodies = stream_triage.read_alert_stream(spark, source="text", path=source).withColumn(
            "event_id", F.get_json_object("value", "$.event").cast("long"))
        stream_ingest.run_ingest_stream(
            bodies, root=root, checkpoint=checkpoint, sink="parquet", options={"path": f"{root}/topic"}, id="event_id",
            lateness_seconds=4 * 3600, ordered=True, last=high == 31)
    outcomes = spark.read.parquet(f"{root}/outcomes")
    sent = spark.read.parquet(f"{root}/topic").select(
        F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.lit(1).alias("sent"))
    fates = outcomes.join(sent, "event_id", "full").select(
        "event_id", "source", F.lit("accepted").alias("outcome"), F.coalesce("deduplicated", F.lit(True)).alias("repeat"),
        F.coalesce("sent", F.lit(0)).alias("sent"))
    rejected = spark.read.parquet(f"{root}/rejected").select(
        "event_id", F.lit(None).cast("string").alias("source"), F.col("reason").alias("outcome"), F.lit(False).alias("repeat"),
        F.lit(0).alias("sent"))
    return fates.unionByName(rejected)


def dedup_stream_processing(spark, sf_dir):
    """Wall clock: the whole run takes less than the TTL, so one row per key passes."""
    e = table(spark, sf_dir, "events")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    empty_batches = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty_batches)
    spark.conf.set(empty_batches, "false")
    marked = stream_dedup.dedup_stream(stream, key=["user_id", "event_type"], ttl_seconds=7 * 86400, mark=True)
    with stream_dedup.state_partitions(spark):
        marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(empty_batches, before)
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum(F.col("deduplicated").cast("int")).alias("repeats"))


def triage_stream(spark, sf_dir):
    """Topic messages as text files -> stored and enriched alerts, in several micro-batches."""
    source, root, checkpoint = (scratch_path(spark, n) for n in ("topic", "alerts", "checkpoint"))
    topic_messages(spark, sf_dir).select("value").repartition(4).write.text(source)
    messages = stream_triage.read_alert_stream(spark, source="text", path=source, options={"maxFilesPerTrigger": "2"})
    stream_triage.run_triage_stream(messages, root=root, checkpoint=checkpoint).awaitTermination()
    enriched = spark.read.parquet(f"{root}/enriched").select(
        F.get_json_object("value", "$.alert_id").alias("alert_id"), F.lit(1).alias("sent"))
    stored = stream_triage.stored_alerts(spark, root)
    return stored.join(enriched, "alert_id", "left").groupBy("tenant_id", "status", "incident_grade").agg(
        F.count(F.lit(1)).alias("alerts"), F.count("sent").alias("sent"),
        F.sum(F.col("risk_score").cast("decimal(12,2)")).cast("double").alias("risk"))


DEDUP_LATE_SQL = f"""
WITH RECURSIVE e AS (SELECT *, day(ts) <= 5 AND event_id % 7 = 0 AS late FROM events),
s AS (SELECT *, ts AS t FROM e WHERE NOT late),
{_greedy_sql('s', ['user_id', 'event_type'], 'event_id', 86400)}
SELECT event_id, event_id NOT IN (SELECT first_id FROM kept) AS deduplicated, late FROM e"""

INGEST_STREAM_SQL = NORMALIZED_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
d AS (SELECT *, tenant_id || ':' || alert_id || ':' || normalized_title AS dk FROM n WHERE event_id % 50 > 0),
{_greedy_sql('d', ['dk'], 'event_id')}
SELECT event_id, source, 'accepted' AS outcome, event_id NOT IN (SELECT first_id FROM kept) AS repeat,
  CAST(event_id IN (SELECT first_id FROM kept) AS INTEGER) AS sent FROM d
UNION ALL
SELECT event_id, NULL, CASE WHEN event_id % 50 = 0 THEN 'tenant_required' ELSE 'unsupported_vendor' END, false, 0
FROM a WHERE event_id % 50 = 0 OR vendor = 'QRadar'"""

QUERIES = {f.__name__: f for f in (
    upsert_alerts, update_scores, get_alert, upsert_summaries, active_model, latest_finished_run, retention_report,
    risk_queue, dedup_stream_event, dedup_stream_expiry, dedup_stream_processing, ingest_stream, triage_stream)}

ORACLES = {
    "upsert_alerts": UPSERT_SQL,
    "update_scores": f"WITH {STORED_SQL} {_UPDATED}",
    "get_alert": f"WITH {STORED_SQL} SELECT event_id, alert_id, tenant_id, status FROM x WHERE alert_id = 'a-8-error' AND tenant_id = 'tenant-3'",
    "upsert_summaries": SUMMARIES_SQL,
    "active_model": MODEL_SQL,
    "latest_finished_run": f"WITH {_RUNS_SQL} SELECT experiment, run_id, bytes FROM r WHERE fin "
                           "QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY end_time DESC NULLS LAST, run_id DESC) = 1",
    "retention_report": f"WITH {_RUNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY end_time DESC NULLS LAST, run_id DESC) AS n FROM r) "
                        "SELECT experiment, any_value(run_id) FILTER (WHERE n = 1) AS kept_run, any_value(bytes) FILTER (WHERE n = 1) AS kept_size, "
                        "count(*) FILTER (WHERE n > 1) AS prunable_runs, CAST(coalesce(sum(bytes) FILTER (WHERE n > 1), 0) AS BIGINT) AS freed FROM n GROUP BY 1",
    "risk_queue": f"WITH {STORED_SQL} SELECT event_id, alert_id, CASE WHEN event_id % 4 > 0 THEN risk_score END AS risk_score FROM x "
                  "WHERE tenant_id = 'tenant-1' AND status = 'Triaged' ORDER BY 3 DESC NULLS LAST, alert_id, event_id LIMIT 500",
    "dedup_stream_event": DEDUP_TTL_SQL,
    "dedup_stream_expiry": DEDUP_LATE_SQL,
    "ingest_stream": INGEST_STREAM_SQL,
    "dedup_stream_processing": "SELECT user_id, event_type, count(*) AS alerts, count(*) - 1 AS repeats FROM events GROUP BY ALL",
    "triage_stream": f"WITH {SCORED_SQL} SELECT tenant_id, 'Triaged' AS status, grade AS incident_grade, count(*) AS alerts, count(*) AS sent, "
                     "CAST(sum(CAST(risk AS DECIMAL(12,2))) AS DOUBLE) AS risk FROM g GROUP BY ALL",
}
