"""Inputs derived from the shared test tables.

The tables hold no alerts, so the queries derive vendor payloads, canonical
messages and annotated texts from whole tables; the row counts follow the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.session import prepare, spread


def table(spark: SparkSession, sf_dir: str, name: str, *, heavy: bool = False) -> DataFrame:
    """One shared table; ``heavy`` announces costly work per row."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


# An event takes some 20 bytes in its file and becomes an alert with dozens of columns: 50,000 rows a task.
ALERT_TASK_BYTES = 1 << 20
VENDOR_NAMES = ["Wazuh", "splunk", "Elastic-SIEM", "CrowdStrike", "QRadar"]
SEVERITY_NAMES = ["low", "MEDIUM", "High", "critical", "informational", "odd"]
ASSETS = ["domain controller", "database server", "mail gateway", "workstation",
          "dns resolver", "exchange backup", "laptop", "admin console"]
TACTICS = ["Lateral Movement", "Execution", "Privilege Escalation", "Impact", "Discovery",
           "Exfiltration"]
SUSPICIONS = ["Low", "Medium", "High", "Critical", "Weird"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def alert_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the attributes of an alert as plain columns."""
    e = spread(table(spark, sf_dir, "events"), ALERT_TASK_BYTES)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        _pick(VENDOR_NAMES, F.col("event_id") % 5).alias("vendor"),
        F.concat(F.lit("tenant-"), F.col("user_id") % 5).alias("tenant_id"),
        F.concat_ws("-", F.lit("a"), "user_id", "event_type").alias("alert_id"),
        F.concat(
            F.col("event_type"), F.lit(" on "), _pick(ASSETS, F.col("user_id") % 8),
            F.when(F.col("value") > 60, " after brute force")
            .when(F.col("value") > 40, " with repeated exfiltration").otherwise(""),
        ).alias("title"),
        (F.floor("value") % 18).cast("int").alias("level"),
        _pick(SEVERITY_NAMES, k % 6).alias("severity_word"),
        F.when(k % 7 < 6, _pick(TACTICS, F.least(k % 7, F.lit(5)))).alias("tactic"),
        F.concat(F.lit("T1"), F.lpad((k % 13).cast("string"), 3, "0")).alias("technique"),
        F.concat(F.lit("10.0."), F.col("user_id") % 250, F.lit("."), k).alias("ip"),
        F.concat(F.lit("user"), "user_id").alias("user_name"),
        F.concat(F.lit("host-"), F.col("user_id") % 40).alias("device"),
        F.when(k % 6 < 5, _pick(SUSPICIONS, F.least(k % 6, F.lit(4)))).alias("suspicion"),
        k.alias("k"),
    )


def vendor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, vendor, tenant_id, raw`` with one JSON layout per vendor."""
    a = alert_attributes(spark, sf_dir)

    def ts(fmt):
        return F.date_format("ts", fmt)

    wazuh = F.to_json(F.struct(
        F.col("alert_id").alias("id"),
        ts("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.struct(
            F.col("title").alias("description"), "level",
            F.array(F.col("event_type"), F.lit("syslog")).alias("groups"),
            F.struct(F.array("technique", F.lit("T9")).alias("id"),
                     F.array("tactic").alias("tactic")).alias("mitre"),
        ).alias("rule"),
        F.struct(F.col("device").alias("name")).alias("agent"),
        F.struct(F.col("ip").alias("srcip"), F.col("user_name").alias("srcuser")).alias("data"),
    ))
    splunk = F.to_json(F.struct(
        F.col("alert_id").alias("sid"),
        F.array(F.col("title"), F.lit("scheduled")).alias("search_name"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("_time"),
        F.struct(F.col("severity_word").alias("urgency"), F.col("ip").alias("src_ip"),
                 F.col("user_name").alias("user"), F.col("device").alias("host"),
                 F.col("event_type").alias("source")).alias("result"),
    ))
    elastic = F.to_json(F.struct(
        ts("yyyy-MM-dd HH:mm:ss").alias("@timestamp"),
        F.struct(F.struct(
            F.col("alert_id").alias("uuid"), F.col("severity_word").alias("severity"),
            F.struct(F.col("title").alias("name"), F.struct(
                F.struct(F.col("tactic").alias("name")).alias("tactic"),
                F.struct(F.col("technique").alias("id")).alias("technique"),
            ).alias("threat")).alias("rule"),
        ).alias("alert")).alias("kibana"),
        F.struct(F.col("ip").alias("ip")).alias("source"),
        F.struct(F.col("user_name").alias("name")).alias("user"),
        F.struct(F.col("device").alias("name")).alias("host"),
        F.struct(F.array("event_type", "vendor").alias("category")).alias("event"),
    ))
    crowd = F.to_json(F.struct(
        F.col("alert_id").alias("composite_id"), F.col("title").alias("display_name"),
        F.col("severity_word").alias("max_severity_displayname"),
        "tactic", F.col("technique").alias("technique_id"), F.col("ip").alias("local_ip"),
        F.lit("").alias("user_name"), F.col("device").alias("computer_name"),
        F.md5("alert_id").alias("sha256"),
        ts("yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("created_timestamp"),
    ))
    raw = (F.when(F.col("vendor") == "Wazuh", wazuh).when(F.col("vendor") == "splunk", splunk)
           .when(F.col("vendor") == "Elastic-SIEM", elastic).otherwise(crowd))
    return a.select("event_id", "ts", "vendor", "tenant_id", raw.alias("raw"))


def topic_messages(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """``event_id, ts, value``: canonical alerts as JSON, some with unknown keys; ``extra`` columns from the attributes."""
    a = alert_attributes(spark, sf_dir)
    value = F.to_json(F.struct(
        F.concat(F.col("alert_id"), F.lit("-"), F.col("event_id")).alias("alert_id"), "tenant_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.lower("vendor").alias("source"),
        F.col("title").alias("normalized_title"),
        F.when(F.col("k") % 9 != 8, F.when(
            F.col("severity_word").isin("informational"), F.lit("LOW")
        ).otherwise(F.col("severity_word"))).alias("severity"),
        F.struct(F.col("k").alias("score"), F.col("ip").alias("note")).alias("raw_data"),
        F.col("tactic").alias("mitre_tactic"), F.col("technique").alias("mitre_technique"),
        F.col("device").alias("device_name"), F.col("suspicion").alias("suspicion_level"),
        F.col("event_type").alias("category"),
        F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("DetectorId"),
        F.when(F.col("k") % 3 == 0, F.lit("kept")).alias("note"),
    ))
    return a.select("event_id", "ts", value.alias("value"), *extra)


# SQL twin of ``alert_attributes``, written for the checking engine.
ATTRIBUTES_SQL = """
a AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE event_id % 5 WHEN 0 THEN 'Wazuh' WHEN 1 THEN 'splunk' WHEN 2 THEN 'Elastic-SIEM'
      WHEN 3 THEN 'CrowdStrike' ELSE 'QRadar' END AS vendor,
    'tenant-' || (user_id % 5) AS tenant_id,
    'a-' || user_id || '-' || event_type AS alert_id,
    event_type || ' on ' || CASE user_id % 8 WHEN 0 THEN 'domain controller'
      WHEN 1 THEN 'database server' WHEN 2 THEN 'mail gateway' WHEN 3 THEN 'workstation'
      WHEN 4 THEN 'dns resolver' WHEN 5 THEN 'exchange backup' WHEN 6 THEN 'laptop'
      ELSE 'admin console' END
      || CASE WHEN value > 60 THEN ' after brute force'
              WHEN value > 40 THEN ' with repeated exfiltration' ELSE '' END AS title,
    CAST(floor(value) AS BIGINT) % 18 AS level,
    CASE kk % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'High' WHEN 3 THEN 'critical'
      WHEN 4 THEN 'informational' ELSE 'odd' END AS severity_word,
    CASE kk % 7 WHEN 0 THEN 'Lateral Movement' WHEN 1 THEN 'Execution'
      WHEN 2 THEN 'Privilege Escalation' WHEN 3 THEN 'Impact' WHEN 4 THEN 'Discovery'
      WHEN 5 THEN 'Exfiltration' END AS tactic,
    'T1' || lpad(CAST(kk % 13 AS VARCHAR), 3, '0') AS technique,
    '10.0.' || (user_id % 250) || '.' || kk AS ip,
    'user' || user_id AS user_name, 'host-' || (user_id % 40) AS device,
    CASE kk % 6 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical'
      WHEN 4 THEN 'Weird' END AS suspicion,
    kk AS k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kk FROM events)
)"""
