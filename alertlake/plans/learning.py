"""Feature, training-set and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.operators import boosting, evaluation, features, normalize, scoring, training
from alertlake.plans.feeds import ATTRIBUTES_SQL, alert_attributes, table, topic_messages

GRADE_OF_STATUS = {"F": "BenignPositive", "O": "FalsePositive", "P": "TruePositive"}


# --------------------------------------------------------------- feature columns
def labelled_alerts(spark, sf_dir):
    """Events as a wide labelled alert table, all text, with many empty columns."""
    a = alert_attributes(spark, sf_dir)
    k = F.col("k")
    filled = {
        "Id": F.col("event_id").cast("string"), "IncidentId": F.col("user_id").cast("string"),
        "AlertId": F.col("alert_id"), "ActionGrouped": F.lit(None).cast("string"),
        "ActionGranular": F.lit(None).cast("string"),
        "Timestamp": F.when(k % 17 == 0, "not a time").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "MitreTechniques": F.when(k % 4 == 1, F.col("technique")).when(
            k % 4 == 2, F.concat(F.col("technique"), F.lit(";T1059;"), F.col("technique"))),
        "IncidentGrade": F.when(F.col("event_id") % 7 < 3, "BenignPositive").when(
            F.col("event_id") % 7 < 5, "FalsePositive").when(F.col("event_id") % 7 == 5, "TruePositive"),
        "OrgId": (F.col("user_id") % 50).cast("string"), "DetectorId": F.col("event_type"),
        "AlertTitle": F.col("title"), "Category": F.col("tactic"), "DeviceId": F.col("user_id").cast("string"),
        "Sha256": F.md5("alert_id"), "IpAddress": F.col("ip"), "AccountName": F.col("user_name"),
        "DeviceName": F.col("device"), "SuspicionLevel": F.col("suspicion"),
        "ThreatFamily": F.when(k % 33 == 0, "Emotet"), "Roles": F.when(k % 25 == 0, ""),
        "LastVerdict": F.when(k % 5 == 0, "Suspicious"), "CountryCode": (k % 20).cast("string"),
    }
    names = ("Id", "IncidentId", "AlertId", "ActionGrouped", "ActionGranular", "Timestamp",
             "MitreTechniques", "IncidentGrade", *fixed.CATEGORY_COLUMNS)
    return a.select("event_id", *[
        filled.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def timestamp_parts(spark, sf_dir):
    out = features.timestamp_parts(labelled_alerts(spark, sf_dir).select("event_id", "Timestamp"))
    return out.select("event_id", *[F.col(c).cast("double").alias(c) for c in ("hour_of_day", "day_of_week", "month")])


TIMESTAMP_PARTS_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT event_id, CASE WHEN k % 17 <> 0 THEN CAST(hour(ts) AS DOUBLE) END AS hour_of_day,
  CASE WHEN k % 17 <> 0 THEN CAST(isodow(ts) - 1 AS DOUBLE) END AS day_of_week,
  CASE WHEN k % 17 <> 0 THEN CAST(month(ts) AS DOUBLE) END AS month FROM a"""


def multi_value_stats(spark, sf_dir):
    base = labelled_alerts(spark, sf_dir).select(
        "event_id", "MitreTechniques", F.replace("MitreTechniques", F.lit(";"), F.lit(", ,")).alias("served"))
    out = features.multi_value_stats(base, column="MitreTechniques")
    out = features.multi_value_stats(out, column="served", sep=",", drop_blank=True, flag="has_served", count="served_count")
    return out.select("event_id", *[F.col(c).cast("int").alias(c) for c in out.columns if c != "event_id"])


MULTI_VALUE_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT event_id, CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS mitre_technique_count,
  CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END AS has_mitre,
  CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS served_count,
  CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END AS has_served FROM a"""


def null_indicators(spark, sf_dir):
    out = features.null_indicators(labelled_alerts(spark, sf_dir))
    return out.agg(*[F.sum(f"has_{c}").cast("long").alias(f"has_{c}") for c in fixed.SPARSE_COLUMNS])


NULL_INDICATORS_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT 0 AS "has_EmailClusterId", count(*) FILTER (WHERE k % 33 = 0) AS "has_ThreatFamily", 0 AS "has_ResourceType",
  0 AS "has_Roles", 0 AS "has_AntispamDirection", count(suspicion) AS "has_SuspicionLevel",
  count(*) FILTER (WHERE k % 5 = 0) AS "has_LastVerdict" FROM a"""


def fill_categories(spark, sf_dir):
    out = features.fill_categories(labelled_alerts(spark, sf_dir))
    return out.groupBy("Category", "SuspicionLevel", "EntityType", "ThreatFamily").agg(F.count(F.lit(1)).alias("alerts"))


FILL_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT coalesce(tactic, '__MISSING__') AS "Category", coalesce(suspicion, '__MISSING__') AS "SuspicionLevel",
  '__MISSING__' AS "EntityType", CASE WHEN k % 33 = 0 THEN 'Emotet' ELSE '__MISSING__' END AS "ThreatFamily",
  count(*) AS alerts FROM a GROUP BY ALL"""


def engineer_features(spark, sf_dir):
    out = features.engineer_features(labelled_alerts(spark, sf_dir)).withColumn(
        "label", features.encode_label(F.col("IncidentGrade")))
    return out.groupBy("label").agg(
        F.lit(len(out.columns)).alias("columns"), F.count(F.lit(1)).alias("alerts"),
        F.sum("hour_of_day").cast("long").alias("hours"), F.sum("mitre_technique_count").cast("long").alias("techniques"),
        F.count_distinct("Sha256").alias("hashes"), F.max("City").alias("city"))


ENGINEER_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT CASE WHEN event_id % 7 < 3 THEN 0 WHEN event_id % 7 < 5 THEN 1 WHEN event_id % 7 = 5 THEN 2 END AS label,
  52 AS columns, count(*) AS alerts, CAST(sum(hour(ts)) FILTER (WHERE k % 17 <> 0) AS BIGINT) AS hours,
  CAST(sum(CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END) AS BIGINT) AS techniques,
  count(DISTINCT alert_id) AS hashes, '__MISSING__' AS city FROM a GROUP BY 1"""


# --------------------------------------------------------------- target encoding
ENCODED = ("o_orderpriority", "c_mktsegment", "c_nationkey", "o_custkey")


def _graded_orders(spark, sf_dir):
    pairs = [part for k, v in GRADE_OF_STATUS.items() for part in (F.lit(k), F.lit(v))]
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn(
        "label", features.encode_label(F.try_element_at(F.create_map(*pairs), F.col("o_orderstatus"))))


def target_encoder_fit(spark, sf_dir):
    enc = features.fit_target_encoder(_graded_orders(spark, sf_dir), cols=ENCODED, label="label")
    return enc.select("column", "category", "n", F.round("enc", 9).alias("enc"), F.round("prior", 9).alias("prior"))


ENCODER_SQL = """
g AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey),
long AS (
  SELECT 'o_orderpriority' AS "column", o_orderpriority AS category, label FROM g
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, label FROM g
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), label FROM g
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), label FROM g),
pr AS (SELECT avg(label) AS prior FROM g),
enc AS (SELECT "column", category, count(*) AS n,
  CASE WHEN count(*) = 1 THEN any_value(prior) ELSE
    any_value(prior) * (1 - 1 / (1 + exp(-(count(*) - 1)))) + avg(label) * (1 / (1 + exp(-(count(*) - 1)))) END AS enc,
  any_value(prior) AS prior FROM long, pr GROUP BY 1, 2)"""


def _encoded(spark, sf_dir, **kw):
    g = _graded_orders(spark, sf_dir)
    enc = features.fit_target_encoder(g.filter(F.col("label") < 2), cols=ENCODED, label="label")
    return features.apply_target_encoder(g, enc, cols=ENCODED, id="o_orderkey", **kw).select(
        "o_orderkey", *[F.round(c, 9).alias(c) for c in ENCODED])


def target_encoder_apply(spark, sf_dir):
    return _encoded(spark, sf_dir)


def target_encoder_apply_large(spark, sf_dir):
    """Same result when ``o_custkey`` counts as too large to broadcast."""
    return _encoded(spark, sf_dir, broadcast_rows=30)


APPLY_SQL = "WITH " + ENCODER_SQL.replace(
    "FROM orders JOIN customer ON o_custkey = c_custkey)",
    "FROM orders JOIN customer ON o_custkey = c_custkey),\nall_rows AS (SELECT * FROM g)").replace(
    "label FROM g\n", "label FROM g WHERE label < 2\n").replace("label FROM g)", "label FROM g WHERE label < 2)").replace(
    "avg(label) AS prior FROM g)", "avg(label) AS prior FROM g WHERE label < 2)") + """
SELECT o_orderkey,
  round(coalesce((SELECT enc FROM enc WHERE "column" = 'o_orderpriority' AND category = o_orderpriority), prior), 9) AS o_orderpriority,
  round(coalesce((SELECT enc FROM enc WHERE "column" = 'c_mktsegment' AND category = c_mktsegment), prior), 9) AS c_mktsegment,
  round(coalesce((SELECT enc FROM enc WHERE "column" = 'c_nationkey' AND category = CAST(c_nationkey AS VARCHAR)), prior), 9) AS c_nationkey,
  round(coalesce((SELECT enc FROM enc WHERE "column" = 'o_custkey' AND category = CAST(o_custkey AS VARCHAR)), prior), 9) AS o_custkey
FROM all_rows, pr"""


def hash_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("c_mktsegment"),
        F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical", "Other")]),
                     (F.col("c_custkey") % 5 + 1).cast("int")).alias("SuspicionLevel"))
    return features.hash_encode(c, cols=["c_name", "c_nationkey", "c_mktsegment", "SuspicionLevel"])


HASH_SQL = """
SELECT c_custkey, ('0x' || substr(md5('0:' || c_name), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS c_name,
  ('0x' || substr(md5('1:' || c_nationkey), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS c_nationkey,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0.0
    ELSE ('0x' || substr(md5('2:' || c_mktsegment), 1, 8))::BIGINT / 4294967295.0::DOUBLE END AS c_mktsegment,
  CASE c_custkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.33 WHEN 2 THEN 0.66 WHEN 3 THEN 1.0
    ELSE ('0x' || substr(md5('3:Other'), 1, 8))::BIGINT / 4294967295.0::DOUBLE END AS "SuspicionLevel"
FROM customer"""

SHOWN = ("AlertTitle", "Category", "DeviceName", "DetectorId", "SuspicionLevel")


def feature_matrix(spark, sf_dir):
    """Canonical messages -> 49 features with the hash encoding."""
    ok, _ = normalize.canonicalize(topic_messages(spark, sf_dir), keep=("event_id",))
    resolved = features.resolve_features(ok, keep=("event_id",))
    matrix = features.assemble_features(
        features.hash_encode(resolved, cols=fixed.CATEGORY_COLUMNS), keep=("event_id",))
    rest = sum(F.col(c).cast("double") for c in fixed.CATEGORY_COLUMNS if c not in SHOWN)
    return matrix.select(
        "event_id", *[F.col(c).cast("int").alias(c) for c in fixed.NUMERIC_FEATURES],
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in SHOWN], F.round(rest, 6).alias("rest"))


def _hashed(position: int, value: str) -> str:
    return f"('0x' || substr(md5('{position}:' || {value}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


FEATURE_MATRIX_SQL = f"""
WITH {ATTRIBUTES_SQL},
c AS (SELECT *, CASE WHEN k % 9 = 8 THEN 'Medium' WHEN severity_word = 'informational' THEN 'Low'
    ELSE upper(severity_word[1]) || lower(severity_word[2:]) END AS severity
  FROM a WHERE k % 9 = 8 OR severity_word <> 'odd')
SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
  1 AS has_mitre, 1 AS mitre_technique_count, 0 AS "has_EmailClusterId", 0 AS "has_ThreatFamily",
  0 AS "has_ResourceType", 0 AS "has_Roles", 0 AS "has_AntispamDirection",
  CASE WHEN suspicion IS NULL THEN 0 ELSE 1 END AS "has_SuspicionLevel", 0 AS "has_LastVerdict",
  round(({_hashed(2, 'title')})::FLOAT::DOUBLE, 6) AS "AlertTitle", round(({_hashed(3, 'event_type')})::FLOAT::DOUBLE, 6) AS "Category",
  round(({_hashed(14, 'device')})::FLOAT::DOUBLE, 6) AS "DeviceName",
  CASE WHEN k % 2 = 0 THEN round(({_hashed(1, 'event_type')})::FLOAT::DOUBLE, 6) ELSE 0.0 END AS "DetectorId",
  round((CASE coalesce(suspicion, severity) WHEN 'Low' THEN 0.0 WHEN 'Medium' THEN 0.33 WHEN 'High' THEN 0.66 WHEN 'Critical' THEN 1.0
    ELSE {_hashed(32, 'suspicion')} END)::FLOAT::DOUBLE, 6) AS "SuspicionLevel",
  0.0 AS rest
FROM c"""


def dataset_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").drop("o_orderkey")
    return features.profile_dataset(o, label="o_orderstatus", categories=["o_orderpriority", "o_custkey"])


# ----------------------------------------------------------------- training sets
def balanced_weights(spark, sf_dir):
    w = training.balanced_weights(table(spark, sf_dir, "orders"), label="o_orderstatus")
    return w.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.max("weight"), 9).alias("weight"))


def _judged_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    l = table(spark, sf_dir, "labels")
    return d.join(l, "doc_id")


def classification_report(spark, sf_dir):
    judged = _judged_documents(spark, sf_dir).select(
        "quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"),
        F.when(F.col("n_chars") > 1000, F.lit(0.75)).otherwise(F.lit(0.25)).alias("score"))
    r = evaluation.classification_report(judged, label="quality", pred="guess", score="score")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_score")], "support")


REPORT_SQL = """
WITH j AS (SELECT quality AS l, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT cls, count(*) FILTER (WHERE l = cls AND p = cls) AS tp, count(*) FILTER (WHERE p = cls) AS pp,
  count(*) FILTER (WHERE l = cls) AS support FROM j, (SELECT unnest([0, 1]) AS cls) GROUP BY cls),
m AS (SELECT CAST(cls AS VARCHAR) AS class, coalesce(tp / nullif(pp, 0), 0) AS precision,
  coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1, support, tp FROM c),
u AS (SELECT class, precision, recall, f1, support FROM m
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  CAST(support AS BIGINT) AS support,
  (SELECT round(avg(CASE WHEN p = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END), 9) FROM j) AS mean_score FROM u"""


def confusion_matrix(spark, sf_dir):
    judged = _judged_documents(spark, sf_dir).select(
        "quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"))
    return evaluation.confusion_matrix(judged, label="quality", pred="guess", classes=[0, 1])


def class_capped_sample(spark, sf_dir):
    g = labelled_alerts(spark, sf_dir).select(
        "event_id", training.binary_group(F.col("IncidentGrade")).alias("grade"))
    return training.class_capped_sample(g, group="grade", n=1000, order=["event_id"])


def seeded_shuffle(spark, sf_dir):
    return training.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id", "lang"), key="doc_id")


def hash_split(spark, sf_dir):
    return training.hash_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), key="doc_id")


def head_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return training.head_per_group(d, group="source", order=["doc_id"], max_rows=400)


def _chat_columns(df, *keys):
    m = F.col("messages")
    return df.select(*keys, F.size(m).alias("turns"), F.md5(m[0]["content"]).alias("system_md5"),
                     m[1]["role"].alias("role"), m[1]["content"].alias("user_text"), m[2]["content"].alias("answer"))


def chat_rows_triage(spark, sf_dir):
    g = labelled_alerts(spark, sf_dir).filter(F.col("IncidentGrade").isNotNull())
    return _chat_columns(training.triage_chat_rows(g, keep=("event_id",)), "event_id")


CHAT_TRIAGE_SQL = f"""WITH {ATTRIBUTES_SQL}
SELECT event_id, 3 AS turns, '{{triage_md5}}' AS system_md5, 'user' AS role,
  'Alert Context:' || chr(10) || '{{{{' || chr(10) || '  "normalized_title": "' || title || '",' || chr(10)
  || '  "severity": "Medium",' || chr(10) || '  "category": "' || coalesce(tactic, 'Unknown') || '",' || chr(10)
  || '  "suspicion_level": "' || coalesce(suspicion, 'Unknown') || '"' || chr(10) || '}}}}' AS user_text,
  CASE WHEN event_id % 7 = 5 THEN '{{{{"grade": "TruePositive", "confidence": 0.95}}}}'
    ELSE '{{{{"grade": "FalsePositive", "confidence": 0.85}}}}' END AS answer
FROM a WHERE event_id % 7 <> 6"""


def _turn_pairs(spark, sf_dir):
    """User turns with the assistant turn that answers them."""
    c = table(spark, sf_dir, "conversations", heavy=True)
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return user.join(reply, ["conv_id", "turn"]).withColumn("pair", F.concat_ws("-", "conv_id", "turn"))


def chat_rows_summary(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir).withColumn(
        "summary", F.when(F.col("conv_id") % 10 == 0, "  \n").otherwise(F.col("prediction")))
    return _chat_columns(training.summary_chat_rows(
        pairs, report="reference", summary="summary", keep=("pair",)), "pair")


CHAT_SUMMARY_SQL = """
SELECT u.conv_id || '-' || u.turn AS pair, 3 AS turns, '{summary_md5}' AS system_md5, 'user' AS role,
  'Incident Report:' || chr(10) || u.text AS user_text, r.text AS answer
FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1
WHERE u.role = 'user' AND r.role = 'assistant' AND u.conv_id % 10 <> 0 AND trim(r.text, ' ' || chr(10)) <> ''"""


def rouge1_rouge2(spark, sf_dir):
    scored = evaluation.rouge_scores(_turn_pairs(spark, sf_dir), prediction="prediction", reference="reference", stem=False)
    return scored.select("pair", F.round("rouge1", 9).alias("rouge1"), F.round("rouge2", 9).alias("rouge2"))


ROUGE_SQL = """
WITH t AS (SELECT u.conv_id || '-' || u.turn AS pair,
    list_filter(string_split_regex(lower(r.text), '[^a-z0-9]+'), lambda x: x <> '') AS p,
    list_filter(string_split_regex(lower(u.text), '[^a-z0-9]+'), lambda x: x <> '') AS r
  FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1
  WHERE u.role = 'user' AND r.role = 'assistant'),
g AS (SELECT pair, n, s, gram, count(*) AS c FROM (
    SELECT pair, 1 AS n, 'p' AS s, unnest(p) AS gram FROM t UNION ALL SELECT pair, 1, 'r', unnest(r) FROM t
    UNION ALL SELECT pair, 2, 'p', unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) FROM t
    UNION ALL SELECT pair, 2, 'r', unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) FROM t)
  GROUP BY ALL),
o AS (SELECT x.pair, x.n, sum(least(x.c, y.c)) AS hit FROM g x JOIN g y
  ON x.pair = y.pair AND x.n = y.n AND x.gram = y.gram AND x.s = 'p' AND y.s = 'r' GROUP BY ALL)
SELECT t.pair, round(coalesce(2 * a.hit / nullif(len(p) + len(r), 0), 0)::DOUBLE, 9) AS rouge1,
  round(coalesce(2 * b.hit / nullif(greatest(len(p) - 1, 0) + greatest(len(r) - 1, 0), 0), 0)::DOUBLE, 9) AS rouge2
FROM t LEFT JOIN o a ON a.pair = t.pair AND a.n = 1 LEFT JOIN o b ON b.pair = t.pair AND b.n = 2"""


def rouge_l(spark, sf_dir):
    """ROUGE-L of each pair, without stemming."""
    scored = evaluation.rouge_scores(_turn_pairs(spark, sf_dir), prediction="prediction", reference="reference", stem=False)
    return scored.select("pair", F.round("rougeL", 9).alias("rougeL"))


def rouge_means(spark, sf_dir):
    """Means of all three measures, without stemming."""
    return evaluation.rouge(_turn_pairs(spark, sf_dir), prediction="prediction", reference="reference", stem=False).select(
        "metric", F.round("mean_f", 9).alias("mean_f"))


def rouge_stemmed(spark, sf_dir):
    """Stemming can only merge tokens, so ROUGE-1 does not fall; one row per pair says whether it held."""
    scored = _turn_pairs(spark, sf_dir).select("pair", "prediction", "reference")
    for name, stem in (("plain", False), ("stemmed", True)):
        scored = evaluation.rouge_scores(scored, prediction="prediction", reference="reference", stem=stem).withColumnRenamed(
            "rouge1", name).drop("rouge2", "rougeL")
    return scored.select("pair", (F.col("stemmed") >= F.col("plain") - 1e-12).alias("holds"))


# One row of the table of common lengths per token of the prediction; each is a running maximum.
_LCS_SQL = """
t AS (SELECT u.conv_id || '-' || u.turn AS pair,
    list_filter(regexp_split_to_array(lower(p.text), '[^a-z0-9]+'), lambda x: x <> '') AS p,
    list_filter(regexp_split_to_array(lower(u.text), '[^a-z0-9]+'), lambda x: x <> '') AS r
  FROM conversations u JOIN conversations p ON u.conv_id = p.conv_id AND p.turn = u.turn + 1
  WHERE u.role = 'user' AND p.role = 'assistant'),
l AS (
  SELECT pair, p, r, 0 AS i, list_transform(r, lambda x: 0) AS have FROM t
  UNION ALL
  SELECT pair, p, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_slice(
      list_transform(range(1, len(r) + 1), lambda k: CASE WHEN r[k] = p[i + 1] THEN (CASE WHEN k = 1 THEN 0 ELSE have[k - 1] END) + 1
        ELSE have[k] END), 1, j)))
  FROM l WHERE i < len(p)),
rl AS (SELECT pair, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * have[len(r)] / (len(p) + len(r)) END AS v FROM l WHERE i = len(p))"""
ROUGE_L_SQL = f"WITH RECURSIVE {_LCS_SQL} SELECT pair, round(v, 9) AS \"rougeL\" FROM rl"
ROUGE_MEANS_SQL = f"""WITH RECURSIVE {_LCS_SQL}, n AS ({ROUGE_SQL})
SELECT 'rouge1' AS metric, round(avg(rouge1), 9) AS mean_f FROM n UNION ALL SELECT 'rouge2', round(avg(rouge2), 9) FROM n
UNION ALL SELECT 'rougeL', round(avg(v), 9) FROM rl"""


# ------------------------------------------------------------------------ models
def _order_features(spark, sf_dir):
    g = _graded_orders(spark, sf_dir)
    return g.select("o_orderkey", F.col("label").cast("double").alias("label"), "o_orderstatus", "o_totalprice",
                    F.month("o_orderdate").cast("double").alias("month"), F.col("c_nationkey").cast("double").alias("nation"))


def score_alerts_mllib(spark, sf_dir):
    rows = training.balanced_weights(_order_features(spark, sf_dir), label="label")
    parts = training.hash_split(rows, key="o_orderkey", test=0.2)
    cols = ["o_totalprice", "month", "nation"]
    model = training.fit_triage_model(
        parts.filter(F.col("split") == "train"), features=cols, weight="weight")
    scored = scoring.score_alerts(parts.filter(F.col("split") == "test"), model)
    return scored.groupBy("model_grade").agg(
        F.count(F.lit(1)).alias("orders"), F.min("ml_score").alias("low"), F.max("ml_score").alias("high"))


def boosted_grades(spark, sf_dir):
    """Softmax boosting with balanced weights: loss per round falls, probabilities sum to one, all rows are scored."""
    rows = training.balanced_weights(_order_features(spark, sf_dir), label="label")
    parts = training.hash_split(rows, key="o_orderkey", test=0.2)
    model = boosting.fit_softmax_trees(
        parts.filter(F.col("split") == "train"), features=["o_totalprice", "month", "nation"], weight="weight", rounds=6,
        depth=4, rate=0.3, colsample=1.0)
    falls = all(a[0] > b[0] for a, b in zip(model.history, model.history[1:])) and len(model.history) > 1
    scored = boosting.score_softmax_trees(parts, model)
    whole = F.abs(F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p) - 1) < 1e-9
    return scored.groupBy("split", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("weight"), 6).alias("weight"),
        F.count(F.when(whole & F.col("ml_score").between(0, 1) & F.col("prediction").between(0, 2), 1)).alias("scored"),
        F.lit(falls).alias("loss_falls"))


def external_model(spark, sf_dir):
    """A predictor loaded once per task and applied to Arrow batches."""
    rows = _order_features(spark, sf_dir).select("o_orderkey", "o_totalprice", "nation")

    def load():
        return {"scale": 500000.0, "shift": 0.01}

    def predict(model, batch):
        score = batch["o_totalprice"] / model["scale"] + batch["nation"] * model["shift"]
        return score.to_frame("ml_score")

    return scoring.with_external_model(
        rows, features=["o_totalprice", "nation"], load_fn=load, predict_fn=predict, schema="ml_score double"
    ).select("o_orderkey", F.round("ml_score", 9).alias("ml_score"))


BOOSTED_SQL = """
WITH g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
    md5('42:' || o_orderkey) AS h FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, count(*) OVER () / ((SELECT count(DISTINCT label) FROM g) * count(*) OVER (PARTITION BY label)) AS weight FROM g)
SELECT CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS split, label,
  count(*) AS orders, round(sum(weight), 6) AS weight, count(*) AS scored, true AS loss_falls FROM w GROUP BY ALL"""


def _md5(text: str) -> str:
    import hashlib
    return hashlib.md5(text.encode()).hexdigest()


QUERIES = {f.__name__: f for f in (
    timestamp_parts, multi_value_stats, null_indicators, fill_categories, engineer_features,
    target_encoder_fit, target_encoder_apply, target_encoder_apply_large, hash_encode, feature_matrix,
    dataset_profile, balanced_weights, classification_report, confusion_matrix, class_capped_sample,
    seeded_shuffle, hash_split, head_per_group, chat_rows_triage, chat_rows_summary, rouge1_rouge2,
    rouge_l, rouge_means, rouge_stemmed, score_alerts_mllib, boosted_grades, external_model)}

_SHUFFLE = "md5('42:' || doc_id)"
ORACLES = {
    "timestamp_parts": TIMESTAMP_PARTS_SQL,
    "multi_value_stats": MULTI_VALUE_SQL,
    "null_indicators": NULL_INDICATORS_SQL,
    "fill_categories": FILL_SQL,
    "engineer_features": ENGINEER_SQL,
    "target_encoder_fit": f'WITH {ENCODER_SQL} SELECT "column", category, n, round(enc, 9) AS enc, round(prior, 9) AS prior FROM enc',
    "target_encoder_apply": APPLY_SQL,
    "target_encoder_apply_large": APPLY_SQL,
    "hash_encode": HASH_SQL,
    "feature_matrix": FEATURE_MATRIX_SQL,
    "dataset_profile": "SELECT o_orderstatus AS class, count(*) AS rows, 4 AS n_features, 2 AS n_categorical, "
                       "2 AS n_numeric FROM orders GROUP BY 1",
    "balanced_weights": "SELECT o_orderstatus, count(*) AS orders, round((SELECT count(*) FROM orders) / "
                        "((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 9) AS weight FROM orders GROUP BY 1",
    "classification_report": REPORT_SQL,
    "confusion_matrix": "SELECT quality AS label, count(*) FILTER (WHERE n_chars <= 1000) AS pred_0, "
                        "count(*) FILTER (WHERE n_chars > 1000) AS pred_1 FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "class_capped_sample": "SELECT event_id, grade FROM (SELECT event_id, grade, row_number() OVER (PARTITION BY grade ORDER BY event_id) AS n "
                           "FROM (SELECT event_id, CASE WHEN event_id % 7 = 5 THEN 'TruePositive' ELSE 'FalsePositive' END AS grade "
                           "FROM events WHERE event_id % 7 <> 6)) WHERE n <= 1000",
    "seeded_shuffle": f"SELECT doc_id, lang, {_SHUFFLE} AS shuffle_key FROM documents",
    "hash_split": f"SELECT doc_id, lang, CASE WHEN ('0x' || substr({_SHUFFLE}, 1, 8))::BIGINT % 10000 < 200 "
                  "THEN 'test' ELSE 'train' END AS split FROM documents",
    "head_per_group": "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n "
                      "FROM documents) WHERE n <= 400 // (SELECT count(DISTINCT source) FROM documents)",
    "chat_rows_triage": CHAT_TRIAGE_SQL.replace("{triage_md5}", _md5(fixed.TRIAGE_SYSTEM)).replace("{{", "{").replace("}}", "}"),
    "chat_rows_summary": CHAT_SUMMARY_SQL.replace("{summary_md5}", _md5(fixed.SUMMARY_SYSTEM)),
    "rouge1_rouge2": ROUGE_SQL,
    "rouge_l": ROUGE_L_SQL,
    "rouge_means": ROUGE_MEANS_SQL,
    "rouge_stemmed": "SELECT u.conv_id || '-' || u.turn AS pair, true AS holds FROM conversations u JOIN conversations p "
                     "ON u.conv_id = p.conv_id AND p.turn = u.turn + 1 WHERE u.role = 'user' AND p.role = 'assistant'",
    "boosted_grades": BOOSTED_SQL,
    "external_model": "SELECT o_orderkey, round(o_totalprice / 500000.0::DOUBLE + c_nationkey * 0.01::DOUBLE, 9) AS ml_score "
                      "FROM orders JOIN customer ON o_custkey = c_custkey",
}
