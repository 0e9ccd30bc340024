"""Source, tagging, entity and summary queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions import grounding
from alertlake.functions.text import computed_once, match_spans, sentences, token_spans, unicode_pattern, unnest, words
from alertlake.operators import entities, evaluation, features, summaries, tables, tagging, training
from alertlake.plans.feeds import table
from alertlake.plans.learning import _chat_columns, labelled_alerts
from alertlake.session import materialize, scratch_path
from alertlake.sources import readers, writers


# ----------------------------------------------------------------------- sources
def labelled_csv(spark, sf_dir):
    """Write the labelled alerts as CSV, read them back column-pruned."""
    path = scratch_path(spark, "labelled-csv")
    labelled_alerts(spark, sf_dir).drop("event_id").write.option("header", True).csv(path)
    rows, counts = readers.read_labelled_csv(spark, path, columns=["DetectorId", "SuspicionLevel"])
    per = rows.groupBy("IncidentGrade", "DetectorId", "SuspicionLevel").agg(F.count(F.lit(1)).alias("alerts"))
    return per.withColumn("dropped_rows", counts.select("dropped_rows").scalar())


LABELLED_CSV_SQL = """
WITH a AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS m FROM events)
SELECT CASE WHEN event_id % 7 < 3 THEN 'BenignPositive' WHEN event_id % 7 < 5 THEN 'FalsePositive' ELSE 'TruePositive' END AS "IncidentGrade",
  event_type AS "DetectorId", CASE m WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical'
    WHEN 4 THEN 'Weird' END AS "SuspicionLevel", count(*) AS alerts,
  (SELECT count(*) FROM a WHERE event_id % 7 = 6) AS dropped_rows
FROM a WHERE event_id % 7 <> 6 GROUP BY ALL"""


def _split_shards(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "shards")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test")
    staged = scratch_path(spark, "staged")
    d.select(F.col("text").alias("report"), F.substring("text", 1, 80).alias("summary"), "lang", split.alias("split")) \
        .write.partitionBy("split").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(folder).getFileSystem(conf)
    fs.mkdirs(hadoop.Path(folder))
    for name in readers.SPLITS:
        for i, status in enumerate(fs.globStatus(hadoop.Path(f"{staged}/split={name}/*.parquet"))):
            fs.rename(status.getPath(), hadoop.Path(f"{folder}/{name}-{i:05d}.parquet"))
    return folder


def split_parquet(spark, sf_dir):
    pairs = readers.read_split_parquet(spark, _split_shards(spark, sf_dir))
    return pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.length("report")).alias("report_chars"),
        F.sum(F.length("summary")).alias("summary_chars"))


SPLIT_SQL = """SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
  count(*) AS pairs, CAST(sum(length(text)) AS BIGINT) AS report_chars, CAST(sum(length(substr(text, 1, 80))) AS BIGINT) AS summary_chars
FROM documents GROUP BY 1"""


def _tag_of(token):
    """A tag from the word itself, so that sentences hold known, foreign and broken tags."""
    n = F.length(token)
    return (F.when(n % 7 == 0, "B-Malware").when(n % 7 == 1, "I-Malware").when(n % 11 == 2, "B-Tool")
            .when(n % 11 == 3, "B-Person").when(n % 11 == 4, "B-Location").when(n % 11 == 5, "I-System").otherwise("O"))


TAG_SQL = """CASE WHEN len(w) % 7 = 0 THEN 'B-Malware' WHEN len(w) % 7 = 1 THEN 'I-Malware' WHEN len(w) % 11 = 2 THEN 'B-Tool'
  WHEN len(w) % 11 = 3 THEN 'B-Person' WHEN len(w) % 11 = 4 THEN 'B-Location' WHEN len(w) % 11 = 5 THEN 'I-System' ELSE 'O' END"""
MAPPED_SQL = """CASE tag WHEN 'B-Tool' THEN 'B-Malware' WHEN 'B-Person' THEN 'B-Organization' WHEN 'B-Location' THEN 'O' ELSE tag END"""


def _tagged_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents", heavy=True)
    s = unnest(d, ["doc_id"], sentences(F.col("text")), pos="pos", name="sentence")
    s = computed_once(s, "tokens", words(F.col("sentence")))
    return computed_once(s, "tags", F.transform("tokens", _tag_of)).select("doc_id", "pos", "tokens", "tags")


def read_conll(spark, sf_dir):
    """Write every sentence as token/tag lines, read the files back as sentences."""
    path = scratch_path(spark, "conll")
    s = _tagged_sentences(spark, sf_dir)
    line = F.zip_with("tokens", "tags", lambda t, g: F.concat(t, F.lit("\t"), g))
    s.select(F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("value")).write.text(path)
    read = readers.read_conll(spark, path)
    read = read.withColumn("ner_tags", tagging.map_tags(F.col("ner_tags")))
    return read.groupBy(F.size("tokens").alias("n_tokens")).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum(F.size(F.filter("ner_tags", lambda t: t != "O"))).alias("tagged"),
        F.sum(F.length(F.array_join("tokens", ""))).alias("chars"))


# Sentences and words without look-around: a separator is put after sentence ends first.
SENTENCES_SQL = r"""
sent AS (SELECT doc_id, unnest(list_filter(string_split(
    regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))) AS s FROM documents),
tok AS (SELECT doc_id, s, regexp_extract_all(s, '\S+') AS words FROM sent)"""

READ_CONLL_SQL = f"""
WITH {SENTENCES_SQL},
w AS (SELECT len(words) AS n_tokens, list_sum(list_transform(words, lambda w: CASE WHEN {MAPPED_SQL.replace('tag', '(' + TAG_SQL + ')', 1).replace(' ELSE tag END', ' ELSE (' + TAG_SQL + ') END')} <> 'O' THEN 1 ELSE 0 END)) AS tagged,
  list_sum(list_transform(words, lambda w: len(w))) AS chars FROM tok)
SELECT n_tokens, count(*) AS sentences, CAST(sum(tagged) AS BIGINT) AS tagged, CAST(sum(chars) AS BIGINT) AS chars FROM w GROUP BY 1"""


def map_tags(spark, sf_dir):
    s = _tagged_sentences(spark, sf_dir)
    mapped = unnest(s, [], F.arrays_zip(
        F.col("tags"), tagging.map_tags(F.col("tags")).alias("mapped"),
        tagging.tag_ids(tagging.map_tags(F.col("tags"))).alias("tag_id")), name="r")
    return mapped.groupBy("r.tags", "r.mapped", "r.tag_id").agg(F.count(F.lit(1)).alias("tokens"))


MAP_TAGS_SQL = f"""
WITH {SENTENCES_SQL},
t AS (SELECT {TAG_SQL} AS tag FROM (SELECT unnest(words) AS w FROM tok))
SELECT tag AS tags, {MAPPED_SQL} AS mapped, CASE {MAPPED_SQL} WHEN 'O' THEN 0 WHEN 'B-Malware' THEN 1 WHEN 'I-Malware' THEN 2
  WHEN 'I-System' THEN 6 WHEN 'B-Organization' THEN 9 END AS tag_id, count(*) AS tokens FROM t GROUP BY ALL"""


def decode_bio(spark, sf_dir):
    s = _tagged_sentences(spark, sf_dir)
    s = unnest(s, ["doc_id"], tagging.decode_bio(F.col("tokens"), tagging.map_tags(F.col("tags"))), name="e")
    return s.groupBy("doc_id", "e.label").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.length("e.text")).alias("chars"), F.max(F.col("e.end") - F.col("e.start")).alias("longest"))


# Islands: an entity is a B- tag and the I- tags of its label that follow without a break.
DECODE_SQL = f"""
WITH {SENTENCES_SQL},
ids AS (SELECT row_number() OVER () AS sid, doc_id, words FROM tok),
x AS (SELECT sid, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ids),
y AS (SELECT sid, doc_id, w, i, {MAPPED_SQL.replace('tag', 'tag0').replace('ELSE tag0', 'ELSE tag0')} AS tag FROM (SELECT *, {TAG_SQL} AS tag0 FROM x)),
z AS (SELECT *, tag LIKE 'I-%' AND lag(tag) OVER s IS NOT NULL AND substr(lag(tag) OVER s, 3) = substr(tag, 3) AS cont FROM y WINDOW s AS (PARTITION BY sid ORDER BY i)),
isl AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY i) AS island FROM z),
ent AS (SELECT doc_id, sid, island, substr(min_by(tag, i), 3) AS label, count(*) AS n, sum(len(w)) + count(*) - 1 AS chars
  FROM isl GROUP BY ALL HAVING min_by(tag, i) LIKE 'B-%')
SELECT doc_id, label, count(*) AS entities, CAST(sum(chars) AS BIGINT) AS chars, max(n) AS longest FROM ent GROUP BY ALL"""


def entity_prf(spark, sf_dir):
    """Gold tags against the same tags with every fourth position ignored or altered."""
    s = _tagged_sentences(spark, sf_dir).withColumn("gold", tagging.map_tags(F.col("tags")))
    s = s.withColumn("pred", F.transform("gold", lambda t, i: F.when((i % 4 == 3) & (t != "O"), "O").otherwise(t)))
    return evaluation.entity_prf(s, gold="gold", pred="pred").select(
        "correct", "predicted", "gold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def entity_prf_ignored(spark, sf_dir):
    """The same scores from sub-word labels: behind every tag stands an ignored position with a predicted entity."""
    s = _tagged_sentences(spark, sf_dir).withColumn("gold", tagging.map_tags(F.col("tags")))
    s = s.withColumn("pred", F.transform("gold", lambda t, i: F.when((i % 4 == 3) & (t != "O"), "O").otherwise(t)))
    pieces = s.select(
        F.flatten(F.transform("gold", lambda t: F.array(t, F.lit("-100")))).alias("labels"),
        F.flatten(F.transform("pred", lambda t: F.array(t, F.lit("B-Malware")))).alias("predicted"))
    kept = pieces.select(*[
        evaluation.drop_ignored(F.col("labels"), F.col(c), ignored="-100").alias(n) for c, n in (("labels", "gold"), ("predicted", "pred"))])
    return evaluation.entity_prf(kept, gold="gold", pred="pred").select(
        "correct", "predicted", "gold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _prf_side(tag: str, name: str) -> str:
    return f"""
{name}z AS (SELECT sid, i, {tag} AS tag, lag({tag}) OVER (PARTITION BY sid ORDER BY i) AS prev FROM y),
{name}s AS (SELECT *, NOT (tag LIKE 'I-%' AND prev IS NOT NULL AND prev <> 'O' AND substr(prev, 3) = substr(tag, 3)) AS fresh FROM {name}z),
{name}i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY i) AS island FROM {name}s),
{name} AS (SELECT sid, min(i) AS a, max(i) AS b, substr(any_value(tag), 3) AS label FROM {name}i WHERE tag <> 'O' GROUP BY sid, island)"""


PRF_SQL = f"""
WITH {SENTENCES_SQL},
ids AS (SELECT row_number() OVER () AS sid, words FROM tok),
x AS (SELECT sid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ids),
y AS (SELECT sid, i, {MAPPED_SQL.replace('tag', 'tag0')} AS g FROM (SELECT *, {TAG_SQL} AS tag0 FROM x)),
{_prf_side('g', 'gold')},
{_prf_side("CASE WHEN (i - 1) % 4 = 3 THEN 'O' ELSE g END", 'pred')},
c AS (SELECT (SELECT count(*) FROM gold JOIN pred USING (sid, a, b, label)) AS correct,
  (SELECT count(*) FROM pred) AS predicted, (SELECT count(*) FROM gold) AS gold)
SELECT correct, predicted, gold, round(correct / predicted, 9) AS precision, round(correct / gold, 9) AS recall,
  round(2 * correct / (predicted + gold), 9) AS f1 FROM c"""


def chat_rows_entities(spark, sf_dir):
    s = _tagged_sentences(spark, sf_dir).withColumn("tags", tagging.map_tags(F.col("tags")))
    rows = _chat_columns(training.ner_chat_rows(s, tokens="tokens", tags="tags", keep=("doc_id", "pos")), "doc_id", "pos")
    return rows.select("doc_id", "turns", "system_md5", F.length("user_text").alias("user_chars"),
                       ((F.length("answer") - F.length(F.replace("answer", F.lit('"text"'), F.lit("")))) / 6).cast("int").alias("entities")) \
        .groupBy("doc_id", "turns", "system_md5").agg(
            F.sum("user_chars").alias("user_chars"), F.sum("entities").alias("entities"))


CHAT_ENTITIES_SQL = DECODE_SQL.rsplit("SELECT doc_id, label", 1)[0] + """
SELECT t.doc_id, 3 AS turns, '{entity_md5}' AS system_md5, CAST(sum(6 + list_sum(list_transform(words, lambda w: len(w))) + len(words) - 1) AS BIGINT) AS user_chars,
  coalesce((SELECT count(*) FROM ent WHERE ent.doc_id = t.doc_id), 0) AS entities FROM tok t GROUP BY t.doc_id"""


def chat_jsonl(spark, sf_dir):
    """Write chat rows as JSON lines and read them back."""
    s = _tagged_sentences(spark, sf_dir).withColumn("tags", tagging.map_tags(F.col("tags")))
    path = scratch_path(spark, "chat")
    writers.write_chat_jsonl(training.ner_chat_rows(s, tokens="tokens", tags="tags"), path)
    back = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    return back.select(F.posexplode("messages").alias("turn", "m")).groupBy("turn", "m.role").agg(
        F.count(F.lit(1)).alias("rows"))


def feature_table(spark, sf_dir):
    """Engineered and encoded features written with metadata; the metadata is the result."""
    rows = labelled_alerts(spark, sf_dir).filter(F.col("IncidentGrade").isNotNull())
    engineered = features.engineer_features(rows).withColumn("label", features.encode_label(F.col("IncidentGrade")))
    parts = training.hash_split(engineered, key="event_id", test=0.2)
    train, test = (parts.filter(F.col("split") == s) for s in ("train", "test"))
    enc = materialize(features.fit_target_encoder(train, cols=fixed.CATEGORY_COLUMNS, label="label"), "encoder")
    path = scratch_path(spark, "features")
    shaped = [features.assemble_features(
        features.apply_target_encoder(p, enc, cols=fixed.CATEGORY_COLUMNS), keep=("label",)) for p in (train, test)]
    writers.write_feature_table(*shaped, path, label="label", features=fixed.FEATURES, categories=fixed.CATEGORY_COLUMNS)
    return spark.read.schema(
        "train_samples long, test_samples long, class_distribution string, n_features int, n_categorical int, n_numeric int"
    ).json(f"{path}/metadata")


FEATURE_TABLE_SQL = """
WITH s AS (SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 0 WHEN event_id % 7 < 5 THEN 1 ELSE 2 END AS label,
  ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM events WHERE event_id % 7 <> 6)
SELECT count(*) FILTER (WHERE NOT is_test) AS train_samples, count(*) FILTER (WHERE is_test) AS test_samples,
  '{"0":' || count(*) FILTER (WHERE NOT is_test AND label = 0) || ',"1":' || count(*) FILTER (WHERE NOT is_test AND label = 1)
  || ',"2":' || count(*) FILTER (WHERE NOT is_test AND label = 2) || '}' AS class_distribution,
  49 AS n_features, 37 AS n_categorical, 12 AS n_numeric FROM s"""


def input_fingerprint(spark, sf_dir):
    """Hashes of the table files themselves."""
    return readers.input_fingerprint(spark, sf_dir).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")


def span_json(spark, sf_dir):
    """Documents as annotated JSON files, read back; indicator hits serve as annotations."""
    d = _located(spark, sf_dir)
    path = scratch_path(spark, "span-json")
    args = F.transform("hits", lambda h: F.struct(
        F.when(h["start"] % 3 == 0, "Person").when(h["start"] % 3 == 1, "Device").otherwise("Time").alias("type"),
        h["start"].alias("startOffset"), h["end"].alias("endOffset"), h["value"].alias("text")))
    d.select(F.col("text").alias("content"), F.struct(F.array(F.struct(F.array(F.struct(
        args.alias("argument"))).alias("events"))).alias("hopper")).alias("cyberevent")) \
        .filter(F.size("cyberevent.hopper") > 0).write.json(path)
    docs = spark.read.schema(readers.SPAN_SCHEMA).json(path).withColumn("doc", F.md5("content"))
    spans = tagging.collect_spans(docs, id="doc")
    return spans.select(F.explode("spans").alias("s")).groupBy("s.label").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends"))


# ---------------------------------------------------------------- offsets and tags
def tokens_with_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents", heavy=True)
    t = unnest(d, ["doc_id"], token_spans(F.col("text"))).select("doc_id", "item.*")
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


TOKENS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM t),
v AS (SELECT doc_id, len(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS n,
  sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id, count(*) AS tokens, CAST(sum(e - n) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM v GROUP BY 1"""

PLANTED = " contact CVE-2024-%04d at https://evil.example.com/p?id=%d file hash %s seen."


def _planted(spark, sf_dir):
    """Documents with indicators appended, built from the document id."""
    d = table(spark, sf_dir, "documents", heavy=True)
    n = F.col("doc_id")
    sha1 = F.sha1(n.cast("string"))
    tail = F.concat(
        F.lit(" contact CVE-2024-"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(" at https://evil.example.com/p?id="),
        n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit(" file hash "), sha1)).otherwise(F.concat(F.lit(" blob named as such: "), sha1)),
        F.when(n % 3 == 0, F.concat(F.lit(" sum "), F.md5(n.cast("string")))).otherwise(""),
        F.when(n % 5 == 0, " after Mimikatz phishing on a SERVER, server data breach").otherwise(""),
        F.lit(" seen."))
    return d.select("doc_id", "lang", F.length("text").alias("base"), F.concat("text", tail).alias("text"))


PLANTED_SQL = """
pl AS (SELECT doc_id, lang, len(text) AS base, text || ' contact CVE-2024-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')
  || ' at https://evil.example.com/p?id=' || doc_id
  || CASE WHEN doc_id % 2 = 0 THEN ' file hash ' ELSE ' blob named as such: ' END || sha1(CAST(doc_id AS VARCHAR))
  || CASE WHEN doc_id % 3 = 0 THEN ' sum ' || md5(CAST(doc_id AS VARCHAR)) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN ' after Mimikatz phishing on a SERVER, server data breach' ELSE '' END
  || ' seen.' AS text FROM documents)"""


def _located(spark, sf_dir):
    """Documents with every e-mail, address or URL-like hit as a span."""
    d = _planted(spark, sf_dir)
    pattern = unicode_pattern(rf"{fixed.EMAIL}|{fixed.IPV4}|https?://\S+|CVE-\d{{4}}-\d{{4,}}")
    return computed_once(d, "hits", match_spans(F.col("text"), pattern))


def drop_overlaps(spark, sf_dir):
    """Spans widened to both sides, so that neighbours and copies overlap."""
    d = _located(spark, sf_dir)
    wide = F.flatten(F.transform("hits", lambda h: F.array(
        F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit("Indicator").alias("label")),
        F.struct(h["start"].alias("start"), (h["end"] + 40).alias("end"), F.lit("System").alias("label")),
        F.struct((h["end"] - 2).alias("start"), (h["end"] + 60).alias("end"), F.lit("Malware").alias("label")))))
    return unnest(d, ["doc_id"], tagging.drop_overlaps(wide.cast(tagging.SPANS))).select("doc_id", "item.*")


# Greedy choice per document by repeated "first span at or after the last end".
HITS_SQL = r"""
pieces AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)|https?://\S+|CVE-\d{4}-\d{4,}') AS h,
  string_split_regex(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)|https?://\S+|CVE-\d{4}-\d{4,}') AS gap FROM pl),
hit AS (SELECT doc_id, v, CAST(e - len(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
  SELECT doc_id, v, sum(len(g) + len(v)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(h) AS v, unnest(gap[1:len(h)]) AS g, generate_subscripts(h, 1) AS i FROM pieces)))"""

OVERLAPS_SQL = f"""
WITH RECURSIVE {PLANTED_SQL}, {HITS_SQL},
wide AS (SELECT doc_id, s AS a, e AS b, 'Indicator' AS label FROM hit UNION ALL SELECT doc_id, s, e + 40, 'System' FROM hit
  UNION ALL SELECT doc_id, e - 2, e + 60, 'Malware' FROM hit),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, label) AS n FROM wide),
go AS (SELECT doc_id, n, a, b, label, b AS edge, true AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.n, o.a, o.b, o.label, CASE WHEN o.a >= g.edge THEN o.b ELSE g.edge END, o.a >= g.edge
  FROM go g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1)
SELECT doc_id, CAST(a AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end", label FROM go WHERE kept"""


def tag_tokens(spark, sf_dir):
    """Hit spans, widened by 12 characters, as BIO tags on white-space tokens."""
    d = _located(spark, sf_dir)
    spans = tagging.drop_overlaps(F.transform("hits", lambda h: F.struct(
        h["start"].alias("start"), (h["end"] + 12).alias("end"), F.lit("Indicator").alias("label"))).cast(tagging.SPANS))
    tagged = tagging.tag_tokens(d.withColumn("spans", spans), text="text", spans="spans")
    return tagged.select("doc_id", F.explode("ner_tags").alias("tag")).groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("tokens"))


TAG_TOKENS_SQL = rf"""
WITH RECURSIVE {PLANTED_SQL}, {HITS_SQL},
o AS (SELECT doc_id, s AS a, e + 12 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM hit),
go AS (SELECT doc_id, n, a, b, b AS edge, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, o.a, o.b, CASE WHEN o.a >= g.edge THEN o.b ELSE g.edge END, o.a >= g.edge
  FROM go g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1),
sp AS (SELECT doc_id, a, b FROM go WHERE kept),
tp AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM pl),
tu AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM tp),
tk AS (SELECT doc_id, i, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) - len(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS st FROM tu),
cov AS (SELECT tk.doc_id, tk.i, tk.st, sp.a FROM tk LEFT JOIN sp ON sp.doc_id = tk.doc_id AND sp.a <= tk.st AND tk.st < sp.b),
lab AS (SELECT doc_id, CASE WHEN a IS NULL THEN 'O' WHEN st = a OR (i > 1 AND lag(a) OVER (PARTITION BY doc_id ORDER BY i) IS NULL)
  THEN 'B-Indicator' ELSE 'I-Indicator' END AS tag FROM cov)
SELECT doc_id, tag, count(*) AS tokens FROM lab GROUP BY ALL"""


def align_labels(spark, sf_dir):
    """Words cut into pieces of four characters stand in for sub-word tokens."""
    s = _tagged_sentences(spark, sf_dir)
    ids = tagging.tag_ids(tagging.map_tags(F.col("tags")))
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.ceil(F.length(t) / 4).cast("int"))))
    special = F.array(F.lit(None).cast("int"))
    s = s.select("doc_id", F.concat(special, pieces, special).alias("word_ids"), ids.alias("ids"))
    s = computed_once(s.select("doc_id", F.struct("word_ids", "ids").alias("w")), "p", F.col("w"))
    s = unnest(s, ["doc_id"], tagging.align_labels(F.col("p.word_ids"), F.col("p.ids")), name="label")
    return s.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("pieces"))


ALIGN_SQL = f"""
WITH {SENTENCES_SQL},
w AS (SELECT doc_id, unnest(words) AS w FROM tok),
m AS (SELECT doc_id, CAST(ceil(len(w) / 4) AS BIGINT) AS n, CASE {MAPPED_SQL.replace('tag', '(' + TAG_SQL + ')')} WHEN 'O' THEN 0
  WHEN 'B-Malware' THEN 1 WHEN 'I-Malware' THEN 2 WHEN 'I-System' THEN 6 WHEN 'B-Organization' THEN 9 END AS id FROM w),
u AS (SELECT doc_id, id AS label, 1 AS c FROM m UNION ALL SELECT doc_id, -100, n - 1 FROM m WHERE n > 1
  UNION ALL SELECT doc_id, -100, 2 FROM tok)
SELECT doc_id, label, CAST(sum(c) AS BIGINT) AS pieces FROM u GROUP BY ALL"""


def augment_split(spark, sf_dir):
    """Benchmark texts appended to the train split only."""
    d = table(spark, sf_dir, "documents")
    base = training.hash_split(d.select(F.col("doc_id").alias("id"), "text"), key="id", test=0.1)
    extra = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return tagging.augment_split(base, extra).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


AUGMENT_SQL = """
WITH u AS (SELECT CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 < 1000 THEN 'test' ELSE 'train' END AS split, text
  FROM documents UNION ALL SELECT 'train', text FROM benchmark)
SELECT split, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY 1"""


# ---------------------------------------------------------------------- indicators
def classify_ioc(spark, sf_dir):
    """Every word of the planted documents and every link of the pages."""
    w = unnest(_planted(spark, sf_dir), [], F.array_distinct(F.split("text", r"\s+")), name="v")
    links = table(spark, sf_dir, "pages").select(F.explode(F.array(
        F.col("url"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.concat(F.lit("10.0.0."), F.col("page_id") % 300),
        F.concat(F.lit(" fe80::"), F.hex(F.col("page_id")), F.lit("\n")), F.sha2("url", 256))).alias("v"))
    return w.union(links).select(entities.classify_ioc(F.col("v")).alias("k")).groupBy("k.ioc_type", "k.validated").agg(
        F.count(F.lit(1)).alias("words"))


CLASSIFY_SQL = rf"""
WITH {PLANTED_SQL},
w AS (SELECT unnest(list_distinct(string_split_regex(text, '\s+'))) AS v FROM pl
  UNION ALL SELECT unnest([url, regexp_extract(url, '^https?://([^/]+)', 1), '10.0.0.' || (page_id % 300),
    ' fe80::' || upper(to_hex(page_id)) || chr(10), sha256(url)]) FROM pages),
t AS (SELECT regexp_replace(v, '^\s+|\s+$', '', 'g') AS v FROM w),
k AS (SELECT CASE
  WHEN regexp_full_match(v, '((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){{3}}(25[0-5]|2[0-4]\d|[01]?\d\d?)') THEN 'IP_Address'
  WHEN regexp_full_match(v, '([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|([0-9a-fA-F]{{1,4}}:){{1,7}}:|([0-9a-fA-F]{{1,4}}:){{1,6}}:[0-9a-fA-F]{{1,4}}|([0-9a-fA-F]{{1,4}}:){{1,5}}(:[0-9a-fA-F]{{1,4}}){{1,2}}|([0-9a-fA-F]{{1,4}}:){{1,4}}(:[0-9a-fA-F]{{1,4}}){{1,3}}|([0-9a-fA-F]{{1,4}}:){{1,3}}(:[0-9a-fA-F]{{1,4}}){{1,4}}|([0-9a-fA-F]{{1,4}}:){{1,2}}(:[0-9a-fA-F]{{1,4}}){{1,5}}|[0-9a-fA-F]{{1,4}}:(:[0-9a-fA-F]{{1,4}}){{1,6}}|:((:[0-9a-fA-F]{{1,4}}){{1,7}}|:)') THEN 'IP_Address'
  WHEN regexp_full_match(v, '[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}}') THEN 'File_Hash'
  WHEN regexp_full_match(v, '(?i)CVE-\d{{4}}-\d{{4,}}') THEN 'CVE_ID'
  WHEN regexp_full_match(v, 'https?://\S+') THEN 'URL'
  WHEN regexp_full_match(v, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') THEN 'Email_Address'
  WHEN regexp_full_match(v, '([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}') THEN 'Domain' END AS kind FROM t)
SELECT coalesce(kind, 'Unknown') AS ioc_type, kind IS NOT NULL AS validated, count(*) AS words FROM k GROUP BY ALL"""


def extract_iocs(spark, sf_dir):
    found = entities.extract_iocs(_planted(spark, sf_dir), id="doc_id", text="text")
    return found.select("doc_id", "text", "label", "ioc_type")


# Non-ASCII letters count as word characters, so they are replaced by a control
# character that is then excluded on both sides of a match.
EXTRACT_SQL = rf"""
WITH {PLANTED_SQL},
q AS (SELECT doc_id, text, lower(text) AS low, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS a FROM pl),
v AS (
  SELECT doc_id, 1 AS pr, unnest(list_distinct(regexp_extract_all(a, '\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b'))) AS text, 'Indicator' AS label, 'IP_Address' AS ioc_type FROM q
  UNION ALL SELECT doc_id, 2, unnest(list_distinct(regexp_extract_all(a, '(?i)\bCVE-\d{{4}}-\d{{4,}}\b'))), 'Vulnerability', 'CVE_ID' FROM q
  UNION ALL SELECT doc_id, 3, unnest(list_distinct(regexp_extract_all(a, '\b[a-fA-F0-9]{{32}}\b|\b[a-fA-F0-9]{{40}}\b|\b[a-fA-F0-9]{{64}}\b'))), 'Indicator', 'File_Hash' FROM q
  UNION ALL SELECT doc_id, 4, unnest(list_distinct(regexp_extract_all(text, '\bhttps?://[^\s]+'))), 'Indicator', 'URL' FROM q
  UNION ALL SELECT doc_id, 5, unnest(list_distinct(regexp_extract_all(text, '\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b'))), 'Indicator', 'Email_Address' FROM q
  UNION ALL SELECT doc_id, 6, unnest(list_distinct(regexp_extract_all(a, '\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{{2,}}\b'))), 'Indicator', 'Domain' FROM q),
f AS (SELECT doc_id, text, label, min_by(ioc_type, pr) AS ioc_type FROM v GROUP BY ALL),
n AS (SELECT doc_id, nm AS text, 'Malware' AS label, 'Unknown' AS ioc_type FROM q,
  (SELECT unnest(['Cobalt Strike', 'Mimikatz', 'Emotet', 'TrickBot', 'LockBit', 'APT29']) AS nm) WHERE contains(low, lower(nm))),
c0 AS (SELECT doc_id, 'Indicator' AS label, regexp_extract_all(a, '(?i)\b(?:spear\s?-?phishing(?:\s+lure)?|phishing(?:\s+lure)?)\b') AS h FROM q
  UNION ALL SELECT doc_id, 'Organization', regexp_extract_all(a, '(?i)\b(?:bulletproof hosting provider|threat actor|adversary)\b') FROM q
  UNION ALL SELECT doc_id, 'System', regexp_extract_all(a, '(?i)\b(?:compromised endpoint|endpoint|domain controller|temp directory|server|host)\b') FROM q
  UNION ALL SELECT doc_id, 'Tool', regexp_extract_all(a, '(?i)\b(?:suspicious executable|executable|windows dll|dll|powershell)\b') FROM q),
c1 AS (SELECT doc_id, label, unnest(h) AS text, generate_subscripts(h, 1) AS i FROM c0),
c AS (SELECT doc_id, min_by(text, i) AS text, label, 'Unknown' AS ioc_type FROM c1 GROUP BY doc_id, label, lower(text))
SELECT doc_id, text, label, ioc_type FROM f UNION ALL SELECT doc_id, text, label, ioc_type FROM n UNION ALL SELECT doc_id, text, label, ioc_type FROM c"""


def rule_events(spark, sf_dir):
    d = unnest(_planted(spark, sf_dir), ["doc_id"], entities.rule_events(F.col("text"))).select("doc_id", "item.*")
    return d.groupBy("type", "keyword").agg(F.count(F.lit(1)).alias("texts"), F.sum("doc_id").alias("ids"))


def detect_events(spark, sf_dir):
    found = entities.detect_events(_planted(spark, sf_dir), id="doc_id", text="text")
    return found.groupBy("event_type", "trigger", "confidence").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("doc_id").alias("ids"))


DETECT_SQL = f"""
WITH {PLANTED_SQL},
kw AS (SELECT * FROM (VALUES (1,'encrypted','Ransom'),(2,'ransomware','Ransom'),(3,'ransom','Ransom'),(4,'phishing','Phishing'),
  (5,'phish','Phishing'),(6,'credential harvesting','Phishing'),(7,'exfiltrated','Databreach'),(8,'data breach','Databreach'),
  (9,'data leak','Databreach'),(10,'exfiltration','Databreach'),(11,'patched','Patch-Vulnerability'),(12,'patch','Patch-Vulnerability'),
  (13,'remediated','Patch-Vulnerability'),(14,'disclosed','Discover-Vulnerability'),(15,'vulnerability','Discover-Vulnerability'),
  (16,'zero-day','Discover-Vulnerability'),(17,'0day','Discover-Vulnerability')) AS t(rank, phrase, kind)),
m AS (SELECT doc_id, kind, min_by(phrase, rank) AS phrase FROM pl, kw WHERE contains(lower(text), phrase) GROUP BY doc_id, kind)
SELECT kind AS event_type, phrase AS "trigger", 0.7::DOUBLE AS confidence, count(*) AS texts, CAST(sum(doc_id) AS BIGINT) AS ids FROM m GROUP BY ALL"""

RULE_EVENTS_SQL = f"""
WITH {PLANTED_SQL},
kw AS (SELECT * FROM (VALUES ('ransomware','Ransom'),('spearphishing','Phishing'),('spear-phishing','Phishing'),('phishing','Phishing'),
  ('exfiltration','Databreach'),('data breach','Databreach'),('brute force','CredentialAttack'),('credential theft','CredentialAttack'),
  ('compromised','CredentialAttack'),('lateral','LateralMovement'),('lateral movement','LateralMovement')) AS t(keyword, type))
SELECT type, keyword, count(*) AS texts, CAST(sum(doc_id) AS BIGINT) AS ids FROM pl, kw WHERE contains(lower(text), keyword) GROUP BY ALL"""


def _indicator_rows(spark, sf_dir):
    d = computed_once(_planted(spark, sf_dir), "found", entities.rule_entities(F.col("text")))
    d = computed_once(d, "entities", entities.locate_entities(F.col("text"), F.col("found")))
    return entities.iocs_from_entities(
        d.withColumn("alert_id", F.concat(F.lit("d"), F.col("doc_id"))), alert_id="alert_id", tenant="lang", entities="entities")


def ioc_table(spark, sf_dir):
    return _indicator_rows(spark, sf_dir).groupBy("tenant_id", "ioc_type", "source").agg(
        F.count(F.lit(1)).alias("iocs"), F.count_distinct("value").alias("iocs_distinct"), F.max("confidence").alias("confidence"))


# Only Indicator labels keep a type; everything else is stored as Unknown.
IOC_TABLE_SQL = EXTRACT_SQL.replace("WITH ", "WITH ", 1).rsplit("SELECT doc_id, text, label, ioc_type FROM f UNION", 1)[0] + r""",
allrows AS (SELECT doc_id, text, label FROM f UNION ALL SELECT doc_id, text, label FROM n UNION ALL SELECT doc_id, text, label FROM c),
ty AS (SELECT d.lang AS tenant_id, r.text, CASE WHEN r.label <> 'Indicator' THEN 'Unknown'
  WHEN regexp_full_match(r.text, '((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)') THEN 'IP_Address'
  WHEN regexp_full_match(r.text, '[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32}') THEN 'File_Hash'
  WHEN regexp_full_match(r.text, 'https?://\S+') THEN 'URL'
  WHEN regexp_full_match(r.text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') THEN 'Email_Address'
  WHEN regexp_full_match(r.text, '([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}') THEN 'Domain' ELSE 'Unknown' END AS ioc_type
  FROM allrows r JOIN documents d USING (doc_id))
SELECT tenant_id, ioc_type, 'NER' AS source, count(*) AS iocs, count(DISTINCT text) AS iocs_distinct, 0.99::DOUBLE AS confidence FROM ty GROUP BY ALL"""


def insert_iocs(spark, sf_dir):
    """Half of the documents are stored already; all are offered again."""
    rows = _indicator_rows(spark, sf_dir)
    stored = rows.filter(F.pmod(F.substring("alert_id", 2, 20).cast("long"), F.lit(2)) == 0)
    fresh = tables.insert_iocs(stored, rows)
    return fresh.groupBy("tenant_id", "ioc_type").agg(F.count(F.lit(1)).alias("iocs"), F.min("confidence").alias("confidence"))


INSERT_SQL = IOC_TABLE_SQL.replace("SELECT d.lang AS tenant_id, r.text", "SELECT d.lang AS tenant_id, r.doc_id, r.text").rsplit(
    "SELECT tenant_id, ioc_type, 'NER'", 1)[0] + """
SELECT tenant_id, ioc_type, count(DISTINCT doc_id || '|' || text) AS iocs, 0.99::DOUBLE AS confidence FROM ty WHERE doc_id % 2 = 1 GROUP BY ALL"""


def _fragments(spark, sf_dir):
    """Entities as a token model would cut them: the front half of each hit, unvalidated."""
    d = _located(spark, sf_dir)
    cut = F.transform("hits", lambda h: let_fragment(h))
    return computed_once(d, "entities", cut.cast(f"array<{entities.ENTITY}>"))


def let_fragment(h):
    size = F.greatest(F.floor((h["end"] - h["start"]) / 2).cast("int"), F.lit(4))
    is_cve = F.upper(h["value"]).startswith("CVE-")
    return F.struct(
        F.substr(h["value"], F.lit(1), size).alias("text"),
        F.when(is_cve, "Vulnerability").otherwise("Indicator").alias("label"), h["start"].alias("start"),
        (h["start"] + size).alias("end"), F.lit(0.6).alias("confidence"), F.lit("Unknown").alias("ioc_type"),
        F.lit(False).alias("ioc_validated"))


def recover_iocs(spark, sf_dir):
    d = entities.recover_iocs(_fragments(spark, sf_dir), text="text", entities="entities")
    d = unnest(d, ["doc_id"], F.col("entities"))
    return d.select("doc_id", "item.*").select("doc_id", "text", "label", "start", "end", "confidence", "ioc_type", "ioc_validated")


def repair_cve(spark, sf_dir):
    d = unnest(_fragments(spark, sf_dir), ["doc_id", F.col("text").alias("whole")],
               entities.repair_cve(F.col("text"), F.col("entities"))).select("doc_id", "whole", "item.*")
    return d.groupBy("label", "ioc_type", "ioc_validated", "confidence").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.length("text")).alias("chars"),
        F.sum((F.substr("whole", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).cast("int")).alias("aligned"))


REPAIR_SQL = f"""
WITH {PLANTED_SQL}, {HITS_SQL},
f AS (SELECT doc_id, v, CASE WHEN v LIKE 'CVE-%' THEN len(v) ELSE greatest(len(v) // 2, 4) END AS n FROM hit)
SELECT CASE WHEN v LIKE 'CVE-%' THEN 'Vulnerability' ELSE 'Indicator' END AS label,
  CASE WHEN v LIKE 'CVE-%' THEN 'CVE_ID' ELSE 'Unknown' END AS ioc_type, v LIKE 'CVE-%' AS ioc_validated,
  CASE WHEN v LIKE 'CVE-%' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence, count(*) AS entities,
  CAST(sum(n) AS BIGINT) AS chars, count(*) AS aligned FROM f GROUP BY ALL"""


def _predicted(spark, sf_dir):
    """Token predictions derived from the words: labels by length, confidence by position."""
    d = computed_once(table(spark, sf_dir, "documents", heavy=True), "tok", token_spans(F.col("text")))
    n = F.size("tok")
    offsets = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))),
                       F.transform("tok", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    ids = F.concat(F.array(F.lit(0)), F.transform("tok", lambda t: (F.when(F.length(t["value"]) % 3 == 0, F.length(t["value"]) % 11).otherwise(0)).cast("int")))
    conf = F.concat(F.array(F.lit(1.0)), F.transform("tok", lambda t, i: (F.lit(50) + i % 50) / F.lit(100.0)))
    made = F.struct(offsets.alias("offsets"), ids.alias("ids"), conf.alias("conf"))
    return computed_once(d.filter(n > 0), "made", made).select("doc_id", "text", "made")


def spans_from_predictions(spark, sf_dir):
    p = _predicted(spark, sf_dir)
    e = unnest(p, ["doc_id"], entities.spans_from_predictions(
        F.col("text"), F.col("made.offsets"), F.col("made.ids"), F.col("made.conf"))).select("doc_id", "item.*")
    return e.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


# Labels by token; an island starts where a B-/I- tag does not continue its left neighbour.
SPANS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM t),
v AS (SELECT doc_id, i, len(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS n,
  sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
l AS (SELECT doc_id, i, e - n AS s, e, CASE WHEN n % 3 = 0 THEN n % 11 ELSE 0 END AS id FROM v),
g AS (SELECT *, (id + 1) // 2 AS fam, id % 2 = 1 AS b FROM l),
h AS (SELECT *, lag(fam) OVER w AS pf, lag(e) OVER w AS pe FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
-- an I- tag opens nothing, so openness has to be carried: count family runs, then look for a B- in the run before the token
r AS (SELECT *, sum(CASE WHEN fam = pf THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
o AS (SELECT *, max(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY i) = 1 AS open FROM r WHERE id > 0),
q AS (SELECT *, CASE WHEN b AND NOT (lag(open) OVER x AND s <= lag(e) OVER x + 1) THEN 1 WHEN b AND lag(open) OVER x IS NULL THEN 1 ELSE 0 END AS fresh
  FROM o WHERE open WINDOW x AS (PARTITION BY doc_id, run ORDER BY i)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, run ORDER BY i) AS part FROM q),
ent AS (SELECT doc_id, run, part, CASE any_value(fam) WHEN 1 THEN 'Malware' WHEN 2 THEN 'Indicator' WHEN 3 THEN 'System' WHEN 4 THEN 'Vulnerability' ELSE 'Organization' END AS label,
  min(s) AS s, max(e) AS e FROM k GROUP BY doc_id, run, part)
SELECT doc_id, label, count(*) AS entities, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM ent WHERE label <> 'Indicator' GROUP BY ALL"""


def spans_from_predictions_fixed_labels(spark, sf_dir):
    return spans_from_predictions(spark, sf_dir).filter(F.col("label") != "Indicator")


def locate_entities(spark, sf_dir):
    absent = F.array(F.struct(F.lit("not there at all").alias("text"), F.lit("Tool").alias("label"), F.lit("Unknown").alias("ioc_type")))
    d = computed_once(_planted(spark, sf_dir), "e", F.concat(entities.rule_entities(F.col("text")), absent))
    at = unnest(d, ["doc_id"], entities.locate_entities(F.col("text"), F.col("e"))).select("doc_id", "item.*")
    return at.select("doc_id", F.col("text").alias("value"), "label", "start", "end", "ioc_validated")


LOCATE_SQL = EXTRACT_SQL.rsplit("SELECT doc_id, text, label, ioc_type FROM f UNION", 1)[0] + r""",
allrows AS (SELECT doc_id, text, label FROM f UNION ALL SELECT doc_id, text, label FROM n UNION ALL SELECT doc_id, text, label FROM c
  UNION ALL SELECT doc_id, 'not there at all', 'Tool' FROM pl)
SELECT r.doc_id, r.text AS value, r.label, greatest(strpos(pl.text, r.text) - 1, 0) AS "start",
  CASE WHEN strpos(pl.text, r.text) > 0 THEN strpos(pl.text, r.text) - 1 + len(r.text) ELSE 0 END AS "end",
  r.label = 'Indicator' AND (regexp_full_match(r.text, '((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)|[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32}|https?://\S+|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}')) AS ioc_validated
FROM allrows r JOIN pl USING (doc_id)"""


def parse_entity_replies(spark, sf_dir):
    """Replies derived per document: clean, fenced, trailing commas, empty lists, no JSON."""
    d = _planted(spark, sf_dir)
    n = F.col("doc_id")
    body = F.concat(F.lit('{"entities": [{"text": "x{'), n, F.lit('", "label": "Malware", "ioc_type": "Unknown"}'),
                    F.when(n % 4 == 1, ",").otherwise(""), F.lit('], "events": [{"type": "Ransom", "keyword": "k\\"}"}]}'))
    reply = (F.when(n % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done}")))
             .when(n % 4 == 2, '{"entities": [], "events": 3}').otherwise("no json here {"))
    out = entities.parse_entity_replies(d.withColumn("reply", reply), reply="reply", text="text")
    return out.select("doc_id", F.size("entities").alias("entities"), F.size("events").alias("events"),
                      F.get("entities", F.lit(0))["text"].alias("first"))


REPLIES_SQL = EXTRACT_SQL.rsplit("SELECT doc_id, text, label, ioc_type FROM f UNION", 1)[0] + """,
cnt AS (SELECT doc_id, count(*) AS m FROM (SELECT doc_id FROM f UNION ALL SELECT doc_id FROM n UNION ALL SELECT doc_id FROM c) GROUP BY 1),
ev AS (SELECT doc_id, len(list_filter(['ransomware', 'spearphishing', 'spear-phishing', 'phishing', 'exfiltration', 'data breach', 'brute force',
  'credential theft', 'compromised', 'lateral', 'lateral movement'], lambda p: contains(low, p))) AS e FROM q),
fst AS (SELECT doc_id, coalesce(
    nullif(regexp_extract(a, '\\b(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\.(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\.(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\.(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\b'), ''),
    regexp_extract(a, '(?i)\\bCVE-\\d{4}-\\d{4,}\\b')) AS t FROM q)
SELECT q.doc_id, CASE WHEN q.doc_id % 4 < 2 THEN 1 ELSE m END AS entities, CASE WHEN q.doc_id % 4 < 2 THEN 1 ELSE e END AS events,
  CASE WHEN q.doc_id % 4 < 2 THEN 'x{' || q.doc_id ELSE t END AS first
FROM q JOIN cnt USING (doc_id) JOIN ev USING (doc_id) JOIN fst USING (doc_id)"""


# ----------------------------------------------------------------------- summaries
def lead_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents", heavy=True)
    return d.select("doc_id", grounding.lead_summary(F.col("text")).alias("summary"))


LEAD_SQL = r"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(
    regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents),
n AS (SELECT *, len(list_filter(range(2, len(ss) + 1), lambda i: list_sum(list_transform(ss[1:i], lambda x: len(x))) + i - 1 <= 300)) + 1 AS k FROM s)
SELECT doc_id, CASE WHEN len(ss) = 0 THEN regexp_replace(substr(text, 1, 200), '^\s+|\s+$', '', 'g') ELSE array_to_string(ss[1:k], ' ') END AS summary FROM n"""


def _summaries(spark, sf_dir):
    """First sentence, a mixed sentence, a repeat and an invented tail as generated summary."""
    d = table(spark, sf_dir, "documents", heavy=True)
    s = sentences(F.col("text"))
    d = computed_once(d, "s", s).filter(F.size("s") > 0)
    summary = F.concat_ws(" ", F.lit("Summary:"), F.get("s", F.lit(0)), F.get("s", F.lit(2)),
                          F.when(F.col("doc_id") % 3 == 0, F.get("s", F.lit(0))),
                          F.lit("Wholly invented words, nobody wrote anything similar, breaking news about San Francisco."))
    return computed_once(d, "summary", summary).select("doc_id", "text", "summary")


def clean_summaries(spark, sf_dir):
    return summaries.clean_summaries(_summaries(spark, sf_dir), summary="summary", source="text").select("doc_id", "cleaned")


def clean_generated_summaries(spark, sf_dir):
    out = summaries.clean_summaries(_summaries(spark, sf_dir), summary="summary", source="text", drift=True)
    return summaries.summary_stats(out, source="text", summary="cleaned").select(
        "doc_id", "cleaned", "input_tokens", "output_tokens")


def cut_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.concat(
        "text", F.when(F.col("doc_id") % 4 == 0, " , San Francisco (KRON) again").when(F.col("doc_id") % 4 == 1, "\n<|user|> more")
        .when(F.col("doc_id") % 4 == 2, " ;- a new study").otherwise("")).alias("summary"))
    return d.select("doc_id", F.md5(grounding.cut_drift(F.col("summary"))).alias("cut_md5"))


CUT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(text || CASE doc_id % 4 WHEN 0 THEN ' , San Francisco (KRON) again' WHEN 1 THEN chr(10) || '<|user|> more'
    WHEN 2 THEN ' ;- a new study' ELSE '' END, '^\s+|\s+$', '', 'g') AS x FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?s)(<\|user\|>|<\|assistant\|>|<\|system\|>|```).*$', ''), '\s+$', '', 'g') AS x FROM t),
p AS (SELECT doc_id, x, list_min(list_filter([strpos(lower(x), 'san francisco'), strpos(lower(x), '(kron)'), strpos(lower(x), 'a new study'),
  strpos(lower(x), 'according to a new study'), strpos(lower(x), 'breaking news')], lambda i: i > 1)) AS hit_at FROM m),
c AS (SELECT doc_id, x, CASE WHEN hit_at IS NOT NULL THEN regexp_replace(regexp_replace(substr(x, 1, hit_at - 1), '\s+$', ''), '[,;:-]+$', '') END AS c FROM p)
SELECT doc_id, md5(CASE WHEN c IS NULL OR len(regexp_extract_all(c, '\S+')) < 8 THEN x
  WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END) AS cut_md5 FROM c"""


def normalize_grounding(spark, sf_dir):
    d = table(spark, sf_dir, "documents", heavy=True)
    n = grounding.normalize_grounding(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.size(sentences(F.col("text"))).alias("sentences"))


NORM_SQL = r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS norm_md5,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))) AS sentences FROM documents"""


def summary_stats(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.substring("text", 1, 100).alias("head"))
    return summaries.summary_stats(pairs, source="text", summary="head").select("conv_id", "turn", "input_tokens", "output_tokens")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


QUERIES = {f.__name__: f for f in (
    labelled_csv, split_parquet, read_conll, span_json, chat_jsonl, feature_table, input_fingerprint, map_tags, decode_bio, entity_prf, entity_prf_ignored,
    chat_rows_entities, tokens_with_offsets, drop_overlaps, tag_tokens, align_labels, augment_split, classify_ioc,
    extract_iocs, rule_events, detect_events, ioc_table, insert_iocs, recover_iocs, repair_cve, spans_from_predictions,
    spans_from_predictions_fixed_labels, locate_entities, parse_entity_replies, lead_summary, clean_summaries,
    clean_generated_summaries, cut_drift, normalize_grounding, summary_stats)}

ORACLES = {
    "labelled_csv": LABELLED_CSV_SQL, "split_parquet": SPLIT_SQL, "read_conll": READ_CONLL_SQL,
    "span_json": f"WITH {PLANTED_SQL}, {HITS_SQL} SELECT CASE s % 3 WHEN 0 THEN 'Organization' ELSE 'System' END AS label, count(*) AS spans, "
                 "CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM hit WHERE s % 3 < 2 GROUP BY 1",
    "chat_jsonl": f"WITH {SENTENCES_SQL} SELECT CAST(t AS INTEGER) AS turn, ['system', 'user', 'assistant'][t + 1] AS role, count(*) AS rows "
                  "FROM tok, (SELECT unnest([0, 1, 2]) AS t) GROUP BY ALL",
    "feature_table": FEATURE_TABLE_SQL, "map_tags": MAP_TAGS_SQL, "decode_bio": DECODE_SQL, "entity_prf": PRF_SQL,
    "entity_prf_ignored": PRF_SQL,
    "chat_rows_entities": CHAT_ENTITIES_SQL.replace("{entity_md5}", _md5(fixed.ENTITY_SYSTEM)),
    "tokens_with_offsets": TOKENS_SQL, "drop_overlaps": OVERLAPS_SQL, "tag_tokens": TAG_TOKENS_SQL, "align_labels": ALIGN_SQL,
    "augment_split": AUGMENT_SQL, "classify_ioc": CLASSIFY_SQL, "extract_iocs": EXTRACT_SQL, "rule_events": RULE_EVENTS_SQL,
    "detect_events": DETECT_SQL, "ioc_table": IOC_TABLE_SQL, "insert_iocs": INSERT_SQL, "repair_cve": REPAIR_SQL,
    "spans_from_predictions_fixed_labels": SPANS_SQL, "locate_entities": LOCATE_SQL, "parse_entity_replies": REPLIES_SQL,
    "lead_summary": LEAD_SQL, "cut_drift": CUT_SQL, "normalize_grounding": NORM_SQL,
    "summary_stats": r"SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS input_tokens, "
                     r"len(regexp_extract_all(substr(text, 1, 100), '\S+')) AS output_tokens FROM conversations",
}
