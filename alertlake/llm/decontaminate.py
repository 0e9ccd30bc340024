"""Benchmark decontamination by a prefix-filtered set join; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import is_small, lower_ascii, materialize

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; the first and last element may be empty (see ``n_words``)."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS)


def n_words(words: Column) -> Column:
    n = F.size(words)
    return (n - (F.get(words, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(words, n - 1) == "")).cast("int")).cast("long")


def item_windows(items: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Distinct (item, window): ``size`` consecutive words, or all words of a shorter item."""
    rows = items.select(F.col(id).cast("string").alias("item"), F.filter(words_of(F.col(text)), lambda w: w != "").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    rows = rows.where("size(words) > 0").select("item", "words", F.explode(starts).alias("start"))
    return rows.select("item", F.slice("words", F.col("start"), size).alias("window")).distinct()


def prefixes(windows: DataFrame, corpus_words: DataFrame) -> DataFrame:
    """(token, offset, window, len): every window under its rarest word.

    All words of a window must occur, so the necessary prefix in rarity order is one token:
    the word found least often in the corpus, ties by the word itself.
    """
    parts = windows.select("window", F.posexplode("window").alias("offset", "word"))
    used = parts.select("word").distinct()
    small = is_small(used, 2_000_000, 32 << 20, F.octet_length("word") + 16)
    counts = corpus_words.join(F.broadcast(used) if small else used, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = parts.join(counts, "word", "left").select("window", F.struct(F.coalesce("n", F.lit(0)), "word", "offset").alias("rank"))
    return ranked.groupBy("window").agg(F.min("rank").alias("rank")).select(
        F.col("rank.word").alias("token"), F.col("rank.offset").alias("offset"), "window", F.size("window").alias("len"))


def find_windows(rows: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, start, len, window) for every occurrence of a window in ``rows`` (key, words)."""
    stream = rows.select("key", F.explode("words").alias("word")).where("word <> ''")
    keyed = materialize(prefixes(windows, stream.select("word")), "prefixes")
    placed = rows.select("key", "words", F.posexplode("words").alias("pos", "token"))
    if is_small(keyed, 1_000_000, 64 << 20, F.octet_length(F.array_join("window", " ")) + 16 * F.size("window") + 64):
        # The array of the row is only looked at for positions that hold a prefix token.
        found = placed.join(F.broadcast(keyed), "token").withColumn("first", F.lit(0))
    else:
        # Shuffled by token: each position carries the words that a window through it may reach.
        near = placed.select(
            "key", "token", "pos", F.greatest(F.col("pos") - (size - 1), F.lit(0)).alias("first"),
            F.slice("words", F.greatest(F.col("pos") - (size - 2), F.lit(1)), 2 * size - 1).alias("words"))
        found = near.join(keyed, "token")
    start = F.col("pos") - F.col("offset")
    found = found.withColumn("start", start).where((start >= 0) & (start - F.col("first") + F.col("len") <= F.size("words")))
    same = F.slice("words", F.col("start") - F.col("first") + 1, F.col("len")) == F.col("window")
    return found.where(same).select("key", "start", "len", "window")


def decontaminate(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per input row: ``id``, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in an occurrence of any window of any item. Items without
    words have no window; null texts have no words; no items or no documents give zeros or an
    empty result. Repeated rows and repeated items are allowed; rows are told apart by id and
    text. Documents without a hit have the hash of the empty list.
    """
    rows = docs.select(
        F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h")).alias("key"), words_of(F.col(text)).alias("words"))
    owned = materialize(item_windows(items, item_id, item_text, size), "windows")
    hits = materialize(find_windows(rows, owned.select("window").distinct(), size).distinct(), "hits")

    by_start = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    covered = covered.withColumn("reached", F.coalesce(F.max("end").over(by_start), F.lit(0)))
    new = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    lengths = covered.groupBy("key").agg(F.sum(new).cast("long").alias("n_hit"))
    found = hits.select("key", "window").distinct().join(owned, "window").select("key", "item").distinct()
    names = found.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    known = lengths.join(names, "key").select(F.col("key").alias("hit_key"), "n_hit", "items")

    counted = rows.select("key", n_words(F.col("words")).alias("n_words"))
    joined = counted.join(known, counted.key.eqNullSafe(known.hit_key), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("key.id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` as they are, without those that hold any window of any item."""
    key = F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    windows = materialize(item_windows(items, item_id, item_text, size).select("window").distinct(), "windows")
    rows = docs.select(key.alias("key"), words_of(F.col(text)).alias("words"))
    hit = materialize(find_windows(rows, windows, size).select("key").distinct(), "hits")
    return docs.join(hit, key.eqNullSafe(hit.key), "left_anti")


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
g as (
  select distinct item_id, array_to_string(words[s:s + 9], ' ') as win, least(len(words), 10) as n
  from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as s from b where len(words) > 0)),
p as (
  select doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') as win
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as s
        from w, (select distinct n from g) where len(words) >= n)),
h as (select doc_id, s, p.n, item_id from p join g on p.win = g.win and p.n = g.n),
n_hit as (select doc_id, count(distinct pos) as n_hit
          from (select distinct doc_id, unnest(range(s, s + n)) as pos from h) group by doc_id),
n_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from w left join n_hit using (doc_id) left join n_items using (doc_id)
"""
