"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import is_small, materialize
from alertlake.llm.running import running_total

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 2


def source_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    ``share`` of all sizes is dealt by weight; a target stops at ``cap`` times its source's
    size and the excess is dealt again by weight, until no target is above. Each pass is one
    aggregation of the sources; every pass but the last caps at least one more source.
    """
    limit = F.col("source_size") * F.lit(cap)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    budget = float(total) * share
    level, known = budget / weight, -1
    while True:
        over = limit < F.col("weight") * F.lit(level)
        n, capped, gone = sources.where(over).agg(F.count(F.lit(1)), F.sum(limit), F.sum("weight")).first()
        if n == known or gone == weight:
            break
        known, level = n, (budget - (capped or 0.0)) / (weight - (gone or 0))
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id``, size, source_size, target, taken, copies and the ``keep`` columns.

    Sources in code-point order, null last, get ``weights`` in turn. Inside a source documents
    stand in hash order, the whole source ``EPOCHS`` times over; a document's virtual finish time
    is the source's words up to its end divided by the source's target. All (document, epoch)
    items are sorted by finish time and taken while their total stays within the budget, which
    is where every source has reached its target; items that finish at the same instant as the
    first one beyond it stay out. ``taken`` is the words of the copies taken, whole documents only.

    Size: number of words; null, empty or blank texts have size 0 and are never taken. Rows with
    the same id are separate documents. The order uses md5 of the id, so reruns agree.
    """
    # Internal names, so that no column of the caller's can clash.
    rows = docs.select(
        F.struct(F.col(id).alias(id), *[F.col(c).alias(c) for c in keep]).alias("row"),
        F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id).cast("string"), F.lit("")))).alias("h"),
        F.xxhash64(*[F.col(c) for c in (id, text, *keep)]).alias("tie"))
    rows = materialize(rows, "mix")
    by_source = rows.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    order = [F.col("no_source"), F.col("src")]
    ranked = running_total(by_source.withColumn("one", F.lit(1)), order, "one", "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("one", "rank")
    targets = materialize(source_targets(materialize(ranked, "sources"), share, cap), "targets")

    running = running_total(rows, [*order, F.col("h"), F.col("size"), F.col("tie")], "size", "upto")
    running = materialize(running, "upto")
    starts = running.groupBy("no_source", "src").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    known = targets.join(starts, ["no_source", "src"])
    if is_small(known, 100_000, 8 << 20, F.octet_length("src") + 64):
        known = F.broadcast(known)
    placed = running.join(known, ["no_source", "src"])
    placed = placed.withColumn("finish", F.array(*[
        F.when((F.col("size") > 0) & (F.col("target") > 0),
               (F.col("source_size") * F.lit(k) + F.col("upto") - F.col("start")) / F.col("target"))
        for k in range(EPOCHS)]))
    placed = materialize(placed, "placed")

    items = placed.where("size > 0 and target > 0").select("no_source", "src", "h", "tie", "size", F.posexplode("finish").alias("epoch", "at"))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    sums = running_total(items, [F.col(c) for c in ("at", "no_source", "src", "h", "size", "tie", "epoch")], "size", "all")
    beyond = sums.where(F.col("all") > F.lit(budget * (1 + 1e-12))).agg(F.min("at")).first()[0]
    ends = F.lit(float("inf") if beyond is None else beyond)
    copies = F.size(F.filter("finish", lambda t: t < ends))
    return placed.select(
        "row.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


ORACLE = r"""
with d as (
  select doc_id, source, text, md5('mix:' || doc_id) as h,
         case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size
  from documents),
s as (
  select source, sum(size)::double as source_size,
         [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from d group by source),
o as (
  select *, row_number() over (order by 2 * source_size / weight, source nulls last) as k,
         coalesce(sum(2 * source_size) over w, 0) as capped, coalesce(sum(weight) over w, 0) as gone,
         sum(source_size) over () * 1.5 as budget, sum(weight) over () as total_weight
  from s window w as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (
  select min_by((budget - capped) / (total_weight - gone), k) as level
  from o where 2 * source_size / weight >= (budget - capped) / (total_weight - gone)),
t as (select source, source_size, least(2 * source_size, weight * level) as target from s, l),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) over (partition by d.source order by d.h, d.size, d.doc_id rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source),
i as (
  select doc_id, size, (source_size * e + upto) / target as fin
  from p, (values (0), (1)) as x(e) where size > 0 and target > 0),
r as (select fin, sum(size) over (order by fin range unbounded preceding) as total from i),
c as (select coalesce(min(fin), 'infinity'::double) as ends from r, (select sum(target) as budget from t) where total > budget * (1 + 1e-12))
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
       (size * ((((upto / target) < ends) and size > 0 and target > 0)::int
                + ((((source_size + upto) / target) < ends) and size > 0 and target > 0)::int))::bigint as taken
from p, c
"""
