"""Prefix trie of conversations: blocks of turns are grouped first, single turns only where blocks part.

Each turn has a digest of role and text. A prefix is named by two sums, over its turns, of 64-bit hashes
of (depth, digest): equal prefixes have equal names, and different ones the same name with a chance of
about one in 2 ** 128 for each pair. The sum at a block's end is one running sum over blocks, so a
conversation of any length is handled in parts.

Blocks of ``BLOCK`` turns with the same name are one group, with its number of conversations and the
least of them. Inside a block whose group holds all that reached it, every turn has the same members.
Only the turns of the other blocks, where siblings part or conversations end, are grouped by prefix.

The least member of a node is its owner. Along a conversation ownership starts at some depth and stays,
so the tree is known from one branch per conversation: where it starts, and from whom it branches off.
A node's leaves and saved code points are sums, over its members, of what each member knows of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import crc32_sql, materialize
from alertlake.llm.running import running_by_group
from alertlake.operators.joins import balanced_lookup, heavy_threshold

BLOCK = 4
NAME = ["a", "b"]
SUM = "decimal(38,0)"


def turn_digests(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, length) of each turn; null roles and texts are empty, rows without a conversation are left out."""
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of)
    return turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.unhex(F.md5(whole.cast("binary"))).alias("digest"),
        F.length(text_of).cast("long").alias("length"))


def rebuild(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the one at the start of their hundred, and all conversation ids.

    ``turns`` as of :func:`turn_digests`. With h = crc32(id as text) modulo ``most + 1``, the first h turns
    of conversation id - id % ``every`` (all if fewer, none if absent) replace the first h own ones. Turns
    stand by number (null first), turns of one number by digest. Gives (conv, source, n, digest, length).
    """
    numbered = materialize(running_by_group(turns, "conv", ["turn", "digest", "length"], {"n": F.lit(1).cast("long")}), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = materialize(numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")), "conversations")
    heads = numbered.where((F.col("n") <= most) & (F.col("conv") % every == 0)).groupBy(F.col("conv").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("n", "digest", "length"))).alias("head"))  # ``most`` items at most
    begun = convs.select("conv", h.cast("int").alias("h"), (F.col("conv") - F.col("conv") % every).alias("first")).join(heads, "first")
    taken = begun.where("h > 0").select("conv", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("t"))
    own = numbered.where(F.col("n") > h).select("conv", F.lit(1).alias("source"), "n", "digest", "length")
    return taken.select("conv", F.lit(0).alias("source"), "t.*").unionByName(own), convs.select("conv")


def _name(turns: str, start: str, seed: int) -> str:
    return (f"aggregate({turns}, cast({start} as {SUM}), "
            f"(s, t) -> cast(s + xxhash64({seed}L, t.depth, t.digest) as {SUM}))")


def _blocks(turns: DataFrame, order: list[str], size: int) -> DataFrame:
    """(conv, k, turns, a0, b0, a, b, upto): blocks with the prefix name before and behind them and the code points up to their end."""
    deep = running_by_group(turns, "conv", order, {"depth": F.lit(1).cast("long")})
    blocks = deep.groupBy("conv", F.floor((F.col("depth") - 1) / size).cast("long").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "length"))).alias("turns"))  # ``size`` items at most
    blocks = running_by_group(blocks, "conv", ["k"], {
        "a": F.expr(_name("turns", "0", 1)), "b": F.expr(_name("turns", "0", 2)),
        "upto": F.expr("aggregate(turns, 0L, (s, t) -> s + t.length)")})
    return blocks.select(
        "conv", "k", "turns", *[F.expr(f"cast({c} - {_name('turns', '0', i)} as {SUM})").alias(f"{c}0") for i, c in ((1, "a"), (2, "b"))],
        *[F.col(c).cast(SUM).alias(c) for c in NAME], "upto")


def _turns_of(groups: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per turn of each block: name, parent's name, depth, length, and code points to it and from it in the block."""
    nodes = f"""transform(sequence(1, size(turns)), j -> struct(
        turns[j - 1].depth as depth, turns[j - 1].length as length, {_name('slice(turns, 1, j)', 'a0', 1)} as a,
        {_name('slice(turns, 1, j)', 'b0', 2)} as b, {_name('slice(turns, 1, j - 1)', 'a0', 1)} as a0,
        {_name('slice(turns, 1, j - 1)', 'b0', 2)} as b0, slice(turns, j, size(turns)) as rest,
        before + aggregate(slice(turns, 1, j - 1), 0L, (s, t) -> s + t.length) as before))"""
    return groups.select(*keep, F.explode(F.expr(nodes)).alias("node")).select(*keep, "node.*")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, least, ends_sha256): conversations that end at a node, ids in order, hashed as they stream by.

    A hash is taken in order, so the ids of one node pass through one task, sorted by Spark and never held.
    """
    target = ends.select(*NAME, F.col("conv").alias("least"), F.lit("").alias("ends_sha256")).limit(0).toArrow().schema
    kind = ends.schema["conv"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, digest = None, None, None
        for batch in batches:
            done = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NAME, "conv")]
            for a, b, conv in zip(*columns):
                if (a, b) == now:
                    digest.update(f",{conv}".encode())
                    continue
                if now:
                    done.append((*now, least, digest.hexdigest()))
                now, least, digest = (a, b), conv, hashlib.sha256(str(conv).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)
        if now:
            last = [(*now, least, digest.hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), target)], schema=target)

    return ends.select(*NAME, "conv").repartition(*NAME).sortWithinPartitions(*NAME, "conv").mapInArrow(
        walk, f"a {SUM}, b {SUM}, least {kind}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, order: list[str], *, conv: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of all conversations' turns, the root included.

    ``turns``: (conv, digest, length) and the ``order`` of the turns; ``convs``: all ids (conv), those without
    turns too; ids must be integers. Gives ``conv`` (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, as long numbers and one string. Equal conversations share all their
    nodes. Without conversations there is no row. A conversation may hold any share of the turns, and a node any
    share of the conversations: both are split or combined before they move.
    """
    spark = turns.sparkSession
    n_all, least_all = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    blocks = materialize(_blocks(turns, order, block), "blocks")

    # Groups of equal blocks, and how many conversations reached each.
    groups = blocks.groupBy("k", *NAME).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    groups = materialize(groups.join(blocks.select(
        "conv", "k", "turns", "a0", "b0", (F.col("upto") - F.expr("aggregate(turns, 0L, (s, t) -> s + t.length)")).alias("before")),
        ["conv", "k"]), "groups")
    whole = groups.where((F.size("turns") == block) & (F.col("n") > 1))
    reached = whole.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("n").alias("n_before"))
    bar = heavy_threshold(groups.select("n"), "n")
    later = balanced_lookup(
        groups.where("k > 0"), heavy=reached.where(F.col("n_before") >= bar), light=reached.where(F.col("n_before") < bar),
        keys=["a0", "b0"], value="n_before").withColumn("n_before", F.coalesce("n_before", F.lit(1)))
    groups = later.unionByName(groups.where("k = 0").withColumn("n_before", F.lit(n_all).cast("long")))
    # No sibling and no end before the block's end: nothing parts inside.
    alike = (F.col("n_before") == 1) | ((F.size("turns") == block) & (F.col("n") == F.col("n_before")))
    groups = materialize(groups.withColumn("parts", ~alike), "groups")

    found = _turns_of(groups, "conv", "n", "parts").drop("rest")
    refined = found.where("parts").groupBy(*NAME).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("depth", "length", "a0", "b0", "before")])
    nodes = materialize(refined.unionByName(found.where("not parts").select(*refined.columns)), "nodes")

    # Where each conversation's own nodes begin, and whose node is above.
    starts = materialize(nodes.groupBy("conv").agg(F.min(F.struct("depth", "a0", "b0", "before")).alias("s")).select("conv", "s.*"), "starts")
    shared = nodes.where("n > 1").select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("n").alias("of"), F.col("conv").alias("parent"))
    bar = heavy_threshold(nodes.select("n"), "n")
    branches = balanced_lookup(
        starts.where("depth > 1"), heavy=shared.where(F.col("of") >= bar), light=shared.where(F.col("of") < bar),
        keys=["a0", "b0"], value="parent").unionByName(
        starts.where("depth = 1").withColumn("parent", F.lit(least_all).cast(starts.schema["conv"].dataType)))
    branches = materialize(branches, "branches")
    forks = branches.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("forks"))

    # What each conversation knows of itself: its end, whether it ends in a leaf of its own, and its turns up to the first of its own.
    last = blocks.groupBy("conv").agg(F.max("k").alias("k"))
    ending = blocks.join(last, ["conv", "k"]).select("conv", (F.col("k") * block + F.size("turns")).alias("depth"), *NAME, "upto")
    ends = materialize(convs.join(ending, "conv", "left").select(
        "conv", *[F.coalesce(c, F.lit(0)).cast(kind).alias(c) for c, kind in
                  (("depth", "long"), ("a", SUM), ("b", SUM), ("upto", "long"))]), "ends")
    own = starts.select("conv", F.col("depth").alias("from"), F.col("before").alias("others"))
    known = ends.join(own, "conv", "left").join(forks, ["conv", "depth"], "left").select(
        "conv", "depth", F.coalesce("from", F.col("depth") + 1).alias("from"), F.coalesce("others", "upto").alias("others"),
        (F.col("from").isNotNull() & F.col("forks").isNull()).cast("long").alias("leaf"))
    known = materialize(known, "known")

    # The same groups again, with sums over their members.
    told = known.withColumn("told", F.struct("from", "others", "leaf"))
    bar = heavy_threshold(known.select("depth"), "depth")
    members = balanced_lookup(
        blocks.select("conv", "k", *NAME, "upto"), heavy=told.where(F.col("depth") >= bar), light=told.where(F.col("depth") < bar),
        keys=["conv"], value="told")
    summed = members.groupBy("k", *NAME).agg(
        F.sum("told.leaf").alias("leaves"), F.min("told.from").alias("from"),
        F.sum(F.greatest(F.col("told.others") - F.col("upto"), F.lit(0))).alias("saved"))
    groups = groups.join(summed, ["k", *NAME])
    each = _turns_of(groups, "conv", "n", "parts", "leaves", "from", "saved").select(
        *NAME, "conv", "n", "parts", "depth", "leaves",
        F.expr("saved + (n - 1) * aggregate(rest, 0L, (s, t) -> s + t.length) + "
               "aggregate(rest, 0L, (s, t) -> s + if(t.depth < from, t.length, 0L))").alias("saved"))
    merged = each.where("parts").groupBy(*NAME).agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    every = merged.unionByName(each.where("not parts").select(*merged.columns))

    empty = hashlib.sha256().hexdigest()
    digests = materialize(_ends_digest(ends), "ended")
    links = branches.select("conv", "depth", "parent", F.lit(0).cast("long").alias("forks")).unionByName(
        forks.where("depth > 0").select("conv", "depth", F.lit(None).cast(starts.schema["conv"].dataType).alias("parent"), "forks"))
    links = links.groupBy("conv", "depth").agg(F.max("parent").alias("parent"), F.sum("forks").alias("forks"))
    rows = every.join(digests, NAME, "left").join(links, ["conv", "depth"], "left")
    goes_on = F.coalesce(F.col("least") != F.col("conv"), F.lit(True)).cast("long")
    result = rows.select(
        F.col("conv").cast("long").alias(conv), "depth", F.coalesce("parent", "conv").cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), (goes_on + F.coalesce("forks", F.lit(0))).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    if not n_all:
        return result
    # The root: single numbers.
    leaf, saved = known.agg(F.sum("leaf"), F.sum("others")).first()
    children = starts.where("depth = 1").count()
    ended = digests.where("a = 0 and b = 0").select("ends_sha256").first()
    root = spark.createDataFrame(
        [(least_all, 0, None, n_all, children, leaf if children else 1, saved, ended[0] if ended else empty)], result.schema)
    return result.unionByName(root)


def rebuilt_trie(turns: DataFrame, **names: str) -> DataFrame:
    """The trie of :func:`rebuild`'s conversations; null roles and texts are empty, null ids left out, ties by digest."""
    whole, convs = rebuild(turn_digests(turns, **names))
    return prefix_trie(whole, convs, ["source", "n"], conv=names.get("conv", "conv_id"))


ORACLE = rf"""
with recursive
t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, md5(len(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as n
  from conversations where conv_id is not null),
c as (select distinct conv_id, conv_id::varchar as key from t),
h as (select conv_id, conv_id - conv_id % 100 as first, {crc32_sql('key')} % 6 as h from c),
b as (
  select h.conv_id, 0 as source, n, role, text from h join t on t.conv_id = first where n <= h
  union all select h.conv_id, 1, n, role, text from h join t on t.conv_id = h.conv_id where n > h),
s as (
  select h.conv_id, coalesce(list(len(role)::varchar || ':' || role || text order by source, n) filter (role is not null), []) as steps,
         coalesce(list(len(text) order by source, n) filter (role is not null), []) as sizes
  from h left join b on b.conv_id = h.conv_id group by h.conv_id),
p as (select conv_id, steps[:d] as prefix, d as depth, len(steps) as whole, case when d = 0 then 0 else sizes[d] end as size
      from s, lateral (select unnest(range(0, len(steps) + 1)) as d)),
n as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (whole = depth), '') as ended
  from p group by prefix, depth),
k as (select prefix[:depth - 1] as above, count(*) as n_children from n where depth > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.above = n.prefix),
u as (
  select prefix[:d] as top, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
  from f, lateral (select unnest(range(0, depth + 1)) as d) group by 1)
select f.conv_id, f.depth::bigint as depth, q.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
       u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, sha256(f.ended) as ends_sha256
from f join u on u.top = f.prefix left join n q on f.depth > 0 and q.prefix = f.prefix[:f.depth - 1]
"""
