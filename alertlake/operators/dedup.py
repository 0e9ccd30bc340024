"""Removing repeats and scoring each distinct content once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.text import unnest
from alertlake.operators.joins import balanced_lookup, heavy_threshold, small_or_plain
from alertlake.operators.ranking import first_per_group
from alertlake.session import materialize

NEVER = -(2**62)  # "nothing accepted yet"
FAN_IN = 16


def dedup_exact(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, no time limit."""
    return first_per_group(df, group=key, order=order)


# ------------------------------------------------------------ time-limited dedup
def dedup_batch(
    df: DataFrame,
    *,
    key: Sequence[str],
    ts: str,
    id: str,
    ttl_seconds: int = 3600,
    mark: bool = False,
    hot_rows: int = 20_000,
) -> DataFrame:
    """Greedy time-limited dedup over a stored table.

    The first row of a key passes and blocks the key for ``ttl_seconds``; blocked
    rows do not extend the block. ``id`` must be unique and orders rows with equal
    time. ``mark=True`` keeps every row and adds ``deduplicated``. A row without time
    or id cannot be placed: it passes and blocks nothing.

    Distinct (key, time) pairs are formed first (combined before the shuffle), so
    rows that share a time cost nothing later. Keys with at most ``hot_rows``
    times are walked in one array; the others are cut into time segments, see
    :func:`_accepted_hot`.
    """
    ttl = int(ttl_seconds) * 1_000_000
    placed = F.col(ts).isNotNull() & F.col(id).isNotNull()
    loose, df = df.filter(~placed), df.filter(placed)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    times = materialize(
        df.groupBy(*key, micros.alias("_t")).agg(F.min(id).alias("_first")),
        "dedup-times",
    )
    counts = times.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")
    ).filter(F.col("_n") > hot_rows)
    shape = counts.agg(F.count(F.lit(1)), F.max("_n"), F.min("_lo"), F.max("_hi")).first()
    pairs = times.select(*key, "_t")
    if shape[0] == 0:
        accepted = _accepted_plain(pairs, key, ttl)
    else:
        hot_keys = materialize(counts.select(*key), "dedup-hot")
        hot_keys = small_or_plain(hot_keys)
        match = [pairs[k].eqNullSafe(hot_keys[k]) for k in key]
        hot = pairs.join(hot_keys, match, "left_semi")
        cold = pairs.join(hot_keys, match, "left_anti")
        accepted = _accepted_plain(cold, key, ttl).unionByName(
            _accepted_hot(hot, key, ttl, rows=shape[1], low=shape[2], high=shape[3], hot_rows=hot_rows)
        )
    winners = times.join(accepted, [times[k].eqNullSafe(accepted[k]) for k in key]
                         + [times["_t"] == accepted["_t"]], "left_semi").select(
        F.col("_first").alias("_winner")
    )
    joined = df.join(winners, df[id] == winners["_winner"], "left" if mark else "left_semi")
    if mark:
        marked = joined.withColumn("deduplicated", F.col("_winner").isNull()).drop("_winner")
        return marked.unionByName(loose.withColumn("deduplicated", F.lit(False)))
    return joined.unionByName(loose)


def _accepted_plain(pairs: DataFrame, key: Sequence[str], ttl: int) -> DataFrame:
    """Walk each key's sorted times, carrying the last accepted one."""
    start = F.struct(
        F.lit(NEVER).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out")
    )

    def step(acc: Column, t: Column) -> Column:
        return F.when(
            t >= acc["last"] + F.lit(ttl),
            F.struct(t.alias("last"), F.array_append(acc["out"], t).alias("out")),
        ).otherwise(acc)

    walked = F.aggregate(F.col("_ts"), start, step, lambda acc: acc["out"])
    grouped = pairs.groupBy(*key).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    return unnest(grouped, key, walked, name="_t")


def _run(times: np.ndarray, last: int, ttl: int) -> list[int]:
    """Accepted times of one segment, given the last accepted time before it."""
    out = []
    i = int(np.searchsorted(times, last + ttl)) if last > NEVER else 0
    while i < len(times):
        out.append(int(times[i]))
        i = int(np.searchsorted(times, times[i] + ttl))
    return out


def _trim(hi: np.ndarray, out: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop steps no entry time can reach and merge neighbours with one result."""
    reach = int(np.searchsorted(hi, limit)) + 1
    hi, out = hi[:reach], out[:reach]
    last_of_run = np.append(out[1:] != out[:-1], True) if len(out) else np.zeros(0, bool)
    return hi[last_of_run], out[last_of_run]


def _segment_steps(times: np.ndarray, begin: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function: first allowed time -> last accepted time after the segment.

    Step ``i`` applies when the first allowed time is at most ``hi[i]`` (and above
    ``hi[i-1]``). Beyond the last step nothing in the segment is accepted.
    """
    follow = np.searchsorted(times, times + ttl)
    at = np.arange(len(times))
    while True:
        step = follow[at]
        moving = step < len(times)
        if not moving.any():
            break
        at = np.where(moving, step, at)
    return _trim(times, times[at], begin + ttl)


def _compose(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], begin: int, ttl: int
) -> tuple[np.ndarray, np.ndarray]:
    """Step function of two neighbouring stretches of time; ``begin`` is the start of the left one."""
    (lhi, lout), (rhi, rout) = left, right
    slot = np.searchsorted(rhi, lout + ttl)
    through = lout.copy()
    hit = slot < len(rhi)
    through[hit] = rout[slot[hit]]
    beyond = rhi > (lhi[-1] if len(lhi) else NEVER)
    return _trim(np.concatenate([lhi, rhi[beyond]]), np.concatenate([through, rout[beyond]]), begin + ttl)


def _accepted_hot(
    pairs: DataFrame, key: Sequence[str], ttl: int, *, rows: int, low: int, high: int, hot_rows: int
) -> DataFrame:
    """Accepted times of keys too large for one task.

    Time is cut into segments of at least one TTL. What a segment does depends
    only on the last time accepted before it, and that dependence is a monotone
    step function with at most one step per time inside one TTL. Functions of
    ``FAN_IN`` neighbours are composed per round (log rounds), the incoming times
    are then handed down the same tree, and every segment is walked on its own.
    """
    span = high - low + 1
    wanted = max(1, math.ceil(rows / hot_rows) * 8)
    width = max(ttl, math.ceil(span / wanted))
    levels, reach = 1, FAN_IN * width
    while reach < span:
        levels, reach = levels + 1, reach * FAN_IN
    key = list(key)
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    key_ddl = ", ".join(f"`{k}` {fields[k]}" for k in key)
    placed = pairs.withColumn("_node", F.expr(f"(_t - {low}L) div {width}L"))

    def with_key(head: pd.DataFrame, data: dict) -> pd.DataFrame:
        out = pd.DataFrame(data)
        for position, name in enumerate(key):
            out.insert(position, name, pd.Series([head[name].iloc[0]] * len(out), dtype=object))
        return out

    def steps_frame(head: pd.DataFrame, node: int, steps: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        return with_key(head, {"_node": np.full(len(steps[0]), node, np.int64), "_hi": steps[0], "_out": steps[1]})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["_node"].iloc[0])
        times = np.sort(pdf["_t"].to_numpy(np.int64))
        return steps_frame(pdf, node, _segment_steps(times, low + node * width, ttl))

    def children(pdf: pd.DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        for node, part in pdf.sort_values(["_node", "_hi"]).groupby("_node"):
            yield int(node), (part["_hi"].to_numpy(np.int64), part["_out"].to_numpy(np.int64))

    def merge_at(level: int):
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            parent = int(pdf["_parent"].iloc[0])
            begin = low + parent * FAN_IN**level * width
            merged = None
            for _, steps in children(pdf):
                merged = steps if merged is None else _compose(merged, steps, begin, ttl)
            return steps_frame(pdf, parent, merged)
        return merge

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        last = int(pdf["_last"].iloc[0])
        nodes, lasts = [], []
        for node, (hi, out) in children(pdf):
            nodes.append(node)
            lasts.append(last)
            slot = int(np.searchsorted(hi, last + ttl))
            last = int(out[slot]) if slot < len(hi) else last
        return with_key(pdf, {"_node": np.array(nodes, np.int64), "_last": np.array(lasts, np.int64)})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy(np.int64))
        return with_key(pdf, {"_t": np.array(_run(times, int(pdf["_last"].iloc[0]), ttl), np.int64)})

    def entered(rows: DataFrame, entry: DataFrame, at: str) -> DataFrame:
        e = entry.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(key)], F.col("_node").alias("_enode"), "_last")
        on = [rows[k].eqNullSafe(e[f"_e{i}"]) for i, k in enumerate(key)]
        return rows.join(e, on + [rows[at] == e["_enode"]]).select(*rows.columns, "_last")

    steps_ddl = f"{key_ddl}, _node bigint, _hi bigint, _out bigint"
    parent = F.expr(f"_node div {FAN_IN}").alias("_parent")
    tree = [materialize(placed.groupBy(*key, "_node").applyInPandas(build, steps_ddl), "dedup-steps")]
    for level in range(1, levels):
        tree.append(materialize(
            tree[-1].select("*", parent).groupBy(*key, "_parent").applyInPandas(merge_at(level), steps_ddl), "dedup-steps"))
    entry = pairs.select(*key).distinct().select(
        *key, F.lit(0).cast("long").alias("_node"), F.lit(NEVER).cast("long").alias("_last"))
    for level in range(levels - 1, -1, -1):
        below = entered(tree[level].select("*", parent), entry, "_parent")
        entry = materialize(below.groupBy(*key, "_parent").applyInPandas(
            hand_down, f"{key_ddl}, _node bigint, _last bigint"), "dedup-entry")
    return entered(placed, entry, "_node").groupBy(*key, "_node").applyInPandas(walk, f"{key_ddl}, _t bigint")


# ------------------------------------------------------- compute once per content
def score_once_per_content(
    df: DataFrame,
    *,
    partition: Sequence[str],
    text: str,
    id: str,
    score: Callable[[DataFrame], DataFrame],
    result: str = "score",
    mode: str | None = None,
    ttl_seconds: int | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Score each distinct (partition, content[, mode]) once and share the result.

    ``score`` receives a DataFrame with the ``text`` column and must add
    ``result``. ``cached`` is false on the row that was scored: the lowest ``id``
    of the content, or, with ``ttl_seconds``, the first row of each TTL window.
    The input is read twice: once for the distinct contents, which are written
    out, once for the join.
    Contents repeated very often are joined by broadcast (their number is bounded
    by :func:`heavy_threshold`), the others by shuffle.
    """
    content = F.struct(F.col(text), F.col(mode)) if mode else F.struct(F.col(text))
    hashed = df.withColumn("_hash", F.sha2(F.to_json(content), 256))
    keys = [*partition, "_hash"]
    distinct = materialize(hashed.groupBy(*keys).agg(
        F.first(text).alias(text),
        F.min(id).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        *([F.first(mode).alias(mode)] if mode else []),
    ), "distinct-content")
    limit = heavy_threshold(distinct, "_n")

    def scored(part: DataFrame) -> DataFrame:
        return score(part).select(
            *keys, F.struct(F.col(result).alias("value"), F.col("_first").alias("first")).alias("_shared")
        )

    joined = balanced_lookup(
        hashed,
        heavy=scored(distinct.filter(F.col("_n") >= limit)),
        light=scored(distinct.filter(F.col("_n") < limit)),
        keys=keys,
        value="_shared",
    )
    out = joined.withColumn(result, F.col("_shared.value")).withColumn(
        "cached", F.col(id) != F.col("_shared.first")
    ).drop("_shared")
    if ttl_seconds is not None:
        out = dedup_batch(
            out.drop("cached"), key=keys, ts=ts, id=id, ttl_seconds=ttl_seconds, mark=True
        ).withColumnRenamed("deduplicated", "cached")
    return out.drop("_hash")
