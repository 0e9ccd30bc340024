"""Lookup join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``rows`` rows and about ``max_bytes`` bytes, counted as JSON.

    Reads no more than ``rows + 1`` rows.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return n <= rows and (total or 0) <= max_bytes


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after rows and bytes were checked; else no hint."""
    return F.broadcast(df) if is_small(df, rows, max_bytes) else df


def heavy_threshold(counts: DataFrame, n: str, share: int = SHARE) -> Column:
    """Row count from which a key holds at least ``1/share`` of all rows.

    At most ``share`` keys can reach it, which bounds what is broadcast.
    """
    return counts.agg(F.greatest(F.ceil(F.sum(n) / F.lit(share)), F.lit(2))).scalar()


def balanced_lookup(
    facts: DataFrame,
    *,
    heavy: DataFrame,
    light: DataFrame,
    keys: Sequence[str],
    value: str,
) -> DataFrame:
    """Left-join ``value`` onto ``facts``; null keys match null keys.

    ``heavy`` holds the few frequent keys (at most ``SHARE`` rows, see
    :func:`heavy_threshold`) and is broadcast. ``light`` holds all other keys and
    is joined by shuffle; rows already answered get a spread-out key that matches
    nothing, so they do not pile up in one partition.
    """
    hot = F.broadcast(
        heavy.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
                     F.struct(F.col(value).alias("v")).alias("_hot"))
    )
    cold = light.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)],
                        F.lit(0).alias("_lsalt"),
                        F.struct(F.col(value).alias("v")).alias("_cold"))
    on_hot = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    on_cold = [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)]
    spread = F.when(
        F.col("_hot").isNull(), F.lit(0)
    ).otherwise(F.pmod(F.xxhash64(*facts.columns), F.lit(4096)).cast("int") + 1)
    joined = (
        facts.join(hot, on_hot, "left")
        .withColumn("_fsalt", spread)
        .join(cold, [*on_cold, F.col("_fsalt") == F.col("_lsalt")], "left")
    )
    return joined.select(
        *facts.columns,
        F.coalesce(F.col("_hot.v"), F.col("_cold.v")).alias(value),
    )
