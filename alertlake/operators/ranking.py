"""Choosing rows within groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_key(columns: Sequence[tuple[str, bool]], *, descending: bool) -> Column:
    """A struct whose maximum (or minimum) is the first row of the ordering.

    ``columns`` pairs a column with "nulls first". Struct comparison puts a null
    field lowest, so null placement gets its own leading flag.
    """
    parts = []
    for i, (name, nulls_first) in enumerate(columns):
        flag = F.col(name).isNull() if nulls_first == descending else F.col(name).isNotNull()
        parts += [flag.alias(f"f{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def latest_per_group(
    df: DataFrame,
    *,
    group: Sequence[str],
    order: Sequence[str],
    nulls_first: bool = True,
) -> DataFrame:
    """The row of each group with the highest ``order`` values.

    ``nulls_first=True`` counts a null as newest, the default of a descending SQL
    sort in PostgreSQL. Uses ``max_by``, which combines before the shuffle: a
    group holding a third of all rows sends one row per input partition.
    """
    key = _order_key([(c, nulls_first) for c in order], descending=True)
    return _pick(df, group, F.max_by(F.struct(*df.columns), key))


def first_per_group(
    df: DataFrame, *, group: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The row of each group with the lowest ``order`` values (nulls first)."""
    return _pick(df, group, F.min_by(F.struct(*df.columns), F.struct(*order)))


def _pick(df: DataFrame, group: Sequence[str], chosen: Column) -> DataFrame:
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    return df.groupBy(*keys).agg(chosen.alias("_row")).select("_row.*")


def first_n_per_group(
    df: DataFrame,
    *,
    group: Sequence[str],
    order: Sequence[str | Column],
    n: int,
    fan_in: int = 64,
    position: str | None = None,
) -> DataFrame:
    """Exactly the first ``n`` rows of each group by ``order`` (must be unique).

    Two ranks: the first within (group, salt), the second over the survivors.
    Every level keeps the ``n`` lowest rows, so the result is exact, and no task
    sees more than ``fan_in * n`` rows of one group after the salted step.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(fan_in)))
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    overall = Window.partitionBy(*group).orderBy(*order)
    out = (
        salted.withColumn("_pos", F.row_number().over(within))
        .filter(F.col("_pos") <= n)
        .drop("_salt", "_pos")
        .withColumn("_pos", F.row_number().over(overall))
        .filter(F.col("_pos") <= n)
    )
    return out.withColumnRenamed("_pos", position) if position else out.drop("_pos")
