"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.session import materialize, release


def _stars(sym: DataFrame) -> DataFrame:
    """(u, v, m): each link with the least node among u and its neighbours."""
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sym.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node it is connected with.

    Links are replaced round by round by links to smaller nodes (large star, then small star);
    the number of rounds grows with the logarithm of the longest path. Per node only a minimum
    is gathered, and every round is a table in the shared folder. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")
    now, state = materialize(pairs.where("u > v").distinct(), "links"), None
    while True:
        n, check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not n or (n, check) == state:
            break
        state = (n, check)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = _stars(large)
        # A link (u, v), v < u, becomes (v, m) and (u, m).
        ends = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(ends.where("u > v").distinct(), "links")
        release(last)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
