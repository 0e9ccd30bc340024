"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import materialize, raw
from alertlake.llm.components import components
from alertlake.session import spread

BITS, SEED = 64, 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 of all ``width``-word shingles; 0 without words."""
    words = raw(text).lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str, into: str, keep: list[str]) -> DataFrame:
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return spread(docs).select(*keep, F.pandas_udf(scores, "long")(F.col(text)).alias(into))


def masks(radius: int) -> list[int]:
    """All signed 64-bit patterns of at most ``radius`` set bits."""
    found = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def fingerprint_links(prints: DataFrame, fp: str, radius: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints that connect whatever is within ``radius`` bits.

    Every fingerprint emits all variants within half the radius, so that two of them within
    ``radius`` share a variant; the fingerprints of one variant (at most as many as a ball has
    points, a constant) are pairwise within ``radius`` and are chained, not paired off. Each
    link is verified.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    ball = F.array(*[F.lit(m) for m in masks(radius // 2)])
    variants = prints.select(F.col(fp).alias("b")).distinct().select("b", F.explode(ball).alias("mask"))
    variants = variants.select("b", F.col("b").bitwiseXOR(F.col("mask")).alias("variant"))
    chained = variants.withColumn("a", F.lag("b").over(Window.partitionBy("variant").orderBy("b"))).where("a is not null")
    return chained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def simhash_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = 2, keep: tuple = ()) -> DataFrame:
    """One row per input row: ``id``, fingerprint (16 hex digits), component_id and the ``keep`` columns.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is
    the least id reachable. Null, empty and blank texts have fingerprint 0, linked like any
    other. A null id never becomes a component_id unless it is alone. Repeated rows are kept,
    an empty table gives an empty result, extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, text, "fp", [F.col(id).alias("id"), *keep]), "prints")
    roots = components(fingerprint_links(prints, "fp", radius), "a", "b")
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id")).join(rooted, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        *[c for c in prints.columns if c not in ("id", "fp")])


def drop_near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the least id, among equal ids the least text hash.

    Rows that agree in id and text are one document, of which one row stays; a component of null
    ids keeps one row too.
    """
    names = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")
    rows = materialize(simhash_components(docs, id=id, text=text, radius=radius, keep=(names,)), "components")
    known = rows.withColumn("_id", F.struct(F.col(id).isNull().alias("no"), F.col(id).alias("id"), F.col("_th").alias("th")))
    # Without any id in a component, its fingerprint's texts are told apart by hash alone.
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    kept = known.groupBy(group.alias("g")).agg(F.min("_id").alias("k"), F.count(F.lit(1)).alias("n"))
    kept = kept.select(F.col("k.id").alias("_kept"), F.col("k.th").alias("_kept_th"))
    own = docs.select(F.struct("*").alias("_row"), F.col(id).alias("_doc"), names)  # no column of the caller's can clash
    found = own.join(kept, F.col("_doc").eqNullSafe(F.col("_kept")) & (F.col("_th") == F.col("_kept_th")))
    repeated = rows.groupBy(id, "_th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        found = found.dropDuplicates(["_kept", "_kept_th"])
    return found.select("_row.*")
