"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import session
from alertlake.session import release  # noqa: F401

# ASCII white space of the word definition [^\x20\x09-\x0D]+; bytes.split() without an argument
# separates at exactly these bytes, and bytes.lower() changes A-Z only.
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total size of the texts, one number from one aggregation."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0]
    return int(total or 0)


def is_small(df: DataFrame, rows: int, max_bytes: int, size: Column) -> bool:
    """True if ``df`` has at most ``rows`` rows and ``max_bytes`` bytes; reads ``df`` once.

    ``size`` is the number of bytes of one row.
    """
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("double"))).first()
    return n <= rows and (total or 0) <= max_bytes


def materialize(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder; shuffle files of the jobs before it are let go.

    Spark removes the files of a shuffle when the driver's JVM has collected the plan that made
    it, which may be long after. What follows reads the table only, so a collection is asked for
    here: several passes over texts would otherwise pile up on the executors' disks.
    """
    out = session.materialize(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def let_go(spark: SparkSession) -> None:
    """Have the driver's JVM collect, so that Spark removes shuffle files that no plan needs any more.

    What ended last is still referred to for a moment; the second collection finds it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def crc32_sql(text: str) -> str:
    """DuckDB expression: crc32 of an ASCII string, bit by bit."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [256 + ascii(({text})[i]), 0, 0, 0, 0, 0, 0, 0, 0]))"
    turn = "case when x >= 256 then xor(c, x - 256) else xor(c >> 1, (c & 1) * 3988292384) end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}::bigint[]), lambda c, x: {turn}), 4294967295::bigint)"
