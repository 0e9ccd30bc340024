"""Batch readers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.functions.text import computed_once, let

SPAN_SCHEMA = (
    "content string, cyberevent struct<hopper:array<struct<events:array<struct<"
    "argument:array<struct<type:string,startOffset:int,endOffset:int,text:string>>>>>>>, "
    "_corrupt_record string"
)
SPLITS = ("train", "validation", "test")


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header; no data pass, no type inference."""
    return spark.read.option("header", True).csv(path).columns


def read_labelled_csv(
    spark: SparkSession, path: str, *, label: str = "IncidentGrade", columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (all text) and a one-row count ``read_rows, kept_rows, dropped_rows``.

    ``columns`` restricts the scan to those columns plus the label. Identifiers
    stay text, so ``12`` never turns into ``12.0``.
    """
    names = csv_columns(spark, path)
    if label not in names:
        raise ValueError(f"label column {label} is absent in {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if columns is not None:
        raw = raw.select(*dict.fromkeys([*columns, label]))
    counts = raw.agg(
        F.count(F.lit(1)).alias("read_rows"), F.count(label).alias("kept_rows")
    ).withColumn("dropped_rows", F.col("read_rows") - F.col("kept_rows"))
    return raw.dropna(subset=[label]), counts


def read_split_parquet(
    spark: SparkSession, folder: str, *, columns: Sequence[str] = ("report", "summary"),
    splits: Sequence[str] = SPLITS,
) -> DataFrame:
    """``<split>-*.parquet`` shards of every split, with a ``split`` column.

    A split without shards is an error.
    """
    out = None
    for split in splits:
        try:
            part = spark.read.parquet(f"{folder}/{split}-*.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(f"no parquet shards for split {split} in {folder}") from e
            raise
        part = part.select(*columns, F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def read_conll(spark: SparkSession, path: str, *, line_ending: str | None = None) -> DataFrame:
    """Token/tag text -> one row per sentence: ``file, sentence_id, tokens, ner_tags``.

    The blank line between sentences is used as the record separator, so big files
    split over tasks and no window over lines is needed. ``line_ending`` is looked
    up in the first line when not given; other blank lines inside a record
    (spaces, mixed endings) split it further. ``sentence_id`` grows in file order.
    """
    if line_ending is None:
        first = spark.read.option("lineSep", "\n").text(path).first()
        line_ending = "\r\n" if first and first[0].endswith("\r") else "\n"
    records = spark.read.option("lineSep", line_ending * 2).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record"), "value")
    sentence = records.select("file", "record", F.posexplode(
        F.split("value", r"\r?\n[ \t\r]*\n", -1)).alias("part", "block"))
    lines = F.transform(F.split("block", r"\r?\n", -1), lambda x: F.rtrim(x, F.lit(" \t\n\v\f\r")))

    def fields(line):
        spaced = let(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)), lambda s: F.when(
            F.size(s) >= 2, F.struct(F.get(s, F.lit(0)).alias("token"), F.element_at(s, -1).alias("tag"))))
        return F.when(F.contains(line, F.lit("\t")), let(F.split(line, "\t", 3), lambda t: F.struct(
            F.get(t, F.lit(0)).alias("token"), F.get(t, F.lit(1)).alias("tag")))).otherwise(spaced)

    rows = F.filter(F.transform(lines, fields), lambda r: r.isNotNull())
    return (
        computed_once(sentence, "rows", rows)
        .filter(F.size("rows") > 0)
        .select(
            "file", (F.col("record").cast("decimal(20,0)") * 1_000_000 + F.col("part")).cast("decimal(38,0)").alias("sentence_id"),
            F.transform("rows", lambda r: r["token"]).alias("tokens"),
            F.transform("rows", lambda r: r["tag"]).alias("ner_tags"))
    )


def read_span_json(spark: SparkSession, path: str) -> DataFrame:
    """One annotated JSON document per file; unreadable and empty ones are skipped."""
    docs = spark.read.schema(SPAN_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option(
        "pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    return docs.filter(F.col("_corrupt_record").isNull() & (F.length("content") > 0)).drop("_corrupt_record")


def input_fingerprint(spark: SparkSession, paths: str | Sequence[str], *, digits: int = 16) -> DataFrame:
    """``path, length, sha256`` (leading hex digits) per input file.

    Only the file listing goes through Spark's scan; each task streams its files
    in blocks, so file size is not limited by memory.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        [paths] if isinstance(paths, str) else list(paths)).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch["path"]:
                location = re.sub(r"^file:/+", "file:///", path)
                filesystem, name = fs.FileSystem.from_uri(location)
                h = hashlib.sha256()
                with filesystem.open_input_stream(name) as stream:
                    while block := stream.read(8 << 20):
                        h.update(block)
                sums.append(h.hexdigest()[:digits])
            yield batch.assign(sha256=sums)

    return listing.mapInPandas(digest, "path string, length bigint, sha256 string")
