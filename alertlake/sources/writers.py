"""Batch writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake import fixed


def write_chat_jsonl(df: DataFrame, path: str, *, messages: str = "messages", mode: str = "errorifexists",
                     compression: str = "gzip") -> None:
    """One ``{"messages": [...]}`` object per line; ``compression="none"`` writes plain text.

    Every row repeats the system prompt, so that plain files are many times as large as their texts.
    """
    df.select(F.col(messages).alias("messages")).write.mode(mode).json(path, compression=compression)


def feature_metadata(
    train: DataFrame, test: DataFrame, *, label: str, features: Sequence[str], categories: Sequence[str],
    fingerprint: str = "", target_map: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row describing the feature table; counts come from one small aggregate per split."""
    target_map = target_map or {g: i for i, g in enumerate(fixed.GRADES)}
    cats = set(categories)
    counted = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    dist = counted.agg(
        F.sum("n").alias("train_samples"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col(label).cast("string"), F.col("n")))))).alias("class_distribution"))
    n_cat = len([f for f in features if f in cats])
    return dist.withColumns({
        "test_samples": test.agg(F.count(F.lit(1))).scalar(),
        "raw_data_hash": F.lit(fingerprint), "encoding_method": F.lit("TargetEncoder"),
        "n_features": F.lit(len(features)), "n_categorical": F.lit(n_cat), "n_numeric": F.lit(len(features) - n_cat),
        "feature_names": F.array(*[F.lit(f) for f in features]),
        "target_map": F.create_map(*[x for k, v in target_map.items() for x in (F.lit(k), F.lit(v))]),
    })


def write_feature_table(
    train: DataFrame, test: DataFrame, path: str, *, label: str, features: Sequence[str],
    categories: Sequence[str], fingerprint: str = "", mode: str = "errorifexists",
) -> None:
    """``<path>/train``, ``<path>/test`` (Parquet) and ``<path>/metadata`` (JSON, one row)."""
    train.select(*features, label).write.mode(mode).parquet(f"{path}/train")
    test.select(*features, label).write.mode(mode).parquet(f"{path}/test")
    spark = train.sparkSession
    feature_metadata(
        spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"), label=label, features=features,
        categories=categories, fingerprint=fingerprint,
    ).coalesce(1).write.mode(mode).json(f"{path}/metadata")


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write the next state of a keyed table beside the one it was read from.

    Rewriting the same version (a retry) replaces it, so a repeat is harmless.
    """
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
