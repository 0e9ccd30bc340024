"""Training sets and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import strip
from alertlake.operators.joins import small_or_plain
from alertlake.operators.ranking import first_n_per_group
from alertlake.operators.tagging import decode_bio


# ------------------------------------------------------------------ row selection
def balanced_weights(df: DataFrame, *, label: str, weight: str = "weight") -> DataFrame:
    """Adds ``n / (k * n_class)``; the class counts are combined before the shuffle."""
    counts = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    table = small_or_plain(counts.withColumn("_w", totals / F.col("_n")).select("_c", "_w"))
    return df.join(table, F.col(label).eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("_w", weight)


def binary_group(grade: Column) -> Column:
    """TruePositive against FalsePositive/BenignPositive; other grades -> null."""
    return F.when(grade == "TruePositive", "TruePositive").when(
        grade.isin("FalsePositive", "BenignPositive"), "FalsePositive")


def class_capped_sample(
    df: DataFrame, *, group: str, n: int = 50_000, order: Sequence[str]
) -> DataFrame:
    """First ``n`` rows of each class in the given order; rows without a class dropped."""
    return first_n_per_group(df.filter(F.col(group).isNotNull()), group=[group], order=order, n=n)


def head_per_group(df: DataFrame, *, group: str, order: Sequence[str], max_rows: int) -> DataFrame:
    """First ``max_rows / groups`` rows of each group (shard), at least one of each."""
    groups = df.select(group).distinct().count()
    return first_n_per_group(df, group=[group], order=order, n=max(max_rows // max(groups, 1), 1))


def shuffle_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_shuffle(df: DataFrame, *, key: str, seed: int = 42) -> DataFrame:
    """Reproducible random order: sorted by a keyed hash, which also spreads evenly."""
    return df.withColumn("shuffle_key", shuffle_key(F.col(key), seed)).orderBy("shuffle_key", key)


def hash_split(df: DataFrame, *, key: str, test: float = 0.02, seed: int = 42) -> DataFrame:
    """Adds ``split``: a keyed hash decides, so a row never changes sides."""
    bucket = F.pmod(F.conv(F.substring(shuffle_key(F.col(key), seed), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < int(round(test * 10_000)), "test").otherwise("train"))


# ---------------------------------------------------------------------- chat rows
def json_quote(c: Column) -> Column:
    """A text as a JSON string literal."""
    doc = F.to_json(F.array(c))
    return F.substr(doc, F.lit(2), F.length(doc) - 2)


def messages(system: str, user: Column, assistant: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user), message("assistant", assistant))


def triage_chat_rows(
    df: DataFrame, *, grade: str = "IncidentGrade", title: str = "AlertTitle", severity: str = "Severity",
    category: str = "Category", suspicion: str = "SuspicionLevel", keep: Sequence[str] = (),
) -> DataFrame:
    """Alerts with a grade -> ``messages``. Absent and null fields get their defaults."""
    fields = (("normalized_title", title, "Unknown"), ("severity", severity, "Medium"),
              ("category", category, "Unknown"), ("suspicion_level", suspicion, "Unknown"))

    def value(column: str, default: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(default)) if column in df.columns else F.lit(default)

    lines = [F.concat(F.lit(f'  "{name}": '), json_quote(value(column, default)))
             for name, column, default in fields]
    user = F.concat(F.lit("Alert Context:\n{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    shown = F.when(F.col(grade) == "BenignPositive", "FalsePositive").otherwise(
        F.coalesce(F.col(grade), F.lit("FalsePositive")))
    confidence = F.when(shown == "TruePositive", "0.95").otherwise("0.85")
    answer = F.concat(F.lit('{"grade": '), json_quote(shown), F.lit(', "confidence": '), confidence, F.lit("}"))
    return df.select(*keep, messages(fixed.TRIAGE_SYSTEM, user, answer).alias("messages"))


def ner_chat_rows(df: DataFrame, *, tokens: str, tags: str, keep: Sequence[str] = ()) -> DataFrame:
    """Tagged sentences -> ``messages`` listing the decoded entities."""
    pairs = [part for k, v in fixed.LABEL_IOC_TYPES.items() for part in (F.lit(k), F.lit(v))]

    def entity(e: Column) -> Column:
        kind = F.coalesce(F.try_element_at(F.create_map(*pairs), e["label"]), F.lower(e["label"]))
        return F.concat(F.lit('{"text": '), json_quote(e["text"]), F.lit(', "label": '), json_quote(e["label"]),
                        F.lit(', "ioc_type": '), json_quote(kind), F.lit("}"))

    listed = F.array_join(F.transform(decode_bio(F.col(tokens), F.col(tags)), entity), ", ")
    answer = F.concat(F.lit('{"entities": ['), listed, F.lit('], "events": []}'))
    user = F.concat(F.lit("Text:\n"), F.array_join(tokens, " "))
    return df.select(*keep, messages(fixed.ENTITY_SYSTEM, user, answer).alias("messages"))


def summary_chat_rows(
    df: DataFrame, *, report: str = "report", summary: str = "summary", max_chars: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Report/summary pairs -> ``messages``; blank summaries are skipped, ``max_chars`` cuts the report."""
    body = F.coalesce(F.col(report), F.lit(""))
    user = F.concat(F.lit("Incident Report:\n"), body if max_chars is None else F.substring(body, 1, max_chars))
    kept = df.filter(F.length(strip(F.coalesce(F.col(summary), F.lit("")))) > 0)
    return kept.select(*keep, messages(fixed.SUMMARY_SYSTEM, user, F.col(summary)).alias("messages"))


# ------------------------------------------------------------------------- models
def fit_triage_model(
    df: DataFrame, *, features: Sequence[str], label: str = "label", weight: str | None = None,
    trees: int = 50, depth: int = 8, seed: int = 42,
) -> PipelineModel:
    """Distributed three-class forest on the feature columns."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed,
        **({"weightCol": weight} if weight else {}))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, forest]).fit(df)


def fit_boosted_models(
    df: DataFrame, *, features: Sequence[str], validation: str, label: str = "label",
    weight: str | None = None, classes: int = 3, rounds: int = 1000, depth: int = 8,
    rate: float = 0.05, subsample: float = 0.8, seed: int = 42,
) -> list[PipelineModel]:
    """One boosted model per class with early stopping on the ``validation`` rows.

    ``validation`` is a boolean column; keep it apart from the test set.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    models = []
    for k in range(classes):
        one = df.withColumn("_target", (F.col(label) == k).cast("double"))
        booster = GBTClassifier(
            labelCol="_target", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate,
            subsamplingRate=subsample, seed=seed, validationIndicatorCol=validation,
            **({"weightCol": weight} if weight else {}))
        models.append(Pipeline(stages=[assembler, booster]).fit(one))
    return models


def score_boosted(df: DataFrame, models: Sequence[PipelineModel]) -> DataFrame:
    """Normalised class probabilities, prediction and ``ml_score`` of the last class."""
    out = df
    for k, model in enumerate(models):
        out = model.transform(out).withColumn(f"_p{k}", F.get(vector_to_array("probability"), F.lit(1)))
        out = out.drop("features", "rawPrediction", "probability", "prediction")
    probs = F.array(*[F.col(f"_p{k}") for k in range(len(models))])
    total = sum(F.col(f"_p{k}") for k in range(len(models)))
    out = out.withColumn("probabilities", F.transform(probs, lambda p: F.try_divide(p, total)))
    return out.withColumns({
        "prediction": (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"),
        "ml_score": F.element_at("probabilities", -1),
    }).drop(*[f"_p{k}" for k in range(len(models))])
