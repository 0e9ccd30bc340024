"""Scoring alerts with heuristics, MLlib models, external models or stored replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions import risk
from alertlake.functions.text import computed_once, strip

ENRICHED_COLUMNS = (
    "alert_id", "tenant_id", "timestamp", "source", "normalized_title", "severity", "raw_data",
    "ml_score", "risk_score", "incident_grade", "auto_closed", "model_version", "mitre_tactic",
    "mitre_technique", "entity_type", "device_name", "ip_address", "user_name", "category",
    "asset_criticality", "behavioral_score",
)


def triage(
    alerts: DataFrame,
    *,
    ml: str | None = None,
    grade: Column | None = None,
    mode: str = "stream",
    rules: str = "full",
    model_version: str = "latest",
) -> DataFrame:
    """Context scores, risk, grade override and auto-close for canonical alerts.

    Without ``ml`` the heuristic on ``suspicion_level`` is used. One narrow
    projection chain: no shuffle, no Python. Context scores and risk are pinned, as
    grade and routing use each of them several times.
    """
    suspicion, title = F.col("suspicion_level"), F.col("normalized_title")
    score = F.col(ml).try_cast(risk.DEC) if ml else risk.heuristic_score(suspicion)
    context = F.struct(
        score.alias("ml_score"),
        risk.asset_criticality(F.col("severity"), title, F.col("raw_data"), mode=mode).alias("asset_criticality"),
        risk.behavioral_score(suspicion, title, F.col("mitre_tactic"), mode=mode).alias("behavioral_score"))
    out = computed_once(alerts, "_context", context)
    out = out.withColumns({c: F.col(f"_context.{c}") for c in ("ml_score", "asset_criticality", "behavioral_score")}).drop("_context")
    out = out.withColumn("model_grade", grade if grade is not None else risk.heuristic_grade(F.col("ml_score")))
    out = computed_once(out, "risk_score", risk.risk_score(
        F.col("ml_score"), F.col("asset_criticality"), F.col("behavioral_score")))
    return out.withColumns({
        "incident_grade": risk.override_grade(
            F.col("model_grade"), F.col("risk_score"), F.col("asset_criticality"),
            F.col("behavioral_score"), rules=rules),
        "auto_closed": risk.auto_close(F.col("ml_score"), F.col("risk_score")),
        "model_version": F.lit(model_version),
    })


def is_forwarded() -> Column:
    """Whether a scored alert is sent on; auto-closed ones are not."""
    return ~F.col("auto_closed")


def route_alerts(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persisted, forwarded): auto-closed alerts are stored but not sent on."""
    persisted = scored.withColumn(
        "status", F.when(F.col("auto_closed"), fixed.STATUS_CLOSED).otherwise(fixed.STATUS_TRIAGED)
    )
    return persisted, persisted.filter(is_forwarded())


SCORE_BOUNDS = {"ml_score": (0, 1), "risk_score": (0, 100), "asset_criticality": (0, 1), "behavioral_score": (0, 1)}


def check_scores(
    scored: DataFrame, bounds: Mapping[str, tuple[float, float]] = SCORE_BOUNDS
) -> tuple[DataFrame, DataFrame]:
    """(alerts whose scores are within bounds, the others with ``reason`` and ``violations``).

    A score that is null, not a number or out of bounds is named as ``null:<score>`` or ``bounds:<score>``.
    """
    faults = [
        F.when(F.col(c).isNull(), F.lit(f"null:{c}"))
        .when(~F.col(c).cast("double").between(low, high), F.lit(f"bounds:{c}")) for c, (low, high) in bounds.items()]
    checked = scored.withColumn("violations", F.array_compact(F.array(*faults)))
    good = F.size("violations") == 0
    return checked.filter(good).drop("violations"), checked.filter(~good).withColumn("reason", F.lit("invalid_scores"))


def to_enriched(forwarded: DataFrame) -> DataFrame:
    """The 21-column output message plus an empty ``ioc_ids``; carried columns are dropped."""
    return forwarded.select(*ENRICHED_COLUMNS, F.array().cast("array<string>").alias("ioc_ids"))


def score_alerts(
    features: DataFrame, model: PipelineModel, *, positive: int = 2, probability: str = "probability"
) -> DataFrame:
    """MLlib scoring: adds ``ml_score`` (probability of the positive class) and ``model_grade``."""
    probs = vector_to_array(F.col(probability))
    grades = F.array(*[F.lit(g) for g in fixed.GRADES])
    return model.transform(features).withColumns({
        "ml_score": F.coalesce(F.get(probs, F.lit(positive)), F.element_at(probs, -1)),
        "model_grade": F.coalesce(
            F.get(grades, F.col("prediction").cast("int")), F.lit("FalsePositive")),
    })


def with_external_model(
    df: DataFrame,
    *,
    features: Sequence[str],
    load_fn: Callable[[], Any],
    predict_fn: Callable[[Any, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply a model that lives in Python, batch-wise and loaded once per task.

    ``predict_fn`` gets the feature columns of one Arrow batch and returns the
    new columns named in ``schema``.
    """
    added = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    ddl = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [schema])
    wanted = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_fn()
        for batch in batches:
            scores = predict_fn(model, batch[wanted])
            yield batch.assign(**{name: scores[name].to_numpy() for name in added})

    return df.mapInPandas(run, ddl)


def parse_triage_replies(
    df: DataFrame, *, reply: str, asset: str | None = None, asset_fallback: str
) -> DataFrame:
    """Read stored model replies ``{grade, confidence, severity}``.

    A reply that is not JSON counts as FalsePositive with confidence 0.5. The
    severity of the reply fills a missing asset score.
    """
    text = strip(F.col(reply))
    unfenced = F.when(
        text.startswith("```json"),
        strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))),
    ).otherwise(text)
    parsed = df.withColumn("_v", F.try_parse_json(unfenced))

    def text_of(key: str) -> Column:
        return F.try_variant_get("_v", f"$.{key}", "string")

    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    confidence = F.when(
        is_object, F.coalesce(F.try_variant_get("_v", "$.confidence", "double"), F.lit(0.5))
    ).otherwise(F.lit(0.5))
    grade = F.when(is_object & (text_of("grade") == "TruePositive"), "TruePositive").otherwise(
        "FalsePositive")
    word = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.severity", "variant")) == "STRING",
                  text_of("severity"))
    severity = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2**31 - 1)))
    by_severity = None
    for name, value in fixed.ASSET_BASE.items():
        score = F.lit(value).cast(risk.DEC)
        by_severity = F.when(F.col("severity") == name, score) if by_severity is None \
            else by_severity.when(F.col("severity") == name, score)
    fallback = F.col(asset_fallback).cast(risk.DEC)
    known = F.col(asset).cast(risk.DEC) if asset else F.lit(None).cast(risk.DEC)
    return (
        parsed.withColumns({"grade": F.coalesce(grade, F.lit("FalsePositive")),
                            "confidence": F.coalesce(confidence, F.lit(0.5)),
                            "severity": severity})
        .withColumn("ml_score", F.when(F.col("grade") == "TruePositive", F.col("confidence"))
                    .otherwise(F.lit(1.0) - F.col("confidence")))
        .withColumn("asset_criticality", F.coalesce(known, by_severity, fallback))
        .drop("_v")
    )
