"""Context scores, risk formula, grade override and routing predicates.

All sums run in ``DECIMAL(12,8)``: the inputs are two-digit decimals, so the
result is exact and one final rounding is enough.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import contains_any

DEC = "decimal(12,8)"


def _dec(value: str) -> Column:
    return F.lit(value).cast(DEC)


def _lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """Table lookup that mentions ``key`` once, so pushed-down filters stay small."""
    pairs = [part for name, value in table.items() for part in (F.lit(name), _dec(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), _dec(default))


def _capped(c: Column) -> Column:
    return F.least(c.cast(DEC), _dec("1"))


def heuristic_score(suspicion: Column) -> Column:
    """Score used when no model is available; unknown and null count as Medium."""
    return _lookup(suspicion, fixed.HEURISTIC_SCORES, "0.40")


def heuristic_grade(score: Column) -> Column:
    return F.when(score >= _dec("0.5"), "TruePositive").otherwise("FalsePositive")


def asset_criticality(
    severity: Column, title: Column, raw: Column | None = None, *, mode: str = "stream"
) -> Column:
    """Severity base plus a boost for valuable assets named in the alert.

    ``mode="stream"`` looks at title and raw text with two word lists,
    ``mode="single"`` at the title with one.
    """
    base = _lookup(severity, fixed.ASSET_BASE, "0.50")
    title = F.lower(F.coalesce(title, F.lit("")))
    if mode == "single":
        return _capped(
            base + F.when(contains_any(title, fixed.ASSET_WORDS_SINGLE), _dec("0.15")).otherwise(_dec("0"))
        )
    context = F.concat_ws(" ", title, F.lower(F.coalesce(raw, F.lit(""))))
    boost = (
        F.when(contains_any(context, fixed.ASSET_WORDS_STREAM_HIGH), _dec("0.15"))
        .when(contains_any(context, fixed.ASSET_WORDS_STREAM_LOW), _dec("0.10"))
        .otherwise(_dec("0"))
    )
    return _capped(base + boost)


def behavioral_score(
    suspicion: Column, title: Column, tactic: Column | None = None, *, mode: str = "stream"
) -> Column:
    """Suspicion base plus boosts for tactic and title, capped after each step."""
    base = _lookup(suspicion, fixed.BEHAVIOUR_BASE, "0.45")
    title = F.lower(F.coalesce(title, F.lit("")))
    if mode == "single":
        return _capped(
            base + F.when(contains_any(title, fixed.TITLE_WORDS_SINGLE), _dec("0.10")).otherwise(_dec("0"))
        )
    tactic = F.lower(F.coalesce(tactic, F.lit("")))
    by_tactic = (
        F.when(contains_any(tactic, fixed.TACTIC_WORDS_HIGH), _dec("0.15"))
        .when(contains_any(tactic, fixed.TACTIC_WORDS_LOW), _dec("0.10"))
        .otherwise(_dec("0"))
    )
    by_title = F.when(contains_any(title, fixed.TITLE_WORDS_STREAM), _dec("0.10")).otherwise(_dec("0"))
    return _capped(_capped(base + by_tactic) + by_title)


def risk_score(
    ml: Column, asset: Column, behaviour: Column, *, weights=fixed.RISK_WEIGHTS
) -> Column:
    """Weighted sum, clamped to 0..1, as a percentage with two digits."""
    w_ml, w_asset, w_behaviour = (_dec(str(w)) for w in weights)
    wide = "decimal(24,16)"
    raw = (
        (w_ml * ml.cast(DEC)).cast(wide)
        + (w_asset * asset.cast(DEC)).cast(wide)
        + (w_behaviour * behaviour.cast(DEC)).cast(wide)
    )
    clamped = F.greatest(F.least(raw.cast(wide), F.lit("1").cast(wide)), F.lit("0").cast(wide))
    return F.round(clamped * F.lit(100), 2).cast("double")


def override_grade(
    grade: Column, risk: Column, asset: Column, behaviour: Column, *, rules: str = "full"
) -> Column:
    """Raise the grade when the risk contradicts the model.

    ``rules="basic"`` (stored model replies) only knows the risk >= 50 rule.
    """
    if rules == "basic":
        return F.when(risk >= 50, "TruePositive").otherwise(grade)
    return (
        F.when((risk >= 45) & (asset >= _dec("0.9")) & (behaviour >= _dec("0.75")), "TruePositive")
        .when(risk >= 50, "TruePositive")
        .when((risk >= 35) & (grade == "BenignPositive"), "FalsePositive")
        .otherwise(grade)
    )


def auto_close(
    ml: Column, risk: Column, *, score_below: float = fixed.AUTO_CLOSE_SCORE,
    risk_below: float = fixed.AUTO_CLOSE_RISK,
) -> Column:
    return (ml < F.lit(score_below)) & (risk < F.lit(risk_below))


def keyword_score(title: Column) -> Column:
    """Stub scorer: ``struct<grade,confidence,severity>`` from words in the title."""
    hit = contains_any(F.lower(F.coalesce(title, F.lit(""))), fixed.KEYWORD_TITLE_WORDS)
    return F.struct(
        F.when(hit, "TruePositive").otherwise("FalsePositive").alias("grade"),
        F.when(hit, 0.95).otherwise(0.85).alias("confidence"),
        F.when(hit, "High").otherwise("Low").alias("severity"),
    )
