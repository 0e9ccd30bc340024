"""Summary clean-up as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.functions import grounding
from alertlake.functions.text import computed_once, word_count


def clean_summaries(df: DataFrame, *, summary: str, source: str, drift: bool = False, out: str = "cleaned") -> DataFrame:
    """Adds the cleaned summary; ``drift=True`` also cuts chat markers and off-topic tails and guards against over-trimming."""
    told = grounding.cut_drift(F.col(summary)) if drift else F.col(summary)
    judged = computed_once(computed_once(df, "_told", told), "_kept", grounding.clean_summary(F.col("_told"), F.col(source)))
    kept = grounding.guard_length(F.col("_kept"), F.col("_told"), F.col(source)) if drift else F.col("_kept")
    return judged.withColumn(out, kept).drop("_told", "_kept")


def summary_stats(df: DataFrame, *, source: str, summary: str) -> DataFrame:
    """Adds ``input_tokens`` and ``output_tokens`` (white-space tokens)."""
    return df.withColumns({
        "input_tokens": word_count(F.col(source)), "output_tokens": word_count(F.col(summary))})
