"""Model quality: classification, entity and summary scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.stem import stem_word
from alertlake.operators.tagging import bio_runs


def confusion_matrix(df: DataFrame, *, label: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per true class, one ``pred_<class>`` count column per predicted class."""
    counts = df.groupBy(F.col(label).alias("label")).pivot(pred, list(classes)).count()
    return counts.select("label", *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes])


def classification_report(
    df: DataFrame, *, label: str, pred: str, score: str | None = None
) -> DataFrame:
    """``class, precision, recall, f1, support`` per class plus three summary rows.

    All figures come from one aggregated (label, prediction) table of at most
    k*k rows. ``score`` adds its overall mean as ``mean_score``.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    if score:
        sums.append(F.sum(F.col(score)).alias("s"))
    cells = df.groupBy(F.col(label).cast("string").alias("l"), F.col(pred).cast("string").alias("p")).agg(*sums)
    sides = F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted")),
    ).cast("array<struct<class:string,support:bigint,predicted:bigint>>"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    per = (
        cells.select(sides.alias("c"), (hit / 2).alias("half"))
        .groupBy("c.class")
        .agg(F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("half").alias("tp"))
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted").cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), (F.col("predicted") + F.col("support")).cast("double")), F.lit(0.0))
    per = per.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    accuracy = F.sum("tp") / total
    summary = per.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"),
                     accuracy.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")),
        ).alias("rows")).select(F.inline("rows"))
    out = per.drop("tp").unionByName(summary)
    if score:
        out = out.withColumn("mean_score", cells.agg(F.sum("s") / F.sum("n")).scalar())
    return out


def drop_ignored(labels: Column, other: Column, *, ignored: int | str = -100) -> Column:
    """``other`` at the positions where ``labels`` is not the ignored value."""
    kept = F.filter(F.arrays_zip(labels.alias("l"), other.alias("o")), lambda r: r["l"] != ignored)
    return F.transform(kept, lambda r: r["o"])


def _matched_spans(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    rows = []
    for sides in zip(gold, pred):
        g, p = (None if tags is None else bio_runs(tags, "open") for tags in sides)
        both = None if g is None or p is None else len(set(g) & set(p))
        rows.append((both, None if p is None else len(p), None if g is None else len(g)))
    return pd.DataFrame(rows, columns=["correct", "predicted", "gold"], dtype="Int64")


def entity_prf(df: DataFrame, *, gold: str, pred: str) -> DataFrame:
    """Exact-match entity precision, recall and F1 over tag arrays.

    Both tag sequences sit in one row: a row is matched in one linear pass, in Arrow batches, and
    only three sums are shuffled. Where one side is null, the other's entities count as unmatched.
    """
    counts = df.select(F.pandas_udf(_matched_spans, "correct long, predicted long, gold long")(gold, pred).alias("n"))
    sums = counts.agg(*[F.sum(f"n.{c}").alias(c) for c in ("correct", "predicted", "gold")])
    precision = F.coalesce(F.try_divide(F.col("correct"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("correct"), F.col("gold")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("correct"), F.col("predicted") + F.col("gold")), F.lit(0.0))
    return sums.select("correct", "predicted", "gold", precision.alias("precision"), recall.alias("recall"),
                       f1.alias("f1"))


# -------------------------------------------------------------------------- ROUGE
def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda t: t != "")


def _lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence length, one big-integer bit row per token."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for token in b:
        hits = row & where.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def _f_measure(hits: int, predicted: int, wanted: int) -> float:
    return 2 * hits / (predicted + wanted) if hits else 0.0


def _overlap(p: Sequence[str], r: Sequence[str], n: int) -> float:
    grams = [Counter(zip(*[tokens[i:] for i in range(n)])) for tokens in (p, r)]
    return _f_measure((grams[0] & grams[1]).total(), grams[0].total(), grams[1].total())


def _measures(stem: bool) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    stems: dict[str, str] = {}

    def tokens(words: Sequence[str] | None) -> list[str]:
        if words is None:
            return []
        if not stem:
            return list(words)
        for word in words:
            if word not in stems:
                if len(stems) > 200_000:
                    stems.clear()
                stems[word] = stem_word(word) if len(word) > 3 else word
        return [stems.get(w) or stem_word(w) for w in words]

    def measure(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(map(tokens, pred), map(tokens, ref)):
            rows.append((_overlap(p, r, 1), _overlap(p, r, 2), _f_measure(_lcs_length(p, r) if p and r else 0, len(p), len(r))))
        return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"], dtype="float64")

    return measure


def rouge_scores(df: DataFrame, *, prediction: str, reference: str, stem: bool = True) -> DataFrame:
    """Adds ``rouge1``, ``rouge2`` and ``rougeL``: F-measures of each row's two texts.

    Tokens are lower-case runs of a-z and 0-9; with ``stem`` those of more than three characters are stemmed
    first. Both texts are in the row, so nothing is shuffled; the three measures share one Arrow batch. A null
    text is empty, and a pair without common tokens scores 0.
    """
    score = F.pandas_udf(_measures(stem), "rouge1 double, rouge2 double, rougeL double")
    scored = df.withColumn("_rouge", score(rouge_tokens(F.col(prediction)), rouge_tokens(F.col(reference))))
    return scored.select(*df.columns, "_rouge.*")


def rouge(df: DataFrame, *, prediction: str, reference: str, stem: bool = True) -> DataFrame:
    """Mean ROUGE-1, ROUGE-2 and ROUGE-L over all pairs: one pass, three numbers."""
    scored = rouge_scores(df, prediction=prediction, reference=reference, stem=stem)
    names = ("rouge1", "rouge2", "rougeL")
    means = scored.agg(*[F.avg(n).alias(n) for n in names])
    return means.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("mean_f")) for n in names])))
