"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import SPACES, raw

SYMBOLS = "#*$%&|<>"
MAX_LABELLED = 20_000   # labelled documents the trees are fitted on; a documented bound
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature name -> direction in which quality may move as it grows (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "punctuation_share": 0, "distinct_share": 0, "words_per_line": 0, "exclamation_share": 0,
}
PUNCTUATION = re.compile(r"[.,;:!?]")
DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list, width: int = 3) -> tuple[int, int]:
    """(words inside ``width``-word windows that occur twice or more, distinct words)."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(ids) - width + 1
    if n < 2:
        return 0, len(number)
    key = ids[:n]
    for i in range(1, width):  # renumbered each time, so that keys stay below rows times words
        key = np.unique(key * len(number) + ids[i:n + i], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    hit = np.zeros(len(ids), dtype=bool)
    for i in range(width):
        hit[i:n + i] |= again
    return int(hit.sum()), len(number)


def statistics(text: str | None) -> tuple:
    """The counts of ``BASE`` and the values of ``FEATURES`` of one text; null counts as empty."""
    text = text or ""
    words = raw(text).split()
    n, chars = len(words), len(text)
    word_chars = chars - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    some, letters = max(n, 1), max(word_chars, 1)
    return (
        n, word_chars, symbols, dup, repeat,
        float(np.log1p(n)), word_chars / some, symbols / letters, dup / max(len(lines), 1), repeat / some,
        sum(map(str.isupper, text)) / letters, len(DIGIT.findall(text)) / letters, len(PUNCTUATION.findall(text)) / some,
        distinct / some, n / max(len(lines), 1), text.count("!") / some)


class Trees(NamedTuple):
    """All trees in flat node arrays; a leaf points to itself. ``roots`` are the first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row; every step moves all rows through all trees."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 60, depth: int = 4, rate: float = 0.15,
              bins: int = 48, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosting on the logistic loss with histogram splits.

    A feature with a sign may only split if the outputs of both sides keep that order, and the
    middle between them then bounds all later outputs on either side, so that the whole model is
    monotone in that feature. Without both classes the result is a constant.
    """
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(signs))]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(len(signs))], axis=1) if len(x) else np.zeros((0, len(signs)), int)
    logit = np.full(len(y), base)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, level: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        here = len(nodes)
        nodes.append([0, np.inf, here, here, rate * float(np.clip(-g / (h + ridge), low, high))])
        best = (1e-6, None)
        for f, sign in enumerate(signs) if level < depth and len(rows) >= 2 * least else ():
            if not len(cuts[f]):
                continue
            b, size = binned[rows, f], len(cuts[f]) + 1
            gs, hs, ns = (np.bincount(b, w, size).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            lv, rv = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            ok = (ns >= least) & (len(rows) - ns >= least) & (sign * (rv - lv) >= 0)
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, (lv[k] + rv[k]) / 2))
        if best[1]:
            f, k, middle = best[1]
            to_left = binned[rows, f] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
            left = grow(rows[to_left], grad, hess, *bounds[0], level + 1)
            right = grow(rows[~to_left], grad, hess, *bounds[1], level + 1)
            nodes[here] = [f, cuts[f][k], left, right, 0.0]
        return here

    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1.0 / (1.0 + np.exp(-logit))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
        one = _flat(nodes, [first], depth, 0.0)
        logit += np.log(one.score(x) / (1 - one.score(x)))
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list], roots: list[int], depth: int, base: float) -> Trees:
    kinds = (np.int64, float, np.int64, np.int64, float)
    columns = [np.array([n[i] for n in nodes], dtype=k) for i, k in enumerate(kinds)]
    return Trees(*columns, np.array(roots, dtype=np.int64), depth, base)


SCHEMA = ", ".join([*(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])


def with_statistics(docs: DataFrame, text: str, keep: list) -> DataFrame:
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])

    return docs.select(*keep, F.pandas_udf(count, SCHEMA)(F.col(text)).alias("_s")).select("*", "_s.*").drop("_s")


def fit_quality(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, label_id: str, limit: int = MAX_LABELLED) -> Trees:
    """Trees fitted on at most ``limit`` labelled documents, chosen by hash of the id."""
    chosen = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    chosen = chosen.distinct().orderBy(F.xxhash64("_id", F.lit(5)), "_id", "_y").limit(limit)
    own = docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text"))  # no other column can clash
    known = own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_text")
    # Ids of a bounded sample; of repeated rows any one is the same.
    rows = with_statistics(known, "_text", ["_id", "_y"]).dropDuplicates().toPandas().sort_values(["_id", "_y", *BASE])
    return fit_trees(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float), tuple(FEATURES.values()))


def judge_quality(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
                  label_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id``, the counts of ``BASE``, base_failed, kept, score.

    ``kept`` is false for a text that fails the base rules (fewer than 50 words, or more than
    half of them in repeated three-word windows), else the trees' verdict. Null and empty texts
    have no words and fail. Without labels the trees say keep. Repeated rows are kept; an empty
    table gives an empty result; extra columns are ignored.
    """
    model = fit_quality(docs, labels, id=id, text=text, label=label, label_id=label_id)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain values travel best

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])
            rows["score"] = Trees(*sent.value).score(rows[list(FEATURES)].to_numpy(float))
            yield rows[[*BASE, "score"]]

    kinds = ", ".join(f"{c} long" for c in BASE) + ", score double"
    rows = docs.select(F.col(id).alias(id), F.pandas_udf(judge, kinds)(F.col(text)).alias("_s"))
    failed = (F.col("_s.n_words") < MIN_WORDS) | (F.col("_s.n_repeat_words") * 100 > F.col("_s.n_words") * MAX_REPEAT_PERCENT)
    return rows.select(id, *[f"_s.{c}" for c in BASE], failed.alias("base_failed"), (~failed & (F.col("_s.score") >= threshold)).alias("kept"), "_s.score")
