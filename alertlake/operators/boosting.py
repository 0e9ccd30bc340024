"""Softmax-boosted trees: one tree a class and round, grown from histograms that Spark sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.session import materialize

SUMS_PER_GROUP = 64  # histograms that meet in one group
KEEP_EVERY = 8  # rounds after which scores are written down, so that a pass applies no more trees than these


@dataclass
class Tree:
    """A tree as arrays in heap order: children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` steps; rows in a leaf stay there."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            chosen = self.feature[at]
            inner = chosen >= 0
            b = bins[rows, np.where(inner, chosen, 0)]
            right = np.where(b == 0, ~self.missing_left[at], b > self.bin[at])
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class SoftmaxTrees:
    """A fitted model; ``history`` has (training loss, validation loss or None) before each round and at the end."""

    features: list[str]
    cuts: list[np.ndarray]
    depth: int
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    history: list[tuple[float, float | None]] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value: 0 is missing, b > 0 means that b - 1 cuts are below it."""
        out = np.zeros(values.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            column = values[:, j]
            out[:, j] = np.where(np.isnan(column), 0, 1 + np.searchsorted(cuts, column, side="left"))
        return out

    def margins(self, bins: np.ndarray, since: int = 0, before: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1)) if before is None else before.copy()
        for trees in self.rounds[since:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.nodes(bins, self.depth)]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, name: str, dtype: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _drawn(row_hash: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows of a sample that depends on their content and the round only."""
    mixed = (row_hash.astype(np.uint64) ^ np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(11)).astype(np.float64) / 2**53 < share


def _binned(df: DataFrame, model: SoftmaxTrees, label: str, weight: str | None, validation: str | None) -> DataFrame:
    """One compact row per labelled row: bins, label, weight, whether it validates, a hash, and the scores so far."""
    values = F.array(*[F.col(c).cast("double") for c in model.features])
    rows = df.where(F.col(label).isNotNull()).select(
        values.alias("x"), F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)).alias("valid"),
        F.xxhash64(*model.features).alias("h"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, len(model.features))
            bins, scores = model.bins(x), np.tile(model.start, (len(x), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bins], pa.binary()), *batch.columns[1:], pa.array([r.tobytes() for r in scores], pa.binary())],
                ["bins", "y", "w", "valid", "h", "scores"])

    return materialize(rows.mapInArrow(pack, "bins binary, y int, w double, valid boolean, h long, scores binary"), "binned")


def _rescored(rows: DataFrame, model: SoftmaxTrees, since: int) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch, "bins", "u1", len(model.features))
            scores = model.margins(bins, since, _matrix(batch, "scores", "f8", len(model.start)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([r.tobytes() for r in scores], pa.binary())], batch.schema.names)

    return materialize(rows.mapInArrow(apply, rows.schema), "rescored")


HISTOGRAM = "class int, feature int, salt int, sums binary"


def _histograms(rows: DataFrame, model: SoftmaxTrees, since: int, grown: list[Tree], level: int, bins_n: int,
                subsample: float, used: np.ndarray) -> DataFrame:
    """Sums of gradients and curvatures of each (class, feature) by node and bin; class -1 holds the losses."""
    n_nodes, first, classes, number = 2**level, 2**level - 1, len(model.start), len(model.rounds)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, len(used), 2, n_nodes * bins_n))
        losses = np.zeros(4)
        for batch in batches:
            bins = _matrix(batch, "bins", "u1", len(model.features))
            y, w, valid = _column(batch, "y"), _column(batch, "w"), _column(batch, "valid").astype(bool)
            p = softmax(model.margins(bins, since, _matrix(batch, "scores", "f8", classes)))
            loss = -w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
            losses += [loss[~valid].sum(), w[~valid].sum(), loss[valid].sum(), w[valid].sum()]
            taken = ~valid & _drawn(_column(batch, "h"), number, subsample)
            bins, y, w, p = bins[taken], y[taken], w[taken], p[taken]
            for k, tree in enumerate(grown):
                node = tree.nodes(bins, level) - first
                here = node >= 0
                g, h = (w * (p[:, k] - (y == k)))[here], (w * p[:, k] * (1 - p[:, k]))[here]
                for i, j in enumerate(used):
                    cell = node[here] * bins_n + bins[here, j]
                    sums[k, i, 0] += np.bincount(cell, g, n_nodes * bins_n)
                    sums[k, i, 1] += np.bincount(cell, h, n_nodes * bins_n)
        salt = TaskContext.get().partitionId() // SUMS_PER_GROUP
        yield pa.RecordBatch.from_pylist(
            [{"class": k, "feature": int(j), "salt": salt, "sums": sums[k, i].tobytes()} for k in range(classes) for i, j in enumerate(used)]
            + [{"class": -1, "feature": 0, "salt": salt, "sums": losses.tobytes()}],
            schema=pa.schema([("class", pa.int32()), ("feature", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())]))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in group["sums"]], axis=0)
        return group.iloc[:1].assign(sums=[total.tobytes()], salt=group["salt"].iloc[0] // SUMS_PER_GROUP)

    found, tasks = rows.mapInArrow(collect, HISTOGRAM), rows.rdd.getNumPartitions()
    while tasks > 1:  # a tree of sums, SUMS_PER_GROUP at a time
        found, tasks = found.groupBy("class", "feature", "salt").applyInPandas(add, HISTOGRAM), -(-tasks // SUMS_PER_GROUP)
    return found


def _split_table(found: DataFrame, n_nodes: int, bins_n: int, alpha: float, ridge: float, least: float) -> list:
    """Best split of each (class, node), one row each, and the losses."""
    def pull(g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return pull(g) ** 2 / (h + ridge)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, j, sums in zip(batch["class"], batch["feature"], batch["sums"]):
                if k < 0:
                    continue
                g, h = np.frombuffer(sums).reshape(2, n_nodes, bins_n)
                total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                for missing_left in (False, True):
                    left_g = np.cumsum(g[:, 1:], 1) + (g[:, :1] if missing_left else 0)
                    left_h = np.cumsum(h[:, 1:], 1) + (h[:, :1] if missing_left else 0)
                    gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
                    gain[(left_h < least) | (total_h - left_h < least)] = 0
                    cut = gain.argmax(1)
                    for node in range(n_nodes):
                        c = cut[node]
                        rows.append((k, node, float(gain[node, c]), j, int(c) + 1, missing_left, float(total_g[node, 0]), float(total_h[node, 0]),
                                     float(left_g[node, c]), float(left_h[node, c])))
            yield pd.DataFrame(rows, columns=["class", "node", "gain", "feature", "bin", "missing_left", "g", "h", "left_g", "left_h"])

    splits = found.where("class >= 0").mapInPandas(
        best, "class int, node int, gain double, feature int, bin int, missing_left boolean, g double, h double, left_g double, left_h double")
    chosen = splits.groupBy("class", "node").agg(F.max(F.struct(
        "gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left", "g", "h", "left_g", "left_h")).alias("s"))
    return chosen.select("class", "node", "s.*").collect()  # one row per class and node of a level


def fit_softmax_trees(
    df: DataFrame, *, features: Sequence[str], label: str = "label", weight: str | None = None, validation: str | None = None,
    classes: int = 3, rounds: int = 1000, depth: int = 8, rate: float = 0.05, bins: int = 64, subsample: float = 0.8,
    colsample: float = 0.7, alpha: float = 0.1, ridge: float = 1.0, least: float = 1e-3, patience: int = 50, seed: int = 42,
) -> SoftmaxTrees:
    """Boosting of the softmax loss over ``classes``, one tree a class and round.

    ``label``: 0 to classes - 1, rows without one are left out; null and NaN features go where they serve a
    split best. ``validation``: a boolean column; those rows are not trained on, and after ``patience`` rounds
    without a lower loss on them the best round is taken. Each level is one pass over the compact rows, whose
    histograms are summed by Spark; the driver sees one row per class and node, and one per feature for the
    bounds of the bins. ``alpha`` and ``ridge`` are the L1 and L2 penalties, ``least`` the curvature that a
    child must have. Samples of rows and features depend on contents, round and ``seed`` only.
    """
    assert 2 <= bins <= 254
    features = list(features)
    known = df.where(F.col(label).isNotNull())
    train = known.where(~F.coalesce(F.col(validation), F.lit(False))) if validation else known
    shares = [i / bins for i in range(1, bins)]
    marks = train.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10_000).alias(f"q{i}")
                        for i, c in enumerate(features)]).first()
    cuts = [np.unique(np.array(m if m is not None else [], dtype=float)) for m in marks]
    model = SoftmaxTrees(features, cuts, depth, np.zeros(classes))
    rows, since, bins_n = _binned(df, model, label, weight, validation), 0, bins + 1
    best, best_at = None, 0
    for number in range(rounds + 1):
        if number - since >= KEEP_EVERY:
            rows, since = _rescored(rows, model, since), number
        rng = np.random.default_rng([seed, number])
        used = np.sort(rng.permutation(len(features))[: max(1, round(colsample * len(features)))])
        grown = [Tree.empty(depth) for _ in range(classes)]
        for level in range(depth):
            found = materialize(_histograms(rows, model, since, grown, level, bins_n, subsample, used), "histograms")
            if not level:
                sums = np.sum([np.frombuffer(r.sums) for r in found.where("class < 0").collect()], axis=0)  # one row
                losses = (sums[0] / sums[1] if sums[1] else 0.0, sums[2] / sums[3] if sums[3] else None)
                model.history.append(losses)
                if losses[1] is not None and (best is None or losses[1] < best):
                    best, best_at = losses[1], number
                if number == rounds or (best is not None and number - best_at >= patience):
                    break
            _grow(grown, _split_table(found, 2**level, bins_n, alpha, ridge, least), level, alpha, ridge, rate)
        else:
            model.rounds.append(grown)
            continue
        break
    if best is not None:
        model.rounds, model.history = model.rounds[:best_at], model.history[: best_at + 1]
    return model


def _grow(grown: list[Tree], splits: list, level: int, alpha: float, ridge: float, rate: float) -> None:
    def leaf(g: float, h: float) -> float:
        return -rate * np.sign(g) * max(abs(g) - alpha, 0) / (h + ridge)

    for s in splits:
        tree, at = grown[s["class"]], 2**level - 1 + s["node"]
        if level and tree.feature[(at - 1) // 2] < 0:
            continue
        if not level:
            tree.value[0] = leaf(s.g, s.h)
        if s.gain > 1e-12:
            tree.feature[at], tree.bin[at], tree.missing_left[at] = -s.f, -s.b, s.missing_left
            tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf(s.left_g, s.left_h), leaf(s.g - s.left_g, s.h - s.left_h)


def score_softmax_trees(df: DataFrame, model: SoftmaxTrees, *, positive: int = 2) -> DataFrame:
    """Adds ``probabilities`` (they sum to one), ``prediction`` and ``ml_score``, that of the positive class."""
    from pyspark.sql.functions import pandas_udf

    width = len(model.features)

    @pandas_udf("array<double>")
    def probabilities(values: pd.Series) -> pd.Series:
        x = np.array([np.asarray(v, dtype=float) for v in values], dtype=float).reshape(-1, width)
        return pd.Series(list(softmax(model.margins(model.bins(x)))))

    out = df.withColumn("probabilities", probabilities(F.array(*[F.col(c).cast("double") for c in model.features])))
    return out.withColumns({
        "prediction": (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"),
        "ml_score": F.get("probabilities", F.lit(positive))})
