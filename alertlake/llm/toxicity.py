"""Toxic spans by a linear-chain conditional random field, aggregated to document scores."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import remainder

SLOTS = 1 << 18          # hashed feature weights
DOCS_PER_CLASS = 1500    # labelled documents of each class the field is fitted on; a documented bound
FIT_CHARS = 9_000_000    # characters of each class from which no further document is taken
SEGMENT = 64             # words per training sequence
THRESHOLD = 0.3
CACHE = 200_000          # words whose emission a task remembers

TOKEN = re.compile(r"\S+")


def features(word: str) -> list[str]:
    """The word without punctuation, and its beginnings and ending."""
    core = word.strip(string.punctuation)
    found = ["w:" + core]
    found += [f"p{n}:{core[:n]}" for n in (4, 5, 6, 7, 8) if len(core) > n]
    if len(core) > 4:
        found.append("s3:" + core[-3:])
    return found


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in features(word)]


# --- the field -------------------------------------------------------------
# Two states, so all messages are log-odds of state 1: with transitions t[from][to], the forward
# message obeys a' = e + g(a) and the backward message b = k(e' + b'), and a + b is the logit of
# the marginal.

def _through(x, t00: float, t01: float, t10: float, t11: float):
    """Log-odds after one step from log-odds ``x``; ``tij`` goes from state i to j."""
    return np.logaddexp(t01, x + t11) - np.logaddexp(t00, x + t10)


def _through_one(x: float, t00: float, t01: float, t10: float, t11: float) -> float:
    def add(p: float, q: float) -> float:
        return max(p, q) + math.log1p(math.exp(-abs(p - q)))

    return add(t01, x + t11) - add(t00, x + t10)


def marginal_logits(emissions: np.ndarray, lengths: np.ndarray, start: float, t: tuple, few: int = 24) -> np.ndarray:
    """Logits of state 1 for sequences laid end to end, all sequences stepped together.

    When only ``few`` long sequences are left they go on one by one, which costs less per step.
    """
    t00, t01, t10, t11 = t
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sizes, heads = lengths[order], first[order]
    together = int(sizes[few]) if len(sizes) > few else 0
    alive = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(together)]  # sequences longer than i
    a, b = np.zeros(len(emissions)), np.zeros(len(emissions))
    for i in range(together):
        at = heads[: alive[i]] + i
        a[at] = emissions[at] + (start if i == 0 else _through(a[at - 1], t00, t01, t10, t11))
    for h, n in zip(heads, sizes):
        if n <= together:
            break
        e, out = emissions[h + together:h + n].tolist(), []
        x = float(a[h + together - 1]) if together else None
        for v in e:
            x = v + (start if x is None else _through_one(x, t00, t01, t10, t11))
            out.append(x)
        a[h + together:h + n] = out
        out, y = [], 0.0
        for v in reversed(e):
            out.append(y)
            y = _through_one(v + y, t00, t10, t01, t11)
        b[h + together:h + n] = out[::-1]
        if together:
            b[h + together - 1] = y
    for i in range(together - 2, -1, -1):
        at = heads[: alive[i + 1]] + i
        b[at] = _through(emissions[at + 1] + b[at + 1], t00, t10, t01, t11)
    return a + b


def fit_field(sentences: list[list[list[int]]], tags: list[np.ndarray], epochs: int = 6, rate: float = 0.3, ridge: float = 1e-4,
              batch: int = 1024) -> tuple[np.ndarray, float, tuple]:
    """Weights of the hashed features, start weight and transitions, by Adagrad on the likelihood.

    ``sentences`` hold the feature slots of every word, ``tags`` 0 or 1 for each. All transition
    gradients are expected minus observed counts from the pairwise marginals.
    """
    w, w2 = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    par, par2 = np.zeros(5), np.full(5, 1e-6)  # start, t00, t01, t10, t11
    rng = np.random.default_rng(10)
    for _ in range(epochs if sentences else 0):
        order = rng.permutation(len(sentences))
        for s in range(0, len(order), batch):
            part = order[s:s + batch]
            lengths = np.array([len(sentences[i]) for i in part])
            y = np.concatenate([tags[i] for i in part]).astype(float)
            per = np.array([len(f) for i in part for f in sentences[i]])
            flat = np.fromiter((v for i in part for f in sentences[i] for v in f), dtype=np.int64)
            word = np.repeat(np.arange(len(per)), per)
            e = np.bincount(word, w[flat], len(per))
            start, t00, t01, t10, t11 = par
            logit = marginal_logits(e, lengths, start, (t00, t01, t10, t11), few=0)
            p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            g = np.bincount(flat, (p - y)[word], SLOTS) / len(part) + ridge * w
            heads = np.cumsum(lengths) - lengths
            ends = np.ones(len(y), bool)
            ends[np.cumsum(lengths) - 1] = False
            i = np.nonzero(ends)[0]
            fwd = _forward(e, lengths, start, (t00, t01, t10, t11))
            bwd = logit - fwd + e                        # emission plus backward message
            pair = np.stack([t00 + 0 * i, t01 + bwd[i + 1], fwd[i] + t10, fwd[i] + t11 + bwd[i + 1]])
            pair = np.exp(pair - pair.max(axis=0))
            pair /= pair.sum(axis=0)
            seen = np.stack([(1 - y[i]) * (1 - y[i + 1]), (1 - y[i]) * y[i + 1], y[i] * (1 - y[i + 1]), y[i] * y[i + 1]])
            gp = np.concatenate([[(p - y)[heads].sum()], (pair - seen).sum(axis=1)]) / len(part) + ridge * par
            w2 += g * g
            w -= rate * g / np.sqrt(w2)
            par2 += gp * gp
            par -= rate * gp / np.sqrt(par2)
    return w, float(par[0]), tuple(float(v) for v in par[1:])


def _forward(e: np.ndarray, lengths: np.ndarray, start: float, t: tuple) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    a = np.zeros(len(e))
    for i in range(int(lengths.max(initial=0))):
        at = first[lengths > i] + i
        a[at] = e[at] + (start if i == 0 else _through(a[at - 1], *t))
    return a


# --- documents -------------------------------------------------------------

def labelled_tokens(texts: list[str], toxic: list[int], least: int = 4, odds: float = 20.0) -> list[np.ndarray]:
    """Token labels from document labels.

    A word or word beginning that is found in at least ``least`` toxic documents, and in toxic
    documents ``odds`` times as often as in clean ones, marks its tokens, in toxic documents only.
    """
    found = (Counter(), Counter())
    n = [max(1, toxic.count(k)) for k in (0, 1)]
    for text, k in zip(texts, toxic):
        found[k].update({f for word in set(text.lower().split()) for f in features(word) if not f.startswith("s3:")})
    marks = {f for f, c in found[1].items() if c >= least and c / n[1] >= odds * (found[0][f] + 0.1) / n[0]}
    return [
        np.array([k == 1 and any(f in marks for f in features(word)) for word in text.lower().split()], dtype=np.int8)
        for text, k in zip(texts, toxic)]


class Emissions(dict):
    """Emission weight of a word, computed once while it is remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = float(self.weights[slots(word)].sum())
        return value


def document_parts(texts: list[str], emissions: Emissions, start: float, t: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """(per document: 1, the two strongest logits, log of the expected number of toxic words; marginals).

    The second strongest word tells a text that means it from one chance hit.
    """
    words = [text.lower().split() for text in texts]
    lengths = np.array([len(x) for x in words], dtype=np.int64)
    e = np.fromiter((emissions[w] for x in words for w in x), dtype=float, count=int(lengths.sum()))
    logit = np.clip(marginal_logits(e, lengths, start, t), -30, 30)
    p = 1 / (1 + np.exp(-logit))
    ends = np.cumsum(lengths)
    logits, marginals = np.split(logit, ends[:-1]), np.split(p, ends[:-1])
    rows = [(1.0, *_strongest(l), math.log1p(m.sum())) for l, m in zip(logits, marginals)]
    return np.array(rows, dtype=float).reshape(-1, 4), marginals


def _strongest(logits: np.ndarray, bound: float = 8.0) -> tuple[float, float]:
    best = np.clip(np.partition(logits, -2)[-2:] if len(logits) > 1 else logits, -bound, bound).tolist()
    best = [-bound] * (2 - len(best)) + best
    return best[1], best[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a small weighted logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)) * weight.sum()
        beta -= np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * weight.sum() * beta)
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, label_id: str, held_out,
                 per_class: int = DOCS_PER_CLASS) -> tuple:
    """(weights, start, transitions, document coefficients) as plain values.

    Fitted on at most ``per_class`` labelled documents of each class outside ``held_out``, of any
    length, in the order of a hash of the id until they have ``FIT_CHARS`` characters. The class
    shares of all labelled documents weigh the document regression, so that scores are probabilities.
    """
    known = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    usable = docs.select(F.col(id).alias("_doc"), F.length(F.col(text)).alias("_n"), held_out.alias("_held"))
    usable = usable.where("_n is not null and not coalesce(_held, false)").groupBy("_doc").agg(F.sum("_n").alias("_n"))
    known = known.join(usable, known._id == usable._doc).select("_id", "_y", "_n")
    shares = dict.fromkeys((0, 1), 0) | {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    known = known.withColumn("_h", F.xxhash64("_id", F.lit(10)))
    picks = [known.where(F.col("_y") == k).orderBy("_h", "_id").limit(per_class) for k in (0, 1)]
    before = Window.partitionBy("_y").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)  # of bounded groups
    chosen = picks[0].unionByName(picks[1]).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chosen = F.broadcast(chosen.where(F.col("_before") < FIT_CHARS).select("_id", "_y"))
    own = docs.select(F.col(id).alias("_doc"), F.col(text).alias("_t"))  # no other column can clash
    rows = own.join(chosen, F.col("_doc") == F.col("_id")).where("_t is not null")
    rows = sorted(rows.select("_id", "_y", "_t").distinct().collect())
    texts, toxic = [r._t for r in rows], [r._y for r in rows]
    tags = labelled_tokens(texts, toxic)
    known_slots: dict[str, list[int]] = {}
    sentences, marks = [], []
    for text_, tag in zip(texts, tags):
        words = text_.lower().split()
        found = [known_slots.get(w) or known_slots.setdefault(w, slots(w)) for w in words]
        for i in range(0, len(found), SEGMENT):
            sentences.append(found[i:i + SEGMENT])
            marks.append(tag[i:i + SEGMENT])
    weights, start, t = fit_field(sentences, marks)
    if min(shares.values()):
        x, _ = document_parts(texts, Emissions(weights), start, t)
        y = np.array(toxic, dtype=float)
        counts = np.bincount(toxic, minlength=2)
        beta = fit_logistic(x, y, np.array([shares[k] / counts[k] for k in toxic]) / sum(shares.values()) * len(y))
    else:  # one class or none: the known share for every text
        p = min(max(shares[1] / max(1, sum(shares.values())), 1e-3), 1 - 1e-3)
        beta = np.array([math.log(p / (1 - p)), 0.0, 0.0, 0.0])
    return weights.astype(np.float32), start, t, beta


def spans_of(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets (start, end) of runs of words whose marginal is over one half."""
    out: list[list[int]] = []
    if not (marginals > 0.5).any():
        return []
    joined = False
    for m, p in zip(TOKEN.finditer(text), marginals):
        if p > 0.5:
            if joined:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
        joined = p > 0.5
    return [tuple(x) for x in out]


def toxicity_column(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, label_id: str, held_out):
    """Column of struct (score, spans) for the rows of ``docs``; fits the model now."""
    model = fit_toxicity(docs, labels, id=id, text=text, label=label, label_id=label_id, held_out=held_out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, start, t, beta = sent.value
        emissions = Emissions(weights.astype(float))
        for series in batches:
            scores, spans = [], []
            for part in _portions(["" if x is None else x for x in series]):
                x, marginals = document_parts(part, emissions, start, t)
                scores.append(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))
                spans += [[{"start": a, "end": b} for a, b in spans_of(*z)] for z in zip(part, marginals)]
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else [], "spans": spans})

    return F.pandas_udf(score, "score double, spans array<struct<start: int, end: int>>")(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
                   label_id: str = "doc_id", held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id``, held_out, score, predicted, spans.

    Labels of ``held_out`` rows are never read. Null, empty and blank texts have no words and get
    the score of a text without toxic words. Without labels of both classes every text gets the
    share of label 1 (held within 0.001 and 0.999). Repeated rows are kept, an empty table gives
    an empty result, extra columns are ignored.
    """
    held = remainder(F.col(id), 4) == 2 if held_out is None else held_out
    judged = toxicity_column(docs, labels, id=id, text=text, label=label, label_id=label_id, held_out=held)
    rows = docs.select(F.col(id).alias(id), F.coalesce(held, F.lit(False)).alias("held_out"), judged.alias("_s"))
    return rows.select(id, "held_out", "_s.score", (F.col("_s.score") >= threshold).cast("int").alias("predicted"), "_s.spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
               label_id: str = "doc_id", held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` as they are, without those that score ``threshold`` or more."""
    held = remainder(F.col(id), 4) == 2 if held_out is None else held_out
    judged = toxicity_column(docs, labels, id=id, text=text, label=label, label_id=label_id, held_out=held)
    return docs.where(judged["score"] < threshold)


def _portions(texts: list[str], chars: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, to bound memory; every text is in one run."""
    part, n = [], 0
    for text in texts:
        if part and n + len(text) > chars:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text)
    if part:
        yield part
