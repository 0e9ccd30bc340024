"""Removal of byte passages that stand in an earlier document: enhanced suffix arrays over
content-anchored contexts, scanned for maximal repeats.

A passage of ``LENGTH`` bytes holds an anchor: the ``GRAM`` bytes with the least hash in it. Only
anchors that occur in two documents matter, and around each the ``LENGTH``-byte strings through it
lie inside one context of ``2 * LENGTH - GRAM`` bytes. Equal contexts are settled by their least
document. Different contexts that agree around the anchor and on one side of it are indexed
together by a suffix array with common prefixes, and a stack scan of its intervals gives the
maximal repeats with all occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm import blocks
from alertlake.llm.common import materialize, release, raw

LENGTH, GRAM = 50, 24
BEFORE = LENGTH - GRAM          # bytes of a context before its anchor
WIDE = BEFORE + LENGTH          # bytes of a context
STEP = 1 << 20                  # bytes of a text worked on at a time
MIDDLE = BEFORE // 2
CHUNK = 8192                    # anchors whose contexts are built at a time
HOT = 16000                     # contexts of an anchor up to which they are indexed together

UPPER = ~np.uint64(0xFFFF)      # of a second hash 48 bits travel
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of every run of ``GRAM`` (three times eight) bytes."""
    w = data.astype(np.uint64)
    for n in (1, 2, 4):
        w = w[:-n] | (w[n:] << np.uint64(8 * n))
    return _mix(_mix(_mix(w[:-16] * M2) + w[8:-8]) * M3 + w[16:])


def _extreme(pick, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` elements."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are the least in some ``LENGTH``-byte string of the text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes, span = [], [], BEFORE + 1
    for s in range(0, len(data) - LENGTH + 1, STEP):
        h = _grams(data[s:s + STEP + LENGTH - 1])
        least = _extreme(np.minimum, h, span)
        padded = np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)])
        at = np.nonzero(_extreme(np.maximum, padded, span) == h)[0]
        places.append(at + s)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return at, h


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes around each anchor, zero beyond the text; bytes there are before it; from it on)."""
    before, after = np.minimum(at, BEFORE), np.minimum(len(data) - at, LENGTH)
    low, high = max(0, int(at.min()) - BEFORE), min(len(data), int(at.max()) + LENGTH)
    padded = np.zeros(int(at.max() - at.min()) + WIDE, np.uint8)
    padded[low - int(at.min()) + BEFORE:high - int(at.min()) + BEFORE] = data[low:high]
    return np.lib.stride_tricks.sliding_window_view(padded, WIDE)[at - at.min()], before, after


def _bytes_key(rows: np.ndarray, seed) -> np.ndarray:
    """Hash of the bytes of each row."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, :rows.shape[1]] = rows
    key = np.broadcast_to(seed, len(rows))
    for column in padded.view("<u8").T:
        key = _mix((key ^ column) * M2 + M1)
    return key


def context_keys(wide: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _bytes_key(wide, _mix((before * 64 + after).astype(np.uint64) + M3))


# --- suffix array ------------------------------------------------------------

def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, text numbers, offsets) of every maximal repeat of at least ``least`` bytes, with all occurrences.

    Suffixes of at least ``least`` bytes are sorted, neighbours compared, and the common-prefix
    intervals found with a stack. An interval is a maximal repeat if the bytes left of its
    occurrences differ (a text's start differs from everything).
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(sizes - least + 1, 0)
    which = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(which) < 2:
        return
    longest = int(sizes.max())
    width = -(-longest // 8) * 8
    flat = np.zeros(int(sizes.sum()) + width, np.uint8)
    flat[: int(sizes.sum())] = np.frombuffer(b"".join(texts), np.uint8)
    start = (np.cumsum(sizes) - sizes)[which] + offset
    rest = sizes[which] - offset
    rows = flat[start[:, None] + np.arange(width)[None, :]]
    rows[np.arange(width)[None, :] >= rest[:, None]] = 0
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((rest, *words.T[::-1]))
    rows, which, offset, rest, start = rows[order], which[order], offset[order], rest[order], start[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(same, np.minimum(rest[1:], rest[:-1]))
    left = np.where(offset > 0, flat[start - 1].astype(np.int64), -1 - np.arange(len(start)))
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])  # left bytes differ inside [i, j] if this does
    stack: list[tuple[int, int]] = []  # (depth, first suffix) of open intervals
    depths = common.tolist() + [0]
    for i, depth in enumerate(depths):
        begin = i
        while stack and stack[-1][0] > depth:
            deep, begin = stack.pop()
            if change[i] != change[begin]:
                yield deep, which[begin:i + 1], offset[begin:i + 1]
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def covered(texts: list[bytes], owners: np.ndarray, least: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the ranges of repeats that an owner smaller than its own has as well."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for length, which, offset in maximal_repeats(texts, least):
        own = owners[which]
        for i in np.nonzero(own > own.min())[0]:
            found[which[i]].append((int(offset[i]), int(offset[i]) + length))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges as disjoint maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


# --- stages ------------------------------------------------------------------

def _sketch(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes of a block; an owner is a document."""
    numbers = pd.factorize(rows["id"])[0]
    found = [(anchors(np.frombuffer(t, np.uint8))[1], n) for t, n in zip(rows["data"], numbers)]
    return np.concatenate([h for h, _ in found]), np.concatenate([np.full(len(h), n) for h, n in found])


def _candidates(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that hold anchors found in two documents, packed, with those anchors."""
    table, out, places = blocks.known(asked, "keys"), [], []
    for row in blocks.documents(rows).itertuples(index=False) if len(table) else ():
        at, h = anchors(np.frombuffer(row.data, np.uint8))
        hit = blocks.is_in(blocks.short(h), table)
        if hit.any():
            out.append(row)
            places.append(at[hit])
    if not out:
        return pd.DataFrame([], columns=["block", "docs", "n", "at"])
    n = np.array([len(a) for a in places], np.int64)
    return pd.DataFrame([(
        key[0], blocks.pack(*map(list, zip(*out))), blocks.pack_ints(n), blocks.pack_keys(np.concatenate(places).astype(np.uint64)),
    )], columns=["block", "docs", "n", "at"])


CANDIDATES = "block int, docs binary, n binary, at binary"


class _Anchors:
    """All candidate anchors of a block: their document, place, context and keys; (k, h) names a context."""

    def __init__(self, rows: pd.DataFrame):
        self.names, doc, parts = [], [], []
        for row in rows.itertuples(index=False):
            places, end = blocks.unpack_keys(row.at).astype(np.int64), 0
            for n, (id, th, text) in zip(blocks.unpack_ints(row.n).tolist(), blocks.unpack(row.docs)):
                data, end = np.frombuffer(text, np.uint8), end + n
                doc.append(np.full(n, len(self.names)))
                self.names.append((id, th))
                for s in range(end - n, end, CHUNK):
                    at = places[s:min(end, s + CHUNK)]
                    parts.append((at, *contexts(data, at)))
        self.at, self.wide, self.before, self.after = (np.concatenate(x) for x in zip(*parts))
        self.doc = np.concatenate(doc)
        self.id = np.array([id for id, _ in self.names], np.int64)[self.doc]
        self.k = context_keys(self.wide, self.before, self.after)
        self.h = _bytes_key(self.wide, _mix((self.after * 64 + self.before).astype(np.uint64) + M1)) & UPPER
        # Strings that begin MIDDLE or more bytes before the anchor share the left side, others the right side.
        self.left = np.where(self.before >= MIDDLE, _bytes_key(self.wide[:, BEFORE - MIDDLE:LENGTH], M2), np.uint64(0))
        self.right = np.where(self.after >= LENGTH - MIDDLE, _bytes_key(self.wide[:, BEFORE:WIDE - MIDDLE], M3), np.uint64(0))

    def side(self, i: int, left: bool) -> tuple[int, bytes]:
        """(place, bytes) of the part of a context that holds the strings of one side."""
        before = int(self.before[i]) if left else min(int(self.before[i]), MIDDLE)
        after = min(int(self.after[i]), LENGTH - MIDDLE) if left else int(self.after[i])
        return int(self.at[i]) - before, self.wide[i, BEFORE - before:BEFORE + after].tobytes()


def _least_documents(candidates: DataFrame, total: int, hot: int) -> DataFrame:
    """(block, kind, key, other, value): for each context (k, h) of a block the least document that has it (kind 1).

    For each side (kind 0) that several contexts have, the value is 1, or 2 if they are more than
    ``hot``; a block has one entry per side and one per context (kind 1), and a part holds a hash
    range of them. A block is one row of ``candidates``, so they are read where they lie.
    """
    parts = blocks.parts_for(total / 40)

    def entries(block: int, kind: int, key: np.ndarray, other: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Rows for the parts, cut by the sorted ``key``."""
        b, n = blocks.cut(key, parts), n.astype(np.int64)
        return [
            (p, kind, block, blocks.pack_keys(key[x]), blocks.pack_ints(other[x]), blocks.pack_ints(n[x]))
            for p, x in ((p, slice(b[p], b[p + 1])) for p in range(parts)) if x.start < x.stop]

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in ((int(f["block"].iloc[i]), f.iloc[i:i + 1]) for f in frames for i in range(len(f))):
            a = _Anchors(rows)
            order = np.lexsort((a.id, a.h, a.k))
            h, k, ids = a.h[order], a.k[order], a.id[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            out = entries(block, 1, k[first], h[first], ids[first])
            g, k = np.concatenate([a.left, a.right])[np.tile(order[first], 2) + np.repeat([0, len(order)], first.sum())], np.tile(k[first], 2)
            order = np.lexsort((k, g))[np.count_nonzero(g == 0):]
            g, k = g[order], k[order]
            if len(g):
                at = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
                out += entries(block, 0, g[at], k[at] & UPPER, np.diff(np.append(at, len(g))))
            yield pd.DataFrame(out, columns=["part", "kind", "block", "key", "other", "n"])

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = [blocks.unpack_keys(x) for x in frame["key"]]
        others = [blocks.unpack_ints(x).view(np.uint64) for x in frame["other"]]
        n = np.concatenate([blocks.unpack_ints(x) for x in frame["n"]])
        ends, all_keys, all_others = np.cumsum([len(x) for x in keys])[:-1], np.concatenate(keys), np.concatenate(others)
        if key[1] == 0:  # per side: one context, several, or many
            _, group = np.unique(all_keys, return_inverse=True)
            low, high, many = np.full(group.max() + 1, ~np.uint64(0)), np.zeros(group.max() + 1, np.uint64), np.bincount(group, n)
            np.minimum.at(low, group, all_others)
            np.maximum.at(high, group, all_others)
            several = (low != high) | (np.bincount(group, n > 1) > 0)
            value = np.where(several, np.where(many > hot, 2, 1), 0)[group]
            give = value > 0
        else:            # per context: the least document
            pair = np.lexsort((all_others, all_keys))
            new = np.concatenate([[True], (all_keys[pair][1:] != all_keys[pair][:-1]) | (all_others[pair][1:] != all_others[pair][:-1])])
            group = np.empty(len(pair), np.int64)
            group[pair] = np.cumsum(new) - 1
            value = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(value, group, n)
            value = value[group]
            give = value < n  # a block only needs to hear of smaller documents than its own
        rows = [
            (b, key[1], blocks.pack_keys(x[g]), blocks.pack_ints(y[g]) if key[1] else b"", blocks.pack_ints(v[g].astype(np.int64)))
            for b, x, y, v, g in zip(frame["block"], keys, others, np.split(value, ends), np.split(give, ends)) if g.any()]
        return pd.DataFrame(rows, columns=["block", "kind", "key", "other", "value"])

    sent = candidates.mapInPandas(send, "part int, kind int, block int, key binary, other binary, n binary")
    return sent.groupBy("part", "kind").applyInPandas(answer, "block int, kind int, key binary, other binary, value binary")


class _Answers:
    """What a block was told: a value for a side, or for a context named by a pair of hashes."""

    def __init__(self, frame: pd.DataFrame, kind: int):
        rows, self.kind = frame[frame["kind"] == kind], kind
        keys = np.concatenate([np.zeros(0, np.uint64), *map(blocks.unpack_keys, rows["key"])])
        other = np.concatenate([np.zeros(0, np.int64), *map(blocks.unpack_ints, rows["other"] if kind else [])]).view(np.uint64)
        value = np.concatenate([np.zeros(0, np.int64), *map(blocks.unpack_ints, rows["value"])])
        mixed = self._mixed(keys, other)
        order = np.argsort(mixed)
        self.mixed, self.keys, self.other, self.value = mixed[order], keys[order], other[order] if kind else None, value[order]
        runs = np.diff(np.nonzero(np.concatenate([[True], self.mixed[1:] != self.mixed[:-1], [True]]))[0]) if len(mixed) else [0]
        self.longest = int(max(runs))  # entries with one mixed hash; more than 1 by chance only

    def _mixed(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        return _mix(other * M2) ^ keys if self.kind else keys

    def get(self, keys: np.ndarray, other: np.ndarray, default: int) -> np.ndarray:
        """Values by key (and, for a context, the other hash): found by a mixed hash, then compared in full."""
        asked, out = self._mixed(keys, other), np.full(len(keys), default, np.int64)
        if not len(self.mixed):
            return out
        first = np.searchsorted(self.mixed, asked)
        for step in range(self.longest):
            i = np.minimum(first + step, len(self.mixed) - 1)
            same = self.keys[i] == keys
            if self.kind:
                same &= self.other[i] == other
            out = np.where(same, self.value[i], out)
        return out


def _settle(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """For a block: removed ranges that whole contexts settle, and the sides still to be indexed.

    A context is open where this document is the least that has it; a side of it is indexed if
    other contexts have that side too. Of a hot side every string is sent by itself, to be
    settled by a minimum.
    """
    columns = ["id", "th", "kind", "spans", "h", "at", "text"]
    if not len(rows):
        return pd.DataFrame([], columns=columns)
    a, least, kinds, out = _Anchors(rows), _Answers(answers, 1), _Answers(answers, 0), []
    order = np.lexsort((a.id, a.h, a.k))
    new = np.concatenate([[True], (a.h[order][1:] != a.h[order][:-1]) | (a.k[order][1:] != a.k[order][:-1])])
    here = np.empty(len(order), np.int64)
    here[order] = a.id[order][new][np.cumsum(new) - 1]
    done = np.minimum(least.get(a.k, a.h, np.iinfo(np.int64).max), here) < a.id
    doc, start, end = a.doc[done], (a.at - a.before)[done], (a.at + a.after)[done]
    if len(doc):  # anchors stand in order, so ranges do
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
        last = np.concatenate([fresh[1:], [True]])
        doc, spans = doc[fresh], np.stack([start[fresh], end[last]], axis=1)
        cuts = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        for d, part in zip(doc[cuts], np.split(spans, cuts[1:])):
            out.append((*a.names[d], 0, part.tobytes(), 0, 0, b""))
    for left, group in ((True, a.left), (False, a.right)):
        kind = np.where(done | (group == 0), 0, kinds.get(group, a.h, 0))
        for i in np.nonzero(kind)[0]:
            name, (at, text) = a.names[a.doc[i]], a.side(i, left)
            if kind[i] == 1:
                out.append((*name, 1, b"", group[i].astype(np.int64), at, text))
            else:
                out += [(*name, 2, b"", 0, at + j, text[j:j + LENGTH]) for j in range(len(text) - LENGTH + 1)]
    return pd.DataFrame(out, columns=columns)


SETTLED = "id long, th long, kind int, spans binary, h long, at long, text binary"


def _index(frames: Iterator[pd.DataFrame], batch: int = 4000) -> Iterator[pd.DataFrame]:
    """Removed ranges of open contexts; rows arrive sorted by anchor, an anchor's rows stay together."""
    held: list[pd.DataFrame] = []

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.groupby("text")["id"].min()  # equal strings are settled by their least document
        texts = list(first.index)
        found = dict(zip(texts, zip(first, map(merged, covered(texts, first.to_numpy())))))
        out = []
        for r in rows.itertuples(index=False):
            least, spans = found[r.text]
            spans = [(0, len(r.text))] if least < r.id else spans
            if spans and len(r.text) >= LENGTH:
                out.append((r.id, r.th, np.array([(r.at + a, r.at + b) for a, b in spans], np.int64).tobytes()))
        return pd.DataFrame(out, columns=["id", "th", "spans"])

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < batch:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows["h"].iloc[-1]
        keep = rows["h"] == last
        if not keep.all():
            whole = rows[~keep]
            starts = np.nonzero(np.concatenate([[True], whole["h"].to_numpy()[1:] != whole["h"].to_numpy()[:-1]]))[0]
            bounds = [0]
            for s in starts[1:]:
                if s - bounds[-1] >= batch:
                    bounds.append(int(s))
            for a, b in zip(bounds, [*bounds[1:], len(whole)]):
                yield flush(whole.iloc[a:b])
        held = [rows[keep]]
    if held and sum(map(len, held)):
        yield flush(pd.concat(held, ignore_index=True))


def repeated_ranges(docs: DataFrame, id: str, text: str, hot: int = HOT, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(id, th, spans): packed byte ranges that also stand in a document with a smaller id; several rows per text."""
    dealt, total = blocks.deal(docs, id, text, block_bytes)
    shared = blocks.repeated_keys(dealt, _sketch, total / 13)
    found = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_candidates, CANDIDATES)
    candidates = materialize(found, "candidates")
    spread = max(1, total // blocks.BLOCK_BYTES + 1)
    # A table between the two steps, so that the hashes of all contexts are gone before the texts are shuffled again.
    answers = materialize(_least_documents(candidates, total, hot), "answers")
    by_block = candidates.repartition(int(spread), "block")
    settled = materialize(by_block.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_settle, SETTLED), "settled")
    release(candidates, answers)
    whole = settled.where("kind = 0").select("id", "th", "spans")
    open_ = settled.where("kind = 1").select("h", "id", "th", "at", "text")
    indexed = open_.repartition(int(spread), "h").sortWithinPartitions("h", "id", "at").mapInPandas(_index, "id long, th long, spans binary")
    # Strings of hot anchors: the least document of each, combined before the shuffle.
    strings = settled.where("kind = 2").select("id", "th", "at", F.sha2("text", 256).alias("s"))
    least = strings.groupBy("s").agg(F.min("id").alias("least"))
    late = strings.join(least, "s").where("least < id").select(
        "id", "th", F.struct("at", (F.col("at") + LENGTH).alias("end")).alias("span"))
    late = late.groupBy("id", "th").agg(F.collect_list("span").alias("list"))
    pack = F.pandas_udf(lambda s: s.map(lambda x: np.array([(v["at"], v["end"]) for v in x], np.int64).tobytes()), "binary")
    found = materialize(whole.unionByName(indexed).unionByName(late.select("id", "th", pack("list").alias("spans"))), "ranges")
    release(settled)
    return found


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", texts: bool = False, **limits: int) -> DataFrame:
    """One row per input row: ``id``, n_bytes, n_removed, n_spans, kept_sha256 (and kept with ``texts``).

    A byte goes if a ``LENGTH``-byte string over it also starts in a document with a smaller id,
    judged on the input as it is. Null texts are empty; texts under ``LENGTH`` bytes keep all. A
    null id is larger than every other. Rows that agree in id and text are one document and get
    equal results, as do different texts under one id, which never remove from each other. Extra
    columns are ignored, an empty table gives an empty result. Contexts count as equal when 112
    bits of hash agree; indexed contexts are compared byte by byte. ``limits`` (hot, block_bytes)
    change the grouping of the work, not the result.
    """
    found = repeated_ranges(docs, id, text, **limits)
    per = found.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("spans").alias("_spans"))
    rows = docs.select(
        F.col(id).alias(id), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumns(
        {"_key": F.coalesce(F.col(id).cast("long"), F.lit(blocks.LAST)), "_hash": F.xxhash64("_text")})
    joined = rows.join(per, (rows["_key"] == per["_id"]) & (rows["_hash"] == per["_th"]), "left")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for series, spans in batches:
            out = []
            for t, lists in zip(series, spans):
                data = raw(t)
                ranges = [] if lists is None else merged(
                    [tuple(x) for s in lists for x in np.frombuffer(s, np.int64).reshape(-1, 2).tolist()])
                at = [0, *[x for r in ranges for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])) if ranges else data
                out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = F.pandas_udf(cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rows = joined.select(id, done("_text", "_spans").alias("_r"))
    return rows.select(id, *[f"_r.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))])
