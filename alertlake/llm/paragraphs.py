"""Substring dedup by MinHash banding of paragraphs, exact Jaccard, and components."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm import blocks
from alertlake.llm.common import SPACES, materialize, release, raw
from alertlake.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 5, 2         # a pair at the threshold collides with probability 1 - (1 - 0.8 ** 2) ** 5 = 0.994
RUN_WORDS = 25             # repeated units inside paragraphs go if they stand together for so many words
BUCKET = 500               # paragraphs of a band up to which every pair is verified

IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
IS_STOP = np.isin(np.arange(256), list(b".!?,;:"))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LONG = 20                  # words from which a unit without punctuation is cut further
SEEDS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
M = np.uint64(0xD6E8FEB86659FD93)
WHOLE = np.uint64(0xA0761D6478BD642F)  # keeps hashes of paragraphs and of units apart


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M
    x = (x ^ (x >> np.uint64(32))) * M
    return x ^ (x >> np.uint64(32))


FACTORS = _mix(SEEDS) | np.uint64(1)


class Parts:
    """Stretches of words of some texts, with their words hashed.

    ``doc`` is the number of the text, ``start`` and ``end`` are bytes in it (to the next word),
    ``words`` the word count, ``name`` a hash of all words; ``shingles`` are hashes, ``counts`` of
    each. A part of fewer than ``SHINGLE`` words has one shingle, of all its words.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, word: np.ndarray, h: np.ndarray, following: np.ndarray,
                 begins: np.ndarray, sizes: np.ndarray, salt: np.uint64 = np.uint64(0)):
        """Words ``first`` up to ``last``; ``h`` are the shingles from each word on, ``following`` the places of words and of the end."""
        self.words, self.counts = last - first, np.maximum(last - first - (SHINGLE - 1), 1)
        self.doc = np.searchsorted(begins, following[first], side="right") - 1
        self.start = following[first] - begins[self.doc]
        self.end = np.minimum(following[last] - begins[self.doc], sizes[self.doc] - 1)
        self.name, self.shingles = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if not len(first):
            return
        inside = np.repeat(first, self.words) + _counting(self.words)
        self.name = _mix(np.add.reduceat(word[inside] * _powers(int(self.words.max()))[_counting(self.words)], np.cumsum(self.words) - self.words) ^ salt)
        self.shingles = _mix(h[np.repeat(first, self.counts) + _counting(self.counts)] ^ salt)
        few = self.words < SHINGLE
        self.shingles[(np.cumsum(self.counts) - self.counts)[few]] = self.name[few]


class Units(Parts):
    """The units of comparison of some texts, and in ``paragraphs`` their whole paragraphs.

    A paragraph is a line, or neighbouring lines (without an empty one between) that have fewer
    than ``SHINGLE`` words each; all words are in one. Units are smaller.

    A unit ends at a line break or at punctuation, but takes further parts of its line until it
    has ``SHINGLE`` words; a shorter rest of a line joins what is before it. Neighbouring lines
    of fewer words (verse, lists, text without spaces) are taken together like one line that may
    be cut behind some of its line breaks, picked by hash. A unit of ``LONG`` words or more is cut
    behind words picked by their hash, so that equal stretches are cut alike. Small units find a
    passage inside other text, and one word changed in a copy costs one unit only. Short lines
    that have fewer than ``SHINGLE`` words in all, between longer ones, are in no unit.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        space = IS_SPACE[data]
        edge = np.diff(np.concatenate([[1], space, [1]]).astype(np.int8))
        at, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(data)]])))
        if not len(at):
            none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            super().__init__(none, none, hashes, hashes, none, begins, sizes)
            self.paragraphs = Parts(none, none, hashes, hashes, none, begins, sizes)
            return
        term = (data.astype(np.uint64) + np.uint64(1)) * _powers(int((stop - at).max()) + 1).take(place, mode="clip")
        term[space] = 0
        word = _mix(np.add.reduceat(term, at) + (stop - at).astype(np.uint64))
        line = np.cumsum(data == 10)[at]
        ends = np.concatenate([line[1:] != line[:-1], [True]])
        joined = self._joined(ends, np.searchsorted(begins, at, side="right"))
        final = ends & ~joined
        stops = final | IS_STOP[data[stop - 1]] | (ends & ((word & np.uint64(4)) == 0))
        first, last = self._cut(final, stops, (word & np.uint64(3)) == 0)
        h, padded = word, np.concatenate([word, np.zeros(SHINGLE - 1, np.uint64)])
        for i in range(1, SHINGLE):
            h = _mix(h) + padded[i: len(word) + i]
        following = np.concatenate([at, [len(data)]])
        super().__init__(first, last, word, h, following, begins, sizes)
        past = np.nonzero(final | (joined & (np.diff(line, append=line[-1]) > 1)))[0] + 1
        self.paragraphs = Parts(np.concatenate([[0], past[:-1]]), past, word, h, following, begins, sizes, WHOLE)

    @staticmethod
    def _joined(ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Last words of short lines behind which another short line of the same text follows."""
        last = np.nonzero(ends)[0]
        small = np.diff(last, prepend=-1) < SHINGLE
        out = np.zeros(len(ends), bool)
        out[last[:-1]] = small[:-1] & small[1:] & (doc[last[:-1]] == doc[last[1:]])
        return out

    @staticmethod
    def _cut(line_end: np.ndarray, stop: np.ndarray, soft: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, past the last) word of each unit."""
        softs = (np.nonzero(soft)[0] + 1).tolist()
        first, last, begin, line = [], [], 0, 0  # units from ``line`` on are in this line
        for i, final in zip((np.nonzero(stop)[0] + 1).tolist(), line_end[stop].tolist()):
            if i - begin >= SHINGLE:
                if i - begin >= LONG:
                    low = bisect_left(softs, begin + SHINGLE)
                    for j in softs[low:bisect_left(softs, i - SHINGLE + 1, low)]:
                        if j - begin >= SHINGLE:
                            first.append(begin)
                            last.append(j)
                            begin = j
                first.append(begin)
                last.append(i)
                begin = i
            elif final:
                if len(last) > line:
                    last[-1] = i
                begin = i
            if final:
                line = len(last)
        return np.array(first, np.int64), np.array(last, np.int64)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … within each run."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, np.uint64(0x9E3779B97F4A7C15)))


def portions(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, Units]]:
    """(number of the first text, units) of runs of texts of about ``size`` bytes; every text is in one run."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size or i + 1 == len(texts):
            yield at, Units(texts[at:i + 1])
            at, n = i + 1, 0


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, one row per unit. Shingles are mixed already; an odd factor orders them anew for each seed."""
    starts = np.cumsum(counts) - counts
    if not len(counts):
        return np.zeros((0, len(SEEDS)), np.uint64)
    return np.stack([np.minimum.reduceat((shingles ^ s) * f, starts) for s, f in zip(SEEDS, FACTORS)], axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band and unit."""
    keys = []
    for b in range(BANDS):
        key = np.full(len(signature), np.uint64(b + 1))
        for r in range(ROWS):
            key = _mix(key * M + signature[:, b * ROWS + r])
        keys.append(key)
    return np.stack(keys, axis=1) if keys else np.zeros((0, 0), np.uint64)


def _sketch(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    numbers, keys, owners = pd.factorize(rows["id"])[0], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, units in portions(rows["data"].tolist()):
        for u in (units, units.paragraphs):
            keys.append(band_keys(signatures(u.shingles, u.counts)).ravel())
            owners.append(np.repeat(numbers[u.doc + at], BANDS))
    return np.concatenate(keys), np.concatenate(owners)


UNITS = "id long, th long, whole boolean, unit int, words int, start int, end int, uh long, shingles binary"


def _candidates(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Units and paragraphs of a block with a band key that another document has too.

    The shingles of equal parts are given once a block; the others have none.
    """
    rows, table, out, named = blocks.documents(rows), blocks.known(asked, "keys"), [], set()
    texts = rows["data"].tolist()
    for at, units in portions(texts) if len(table) else ():
        chars, begins = _characters(texts[at:at + units.texts])
        for u in (units, units.paragraphs):
            keys = blocks.short(band_keys(signatures(u.shingles, u.counts)).ravel())
            hit = np.nonzero(blocks.is_in(keys, table).reshape(-1, BANDS).any(axis=1))[0]
            if not len(hit):
                continue
            doc, names = u.doc[hit], u.name[hit].view(np.int64)
            first = np.zeros(len(hit), bool)
            first[np.unique(names, return_index=True)[1]] = True
            new = np.array([f and n not in named for f, n in zip(first.tolist(), names.tolist())], dtype=bool)
            named.update(names[new].tolist())
            shingles = np.full(len(hit), None, dtype=object)
            shingles[new] = _sets(u, hit[new])
            place = lambda x: (chars[begins[doc] + x[hit]] - chars[begins[doc]]).astype(np.int32)
            out.append(pd.DataFrame({
                "id": rows["id"].to_numpy()[doc + at], "th": rows["th"].to_numpy()[doc + at], "whole": u is not units,
                "unit": (hit - np.searchsorted(u.doc, doc)).astype(np.int32), "words": u.words[hit].astype(np.int32),
                "start": place(u.start), "end": place(u.end), "uh": names, "shingles": shingles}))
    columns = ["id", "th", "whole", "unit", "words", "start", "end", "uh", "shingles"]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=columns)


def _characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters up to each byte of all texts together: bytes that continue one do not count; where each text begins)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    return np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)]), np.cumsum(sizes) - sizes


def _sets(u: Parts, which: np.ndarray) -> list[bytes]:
    """The sorted distinct shingles of some parts."""
    n = u.counts[which]
    part = np.repeat(np.arange(len(which)), n)
    s = u.shingles[np.repeat((np.cumsum(u.counts) - u.counts)[which], n) + _counting(n)]
    order = np.lexsort((s, part))
    s, part = s[order], part[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])]) if len(s) else np.zeros(0, bool)
    data, ends = s[fresh].tobytes(), 8 * np.cumsum(np.bincount(part[fresh], minlength=len(which)))
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _signed(frame: pd.DataFrame) -> np.ndarray:
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    return signatures(np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], dtype=np.int64))


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, uh): one row per band of each distinct paragraph."""
    for frame in frames:
        yield pd.DataFrame({
            "key": band_keys(_signed(frame)).view(np.int64).ravel(), "uh": np.repeat(frame["uh"].to_numpy(np.int64), BANDS)})


def _sub_bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, uh): the key of a bucket with each value of the member's signature."""
    for frame in frames:
        sig = _signed(frame)
        place = np.arange(1, sig.shape[1] + 1, dtype=np.uint64)
        keys = _mix(_mix(frame["key"].to_numpy(np.int64).view(np.uint64)[:, None] + place) * M + sig)
        yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "uh": np.repeat(frame["uh"].to_numpy(np.int64), sig.shape[1])})


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact Jaccard of two sorted sets of shingles."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILAR * (len(a) + len(b) - common)


def spanning_links(names: list[int], sets: list[np.ndarray], roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of similar members that connect what all similar pairs connect; each pair not yet connected is verified.

    Members with the same of ``roots`` are connected from the start.
    """
    root = list(range(len(names)))
    if roots is not None:
        firsts: dict[int, int] = {}
        root = [firsts.setdefault(r, i) for i, r in enumerate(roots)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for j in range(1, len(names)):
        for i in range(j):
            a, b = find(i), find(j)
            if a != b and similar(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                out.append((names[i], names[j]))
    return out


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside buckets; rows arrive sorted by key."""
    held: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("key", sort=False):
            if len(g) > 1:
                known = g["root"].tolist() if "root" in g else None
                out += spanning_links(g["uh"].tolist(), [np.frombuffer(s, np.uint64) for s in g["shingles"]], known)
        return pd.DataFrame(out, columns=["a", "b"])

    for frame in frames:
        rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = rows["key"] == rows["key"].iloc[-1] if len(rows) else rows["key"] == 0
        held = rows[last]
        yield links(rows[~last])
    if held is not None:
        yield links(held)


def _in_buckets(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links between the members (key, uh[, root]) of each key."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism * 4
    return rows.join(texts, "uh").repartition(tasks, "key").sortWithinPartitions("key", "uh").mapInPandas(_verify, "a long, b long")


def _each_shingle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(uh, s, n): one row per shingle of each paragraph, which has n of them."""
    for frame in frames:
        sets = [np.frombuffer(s, np.int64) for s in frame["shingles"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        yield pd.DataFrame({
            "uh": np.repeat(frame["uh"].to_numpy(np.int64), sizes), "s": np.concatenate([np.zeros(0, np.int64), *sets]),
            "n": np.repeat(sizes, sizes)})


def joined_links(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) links that connect, beyond ``known`` links, whatever similar pairs of ``texts`` (uh, shingles) connect.

    Exact: two similar sets share one of their rarest shingles, of which a set of n has to show
    n - ceil(0.8 n) + 1. Members of a shingle that are all connected need no look. Else those
    outside the largest connected group of the shingle meet every member, in cells of about
    ``BUCKET`` members, so that no task holds a frequent shingle.
    """
    each = texts.mapInPandas(_each_shingle, "uh long, s long, n long")
    ranked = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "s")
    # a shingle of one member alone is rarer than all others and brings nobody together, but counts in the prefix
    rare = ranked.groupBy("uh").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("all"))
    room = F.floor(F.col("n") * (1 - SIMILAR) + 1e-6).cast("int") + 1 - (F.col("n").cast("int") - F.size("all"))
    rare = rare.withColumn("room", room).where("room > 0").select("uh", F.explode(F.expr("slice(all, 1, room).s")).alias("s"))
    roots = components(known, "a", "b")
    rare = rare.join(roots, rare.uh == roots.node, "left").select("s", "uh", F.coalesce("root", "uh").alias("root"))
    rare = materialize(rare, "rare")
    groups = rare.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("groups"))
    half = max(1, BUCKET // 2)
    part = lambda n: F.when(F.col("n") <= BUCKET, 1).otherwise(F.greatest(F.lit(1), F.ceil(n / half))).cast("int")
    rows = rare.join(groups.where("groups > 1"), "s").withColumns({
        "wide": part(F.col("n")), "deep": part(F.col("n") - F.col("most")), "light": F.col("root") != F.col("top")})
    at = lambda n, seed: F.pmod(F.xxhash64("uh", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = rows.withColumn("i", at("wide", 1)).withColumn("j", F.explode(upto("deep")))
    down = rows.where("light and wide > 1").withColumn("j", at("deep", 2)).withColumn("i", F.explode(upto("wide")))
    cells = across.unionByName(down).select(F.xxhash64("s", "i", "j").alias("key"), "uh", "root").distinct()
    return _in_buckets(cells, texts)


def class_links(classes: DataFrame) -> DataFrame:
    """(a, b) verified links between distinct paragraphs (uh, shingles) that share a band.

    Buckets of at most ``BUCKET`` members are verified pair by pair, without a pair of two that
    are connected already. Members of a larger bucket are dealt into sub-buckets, one for each
    value of their signature besides; in a sub-bucket that is still larger all members are
    verified against its least one. That connects most of a large group cheaply; what else is
    similar among the members of large buckets is found by an exact join (``joined_links``).
    """
    banded = materialize(classes.select("uh", "shingles").mapInPandas(_bands, "key long, uh long"), "bands")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uh").alias("hub")).where("n > 1")
    members = banded.join(sizes, "key")
    texts = classes.select("uh", "shingles")
    inside = materialize(_in_buckets(members.where(F.col("n") <= BUCKET).select("key", "uh"), texts).distinct(), "inside")
    large = materialize(members.where(F.col("n") > BUCKET).select("key", "uh").join(texts, "uh").select("key", "uh", "shingles"), "large")
    release(banded)
    if large.isEmpty():
        release(large)
        return inside
    more = large.mapInPandas(_sub_bands, "key long, uh long").distinct()
    more_sizes = more.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uh").alias("hub")).where("n > 1")
    again = more.join(more_sizes, "key")
    stars = again.where((F.col("n") > BUCKET) & (F.col("uh") != F.col("hub"))).select("uh", "hub").distinct()
    other = texts.select(F.col("uh").alias("hub"), F.col("shingles").alias("hub_shingles"))
    check = F.pandas_udf(
        lambda x, y: pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y)], dtype=bool), "boolean")
    near = stars.join(texts, "uh").join(other, "hub").where(check("shingles", "hub_shingles"))
    near = near.select(F.col("uh").alias("a"), F.col("hub").alias("b"))
    known = inside.unionByName(_in_buckets(again.where(F.col("n") <= BUCKET).select("key", "uh"), texts)).unionByName(near)
    known = materialize(known.distinct(), "known")
    release(inside)
    links = materialize(known.unionByName(joined_links(large.select("uh", "shingles").dropDuplicates(["uh"]), known)).distinct(), "links")
    release(large, known)
    return links


RUNS = "spans array<struct<start: int, end: int>>, keepers array<long>"


def removed_runs(units: list[dict], least: int) -> tuple[list[dict], list[int]]:
    """Character ranges of repeated paragraphs and of runs of repeated units, and the documents they are kept in.

    A whole paragraph goes whatever its length, a run if it has at least ``least`` words. A run
    goes on across one unit that is not repeated, such as one with a changed word; that one stays
    and does not count.
    """
    ranges, keepers, run = [], set(), []

    def take(found: list[dict]) -> None:
        ranges.extend((u["start"], u["end"]) for u in found)
        keepers.update(u["keeper"] for u in found)

    def close() -> None:
        if sum(u["words"] for u in run) >= least:
            take(run)

    take([u for u in units if u["whole"]])
    for u in sorted((u for u in units if not u["whole"]), key=lambda u: u["unit"]):
        if run and u["unit"] > run[-1]["unit"] + 2:
            close()
            run = []
        run.append(u)
    close()
    spans: list[dict] = []
    for start, end in sorted(ranges):
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"start": start, "end": end})
    return spans, sorted(keepers)


def repeated_passages(docs: DataFrame, id: str, text: str, run_words: int, block_bytes: int) -> DataFrame:
    """(id, th, spans, keepers) of texts that lose a passage."""
    dealt, total = blocks.deal(docs, id, text, block_bytes)
    shared = blocks.repeated_keys(dealt, _sketch, total * BANDS / 50)
    found = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_candidates, UNITS)
    units = materialize(found, "units")
    classes = materialize(units.groupBy("uh").agg(F.first("shingles", ignorenulls=True).alias("shingles"), F.min("id").alias("first")), "classes")
    occurrences = materialize(units.drop("shingles"), "occurrences")
    release(units)
    links = class_links(classes)
    roots = components(links, "a", "b")
    release(links)
    rooted = classes.select("uh", "first").join(roots, classes.uh == roots.node, "left").select(
        "uh", "first", F.coalesce("root", "uh").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("first").alias("keeper")).join(rooted, "root").select("uh", "keeper")
    late = occurrences.join(keepers, "uh").where("keeper < id")
    names = ("whole", "unit", "words", "start", "end", "keeper")
    per = late.groupBy("id", "th").agg(F.collect_list(F.struct(*names)).alias("units"))

    def runs(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:  # number arrays, which take far less room than a batch of structs
            yield pd.DataFrame([
                removed_runs([dict(zip(names, u)) for u in zip(*[x.tolist() for x in row])], run_words)
                for row in zip(*columns)], columns=["spans", "keepers"])

    found = F.pandas_udf(runs, RUNS)(*[F.col("units").getField(n) for n in names])
    judged = per.select("id", "th", found.alias("r")).select("id", "th", "r.spans", "r.keepers")
    passages = materialize(judged.where("size(spans) > 0"), "passages")
    release(occurrences, classes)
    return passages


def cut_spans(text: str, spans) -> str:
    """``text`` without the given character ranges."""
    out, at = [], 0
    for s in spans:
        out.append(text[at:s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def _with_spans(docs: DataFrame, passages: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` with _key, _hash and the ranges to remove (null: none) in _spans."""
    rows = docs.withColumns({
        "_key": F.coalesce(F.col(id).cast("long"), F.lit(blocks.LAST)), "_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    found = passages.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    return rows.join(found, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_th")), "left").drop("_id", "_th")


def remove_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS,
                    block_bytes: int = blocks.BLOCK_BYTES, size: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``; a text of which nothing is left goes.

    A column ``size`` is set to the characters of a text that was cut. Rows without a repeated
    passage stay as they are, empty ones too.
    """
    passages = repeated_passages(docs, id, text, run_words, block_bytes)
    cut = F.pandas_udf(lambda t, s: pd.Series([x if y is None else cut_spans(x, y) for x, y in zip(t, s)], dtype=object), "string")
    own, whole = docs.select(F.struct("*").alias("_row")), F.col(f"_row.`{text}`")  # no column of the caller's can clash
    rows = _with_spans(own, passages, f"_row.`{id}`", f"_row.`{text}`")
    rows = rows.withColumn("_left", F.when(F.col("_spans").isNotNull(), cut(whole, F.col("_spans"))).otherwise(whole))
    rows = rows.where(F.col("_spans").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.col("_left")}
    if size:
        changed[size] = F.when(F.col("_spans").isNotNull(), F.length("_left").cast("long")).otherwise(F.col("_row")[size])
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def dedup_substrings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS,
                     block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``id``, component_id, n_words, n_removed, spans, kept_sha256, kept_text.

    Paragraphs (lines) of different documents are alike if the Jaccard of their five-word shingles
    is 0.8 or more, those of fewer words if they are equal; so are the smaller units that lines are
    cut into. Alike ones form components, and all occurrences but those in the smallest id are
    repeated. Repeated paragraphs are removed, and so are runs of repeated units of ``run_words``
    words or more inside others: spans (start, end in characters), n_removed (words). component_id
    is the least id that a document is connected with through what is removed from either, thus
    through all repeated paragraphs.

    Null texts give null kept_text; null, empty and blank texts lose nothing. A null id is larger
    than every other. Paragraphs that repeat within one document stay. Rows that agree in id and
    text are one document, with equal results; extra columns are ignored; an empty table gives an
    empty result.
    """
    passages = repeated_passages(docs, id, text, run_words, block_bytes)
    linked = components(passages.select("id", F.explode("keepers").alias("other")), "id", "other")
    rows = _with_spans(docs.select(F.col(id).alias(id), F.col(text).alias("_text")), passages, id, "_text")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans):
                n = len(raw(t).split())
                left = t if t is None or s is None else cut_spans(t, s)
                out.append((n, n - len(raw(left).split()) if left is not t else 0, left, hashlib.sha256(raw(left)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "kept_sha256"])

    done = F.pandas_udf(cut, "n_words long, n_removed long, kept_text string, kept_sha256 string")
    rows = rows.select(id, "_key", "_spans", done("_text", "_spans").alias("_r"))
    rows = rows.join(linked, F.col("_key") == F.col("node"), "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    return rows.select(
        id, F.coalesce("root", F.col(id).cast("long")).alias("component_id"), "_r.n_words", "_r.n_removed",
        F.coalesce("_spans", none).alias("spans"), "_r.kept_sha256", "_r.kept_text")
