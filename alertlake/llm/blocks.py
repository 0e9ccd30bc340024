"""Blocks of documents, and key exchanges between them.

Long texts yield far more keys than rows can carry one by one. Documents are dealt into blocks of
bounded size by hash; a block sends each of its distinct keys once, as sorted packed arrays cut by
hash range, and gets back what was asked about them. A key held by many documents costs one entry
per block, so neither a hot key nor a large group of copies makes a task large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import raw, text_bytes

BLOCK_BYTES = 4 << 20
PART_KEYS = 1_000_000
KEY_BITS = 48
LAST = (1 << 63) - 1  # a null id sorts behind all others


def deal(docs: DataFrame, id: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """((block, docs) rows partitioned by block; total bytes of the texts).

    A row holds some documents of its block, packed and compressed, as texts are most of what
    is shuffled. ``th`` is a hash of the text: (id, th) names a document, and rows that agree in
    both are one. ``id`` becomes a long, null ids become ``LAST``.
    """
    total = text_bytes(docs, text)
    n = max(1, math.ceil(total / block_bytes))
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "th", F.lit(7)), F.lit(n)).cast("int"))

    def pack_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates(["id", "th"])
            yield pd.DataFrame([
                (int(block), pack(part["id"].tolist(), part["th"].tolist(), [raw(t) for t in part["text"]]))
                for block, part in frame.groupby("block")], columns=["block", "docs"])

    return rows.mapInPandas(pack_rows, "block int, docs binary").repartition(n, "block"), total


def pack(ids: list[int], ths: list[int], data: list[bytes]) -> bytes:
    numbers = np.array([ids, ths, [len(d) for d in data]], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(ids)).tobytes() + numbers.tobytes() + b"".join(data))


def unpack(packed: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(id, th, UTF-8 text) of the documents in a packed row."""
    plain = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    ids, ths, sizes = np.frombuffer(plain, np.int64, 3 * n, 8).reshape(3, n).tolist()
    at = 8 + 24 * n
    for id, th, size in zip(ids, ths, sizes):
        yield id, th, plain[at:at + size]
        at += size


def documents(frame: pd.DataFrame) -> pd.DataFrame:
    """The distinct documents (id, th, data) of packed rows, in order."""
    found = {(id, th): data for packed in frame["docs"] for id, th, data in unpack(packed)}
    return pd.DataFrame([(*k, found[k]) for k in sorted(found)], columns=["id", "th", "data"])


def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The packed rows of a partition by block; a partition holds a few blocks."""
    rows = list(frames)
    if rows:
        for block, part in pd.concat(rows, ignore_index=True).groupby("block", sort=True):
            yield int(block), part


def parts_for(keys: float) -> int:
    return max(1, math.ceil(keys / PART_KEYS))


def cut(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Bounds of the hash ranges in sorted unsigned ``keys`` of ``bits`` bits."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**bits / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys as differences (small if sorted), packed."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(packed).view(np.uint64), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """64-bit integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def short(keys: np.ndarray) -> np.ndarray:
    """The upper ``KEY_BITS`` of keys: what is exchanged to find repeated ones. A chance agreement only adds a candidate."""
    return keys >> np.uint64(64 - KEY_BITS)


def repeated_keys(blocks: DataFrame, sketch: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], expected: float) -> DataFrame:
    """(block, keys): for each block its (short) keys that belong to two or more owners anywhere.

    ``sketch`` gives (unsigned 64-bit keys, owner numbers) of the documents of one block; owners
    of different blocks are different. ``expected`` is about how many keys there are in all.
    """
    parts = parts_for(expected)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in blocks_of(frames):
            keys, owners = sketch(documents(rows))
            if not len(keys):
                continue
            keys = short(keys)
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            shared = np.concatenate([[False], (keys[1:] == keys[:-1]) & (owners[1:] != owners[:-1])])
            at = np.nonzero(first)[0]
            keys, shared = keys[at], np.logical_or.reduceat(shared, at)
            b = cut(keys, parts, KEY_BITS)
            yield pd.DataFrame([
                (p, block, pack_keys(keys[b[p]:b[p + 1]]), np.packbits(shared[b[p]:b[p + 1]]).tobytes())
                for p in range(parts) if b[p] < b[p + 1]], columns=["part", "block", "keys", "shared"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x) for x in frame["keys"]]
        shared = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(frame["shared"], keys)]
        inner = np.unique(np.concatenate([k[s.astype(bool)] for k, s in zip(keys, shared)]))
        merged = np.concatenate(keys)
        merged.sort()
        again = merged[1:][merged[1:] == merged[:-1]]
        asked = np.union1d(again, inner)
        rows = []
        for block, k in zip(frame["block"], keys):
            k = k[is_in(k, asked)]
            if len(k):
                rows.append((block, pack_keys(k)))
        return pd.DataFrame(rows, columns=["block", "keys"])

    sent = blocks.mapInPandas(send, "part int, block int, keys binary, shared binary")
    return sent.groupBy("part").applyInPandas(answer, "block int, keys binary")


def known(frame: pd.DataFrame, column: str) -> np.ndarray:
    """All short keys of an answer, sorted."""
    found = [unpack_keys(x) for x in frame[column]]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def is_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of ``keys`` in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(keys), dtype=bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
