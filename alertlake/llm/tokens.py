"""Token ids of documents as bit-packed files, written and read by Spark.

File format (version 1). A store is a folder of Parquet files with one row per block:

* ``shard``: number of the range part that wrote the block; shards are in order of the document id;
* ``first``: ids of the shard before this block (the block offset);
* ``n_ids``: ids in the block;
* ``docs``: (id, n) of the block's documents in order; a document is never cut, so a block ends
  with the first document that brings it to ``BLOCK_IDS`` or more;
* ``payload``: the ids, each in ``width`` bits, least significant bit first, without gaps; the last
  byte is filled with zeros.

Beside it, in the folder ``<store>-shards``, is one row per shard: ``shard``, ``width``, ``n_ids`` and
``start``, the ids of all shards before it. ``start + first`` plus the lengths of the documents before
it in its block is where a document begins, so any range of ids is found without reading others.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.session import scratch_path

BLOCK_IDS = 1 << 16
MEMO_WORDS = 800_000

# Words of byte-level tokenizers whose pattern is applied as given in public_tokenizers.PATTERN, over
# characters that every version of the pattern's classes treats alike; other texts are left whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}¡«»¿‘’“”–—…€]")


def id_width(vocabulary: int) -> int:
    """Least number of bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, least significant first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n - 1`` of a payload, reading only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{width // 8}", count=n, offset=first * width // 8).astype(np.uint32)
    begin, end = first * width // 8, -(-(first + n) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, count=end - begin, offset=begin), bitorder="little")
    bits = bits[first * width - begin * 8:][: n * width].reshape(n, width).astype(np.uint32)
    return bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class Encoder:
    """Ids of a text as the tokenizers library gives them, as bytes of ``dtype``.

    Byte-level BPE treats the words of a text one by one. For such a tokenizer the library is asked
    for each word once and remembered (at most ``MEMO_WORDS``, then forgotten); texts with unusual
    characters, and all texts of other tokenizers, are handed to the library whole. Strings of special
    tokens inside a text are ordinary text.
    """

    _kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.width = id_width(self.library.get_vocab_size())
        self.dtype = np.dtype("<u2") if self.width <= 16 else np.dtype("<u4")
        parts = json.loads(self.library.to_str())
        before = parts["pre_tokenizer"] or {}
        self.by_word = (
            parts["normalizer"] is None and parts["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space"))
        self.model, self.memo = self.library.model, {}
        usual = [c for c in map(chr, range(0x2100)) if not UNUSUAL.search(c)]
        self.bytes_of = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in usual}) if self.by_word else {}
        self.code = "H" if self.width <= 16 else "I"

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per worker process; its memory of words outlives a task."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _word(self, word: str) -> bytes:
        ids = array(self.code, [token.id for token in self.model.tokenize(word.translate(self.bytes_of))])
        if sys.byteorder == "big":
            ids.byteswap()
        found = ids.tobytes()
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_word or UNUSUAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        known, new = self.memo.get, self._word
        return b"".join([known(word) or new(word) for word in WORDS.findall(text)])


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text",
                 block_ids: int = BLOCK_IDS) -> str:
    """Writes the ids of all whole texts, each followed by ``end_id``, in ascending order of ``id``.

    ``tokenizer`` is a path on every machine. Texts are range-partitioned by ``id`` and encoded where they
    arrive; a task holds one batch of texts and one block. Null and empty texts have the end id only. Null
    ids come first. Rows with the same id are documents of their own, in an order that depends on their
    texts; equal rows are dealt to several parts if there are many. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    tie = [F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")]
    order = ["id", "tie", "row"]
    ranged = rows.select("*", *tie).repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, first = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        ids, docs_of, held = [], [], 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(ids), dtype=encoder.dtype), encoder.width)
            docs_type = pa.list_(pa.struct([("id", kind), ("n", pa.int64())]))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                pa.array([docs_of], docs_type), pa.array([payload], pa.binary())],
                ["shard", "first", "n_ids", "docs", "payload"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                ids.append(encoder.encode(content) + end if content else end)
                n = len(ids[-1]) // encoder.dtype.itemsize
                docs_of.append({"id": key, "n": n})
                held += n
                if held >= block_ids:
                    yield block(kind)
                    first, held, ids, docs_of = first + held, 0, [], []
        if held:
            yield block(kind)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"shard int, first long, n_ids long, docs array<struct<id:{kind},n:long>>, payload binary"
    ranged.select("id", "text").mapInArrow(blocks, schema).write.parquet(path)
    width = Encoder.of(tokenizer).width
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per range part.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).withColumn(
        "width", F.lit(width)).coalesce(1).write.parquet(f"{path}-shards")
    return path


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the position of their first id among all ids, and ``width``."""
    # One small row per range part that wrote the store.
    shards = F.broadcast(spark.read.parquet(f"{path}-shards").select("shard", F.col("start").alias("before"), "width"))
    blocks = spark.read.parquet(path).join(shards, "shard")
    return blocks.withColumn("start", F.col("before") + F.col("first")).drop("before", "first", "shard")


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(id, start, ids) of every document of some blocks; each block is unpacked in one go."""
    for start, n, docs, payload, width in _columns(batch, "start", "n_ids", "docs", "payload", "width"):
        ids, at = unpack(payload, width, 0, n), 0
        for doc in docs:
            yield doc["id"], start + at, ids[at: at + doc["n"]]
            at += doc["n"]


def _id_type(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field("docs").type.value_type.field("id").type


def _id_kind(blocks: DataFrame) -> str:
    return blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of every document of a store."""
    blocks = _placed(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_documents(batch))
            yield pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in found], _id_type(batch)), pa.array([d[1] for d in found], pa.int64()),
                pa.array([d[2].astype(np.int64) for d in found], pa.list_(pa.int64()))], ["id", "start", "ids"])

    return blocks.mapInArrow(read, f"id {_id_kind(blocks)}, start long, ids array<long>")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids): the ids at positions ``first`` to ``last - 1`` of all, in pieces; other blocks are not unpacked."""
    blocks = _placed(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, pieces = [], []
            for start, n, payload, width in _columns(batch, "start", "n_ids", "payload", "width"):
                begin, end = max(first - start, 0), min(last - start, n)
                starts.append(start + begin)
                pieces.append(unpack(payload, width, begin, end - begin).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(pieces, pa.list_(pa.int64()))], ["start", "ids"])

    return blocks.select("start", "n_ids", "payload", "width").mapInArrow(read, "start long, ids array<long>")


def token_checksums(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """``id``, start, n_tokens and ids_crc32 (crc32 of the ids as little-endian 32-bit integers) of a store's documents."""
    blocks = _placed(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, b, len(c), zlib.crc32(c.astype("<u4").tobytes())) for a, b, c in _documents(batch)]
            keys, *numbers = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, _id_type(batch)), *[pa.array(x, pa.int64()) for x in numbers]],
                ["id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(
        read, f"id {_id_kind(blocks)}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id)


def store_tokens(docs: DataFrame, *, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a new store in the shared folder and returns the checksums read back from it.

    One row per row of ``docs``: see :func:`write_tokens` for nulls, empty texts and repeated ids. An empty
    table gives a store without blocks and no rows.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer=tokenizer, end_id=end_id, id=id, text=text)
    return token_checksums(docs.sparkSession, path, id)
