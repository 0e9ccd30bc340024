"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import raw, remainder

LEVEL, CAREFUL_LEVEL = 6, 12
PIECE = 2048        # bytes compressed at a time, so that a text cannot become its own dictionary
DICT_BYTES = 256 << 10  # holds all training texts of a language that has a byte or so a character
DICT_DOCS = 200     # training documents per language at most; a documented bound
DICT_CHARS = 1000   # of each of them go into the dictionary, from a place in the whole text chosen by hash, so that no document fills it
MARGIN = 0.01       # relative lead below which the cheapest language is not trusted alone


def training_texts(docs: DataFrame, *, id: str, text: str, lang: str, held_out, per_lang: int = DICT_DOCS) -> dict[str, bytes]:
    """Pieces of at most ``per_lang`` documents per language, laid end to end.

    Documents are chosen by hash, and so is the place in each whole text that its ``DICT_CHARS`` characters
    come from; shorter texts are taken whole.

    Only documents with a language and a text outside ``held_out`` count. Within a language rows
    are first cut to a bounded number in each of 64 salts, so that no task ranks a whole language.
    """
    known = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out.alias("held"))
    known = known.where("lang is not null and text is not null and not coalesce(held, false)").select(
        "lang", F.xxhash64("id", F.lit(9)).alias("h"), "id")
    salted = known.withColumn("salt", F.pmod("h", F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "id"))).where(F.col("n") <= per_lang)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= per_lang)
    chosen = few.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("n").alias("_n"))
    own = docs.select(F.col(id).alias("_doc"), F.col(lang).alias("_of"), F.col(text).alias("_text"))  # no other column can clash
    rest = F.greatest(F.length("_text") - DICT_CHARS, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("_doc", F.lit(11)), rest).cast("int") + 1
    texts = own.join(F.broadcast(chosen), (F.col("_doc") == F.col("_id")) & (F.col("_of") == F.col("_lang"))).select(
        "_lang", "_n", F.col("_text").substr(place, F.lit(DICT_CHARS)).alias("_head"))
    out: dict[str, bytes] = {}
    for row in sorted(texts.distinct().collect()):
        out.setdefault(row._lang, b"")
        out[row._lang] += raw(row._head) + b"\n"
    return out


def dictionaries(texts: dict[str, bytes], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language, up to ``size`` bytes of its own texts.

    Shorter content is repeated to the length of the longest, so that no language gains by size
    and a rare one takes nothing from the others.
    """
    length = min(size, max((len(t) for t in texts.values()), default=0))
    return {lang: (t * -(-length // len(t)))[:length] if t else b"\n" * max(length, 1) for lang, t in sorted(texts.items())}


class Compressors:
    """Compressed size of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
        self.langs, self.piece, self.by = list(content), piece, []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        parts = [data[i:i + self.piece] for i in range(0, len(data), self.piece)] or [b""]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]


def judge(models: tuple[Compressors, ...], text: str | None) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text.

    ``und`` for null, for a text without a letter, and if nothing was learned. The margin is the
    lead of the best over the second size relative to the second; the score is a logistic
    function of it. A margin under ``MARGIN`` is judged once more by the next, more careful
    compressors; if it stays narrow the row is rejected: the language of the smallest size stays
    in the result, flagged, with a score below one half.
    """
    if text is None or not models[0].langs or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    data = raw(text.lower())
    for model in models:
        order = sorted(zip(model.sizes(data), model.langs))
        margin = (order[1][0] - order[0][0]) / max(order[1][0], 1) if len(order) > 1 else 1.0
        if margin >= MARGIN:
            break
    return order[0][1], 1.0 / (1.0 + math.exp(-100.0 * (margin - MARGIN))), margin, margin < MARGIN


def identify_language(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", held_out=None) -> DataFrame:
    """One row per input row: ``id``, held_out, lang_pred, score, margin, rejected.

    Learns only from rows outside ``held_out`` with a language; predictions read the text alone.
    Null text, or one without a letter: ``und``, score 0. Repeated rows are kept, an empty
    table gives an empty result, extra columns are ignored.
    """
    held = remainder(F.col(id), 4) == 2 if held_out is None else held_out
    content = dictionaries({k: raw(v.decode("utf-8", "replace").lower()) for k, v in training_texts(docs, id=id, text=text, lang=lang, held_out=held).items()})
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = Compressors(sent.value), Compressors(sent.value, CAREFUL_LEVEL)
        for texts in batches:
            yield pd.DataFrame([judge(models, t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    judged = F.pandas_udf(score, "lang_pred string, score double, margin double, rejected boolean")
    rows = docs.select(F.col(id).alias(id), F.coalesce(held, F.lit(False)).alias("held_out"), judged(F.col(text)).alias("_j"))
    return rows.select(id, "held_out", "_j.lang_pred", "_j.score", "_j.margin", "_j.rejected")
