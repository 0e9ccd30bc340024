"""Tagged text: label harmonising, BIO decoding and encoding, sub-word alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import TOKEN, computed_once, slices

ENTITY = "struct<text:string,label:string,start:int,end:int>"
SPANS = "array<struct<start:int,end:int,label:string>>"


def map_tag(tag: Column) -> Column:
    """Known tags stay, Tool becomes Malware, Person becomes Organization, else O."""
    return (
        F.when(tag.isin(*fixed.TAGS), tag)
        .when(tag.contains("Tool"), F.replace(tag, F.lit("Tool"), F.lit("Malware")))
        .when(tag.contains("Person"), F.replace(tag, F.lit("Person"), F.lit("Organization")))
        .otherwise("O")
    )


def map_tags(tags: Column) -> Column:
    return F.transform(tags, map_tag)


def tag_ids(tags: Column) -> Column:
    """Tag texts -> ids; unknown -> 0."""
    return F.transform(
        tags, lambda t: F.coalesce(F.nullif(F.array_position(_tag_list(), t), F.lit(0)) - 1, F.lit(0)).cast("int")
    )


def tag_names(ids: Column) -> Column:
    """Ids -> tag texts; out of range -> O."""
    return F.transform(ids, lambda i: F.coalesce(F.get(_tag_list(), i), F.lit("O")))


def _tag_list() -> Column:
    return F.array(*[F.lit(t) for t in fixed.TAGS])


def bio_runs(tags: Sequence[str | None], orphans: str) -> list[tuple[str, int, int]]:
    """``(label, start, end)`` of every entity of one tag sequence, in one pass."""
    opening = ("B-",) if orphans == "close" else ("B-", "I-")
    runs, label, begin = [], None, 0
    for i, tag in enumerate(tags):
        prefix, name = (tag[:2], tag[2:]) if tag is not None else (None, None)
        if prefix == "I-" and name == label:
            continue
        if label is not None:
            runs.append((label, begin, i))
        label, begin = (name, i) if prefix in opening else (None, i)
    if label is not None:
        runs.append((label, begin, len(tags)))
    return runs


def _entities(tokens: Sequence[str | None], tags: Sequence[str | None], orphans: str) -> list[dict]:
    """Entities with their texts; the longer of both sequences counts, what the other lacks is null."""
    tags = [*tags, *[None] * (len(tokens) - len(tags))]
    found = []
    for label, begin, end in bio_runs(tags, orphans):
        held = list(tokens[begin:end])
        text = " ".join(t for t in held if t is not None) if end - begin > 1 else held[0] if held else None
        found.append({"text": text, "label": label, "start": begin, "end": end})
    return found


def decode_bio(tokens: Column, tags: Column, *, orphans: str = "close") -> Column:
    """Entities ``array<struct<text,label,start,end>>`` with token positions.

    ``B-`` opens, ``I-`` of the open label extends, anything else closes.
    ``orphans="open"`` lets an ``I-`` without a matching open entity start one, the
    rule of entity-level scoring. One linear pass per row, in Arrow batches.
    """

    def decode(words: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([
            None if w is None or m is None else _entities(w, m, orphans) for w, m in zip(words, marks)], dtype=object)

    return F.pandas_udf(decode, f"array<{ENTITY}>")(tokens, tags)


def collect_spans(df: DataFrame, *, id: str, content: str = "content", events: str = "cyberevent") -> DataFrame:
    """Span annotations of a document: ``id, content, spans``.

    Reads ``events.hopper[].events[].argument[]``, keeps arguments of a known type
    with both offsets, and maps their types. Nested arrays are flattened inside
    the row, so nothing is shuffled.
    """
    arguments = F.flatten(F.flatten(F.transform(
        F.coalesce(F.col(f"{events}.hopper"), F.array()),
        lambda h: F.transform(F.coalesce(h["events"], F.array()),
                              lambda e: F.coalesce(e["argument"], F.array())))))
    pairs = [part for k, v in fixed.SPAN_TYPE_LABELS.items() for part in (F.lit(k), F.lit(v))]
    spans = F.transform(arguments, lambda a: F.struct(
        a["startOffset"].cast("int").alias("start"), a["endOffset"].cast("int").alias("end"),
        F.try_element_at(F.create_map(*pairs), a["type"]).alias("label")))
    known = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["label"].isNotNull())
    return (
        computed_once(df.filter(F.length(content) > 0), "spans", known.cast(SPANS))
        .select(id, F.col(content).alias("content"), "spans")
        .filter(F.size("spans") > 0)
    )


def drop_overlaps(spans: Column) -> Column:
    """Greedy: by start, longer first; keep a span starting at or after the last kept end."""
    ordered = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), (s["start"] - s["end"]).alias("neg_len"), s["label"].alias("label")))),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["neg_len"]).alias("end"),
                           s["label"].alias("label")))
    zero = F.struct(F.array().cast(SPANS).alias("kept"), F.lit(-1).alias("edge"))
    return F.aggregate(
        ordered, zero,
        lambda acc, s: F.when(
            s["start"] >= acc["edge"],
            F.struct(F.array_append(acc["kept"], s).alias("kept"), s["end"].alias("edge")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


TAGGED = "tokens array<string>, ner_tags array<string>"


def _tags(text: str, starts: Sequence[int], ends: Sequence[int], labels: Sequence[str]) -> tuple[list[str], list[str]]:
    """Tokens and tags of one text: tokens and spans are both in order and are merged in one pass."""
    tokens, tags, at, before = [], [], 0, True
    for match in TOKEN.finditer(text):
        begin = match.start()
        while at < len(ends) and ends[at] <= begin:
            at += 1
        inside = at < len(starts) and starts[at] <= begin
        tag = "O"
        if inside:
            tag = f"{'I' if before and begin != starts[at] else 'B'}-{labels[at]}"
        tokens.append(match.group())
        tags.append(tag if tag in fixed.TAGS else "O")
        before = inside
    return tokens, tags


def _tag_texts(texts: pd.Series, starts: pd.Series, ends: pd.Series, labels: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None) if t is None else _tags(t, *([] if x is None else list(x) for x in (s, e, n)))
        for t, s, e, n in zip(texts, starts, ends, labels)]
    return pd.DataFrame(rows, columns=["tokens", "ner_tags"])


def _tag_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for piece in slices(*batch):
            yield _tag_texts(*piece)


def tag_tokens(df: DataFrame, *, text: str, spans: str, min_tokens: int = 3) -> DataFrame:
    """Adds ``tokens`` and ``ner_tags`` for sorted, disjoint character spans.

    A token belongs to the span its start lies in. It gets ``B-`` at the span
    start or after a token outside all spans, else ``I-``. Rows with ``min_tokens``
    or fewer tokens are dropped, as are null texts. The time is linear in tokens plus
    spans; everything stays inside the row.
    """
    parts = [F.col(spans).getField(c) for c in ("start", "end", "label")]
    tagged = computed_once(df, "_tagged", F.pandas_udf(_tag_batches, TAGGED)(F.col(text), *parts))
    return tagged.filter(F.size("_tagged.tokens") > min_tokens).select(
        *df.columns, F.col("_tagged.ner_tags").alias("ner_tags"), F.col("_tagged.tokens").alias("tokens"))


def augment_split(base: DataFrame, extra: DataFrame, *, split: str = "train") -> DataFrame:
    """Append an extra corpus to one split only."""
    return base.unionByName(extra.withColumn("split", F.lit(split)))


def align_labels(word_ids: Column, tags: Column) -> Column:
    """Sub-word labels: special piece -> -100, first piece -> tag id, later pieces -> -100."""

    def label(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(word_ids, i - 1))
        return (
            F.when(w.isNull(), -100)
            .when(w.eqNullSafe(before), -100)
            .otherwise(F.coalesce(F.get(tags, w), F.lit(0)))
        )

    return F.transform(word_ids, label)
