"""Text helpers shared by the entity, tagging and summary operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space in Unicode, for use in a regex class, and everything else. Both are
# plain ranges, the commonest first: Java tests a negated class, or one with ``\s`` inside, several times as slowly.
SPACES = r"\x20\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHERS = (
    r"!-~\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e"
    r"\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}"
)
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))
BLOCK = 64
MARK = "\ue000"
SLICE_CHARS = 1 << 20
TOKEN = re.compile(r"\S+")
SPAN_TYPE = "struct<value:string,start:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    A lambda body is evaluated per element, so anything costly that does not
    depend on the element must be bound outside of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-element ``explode``.

    Filters on the new column stay above the generator; a plain projection would
    let the optimiser copy the expression into the pushed-down filter and run it
    twice per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def unnest(df: DataFrame, keep: Sequence[str | Column], value: Column, *, pos: str | None = None,
           name: str = "item") -> DataFrame:
    """``explode`` of a computed array: one row per element, columns ``keep`` and ``name``.

    Spark derives a "not empty" filter from an explode and would push it, with the
    whole array expression, below the projection; the array is therefore pinned
    first.
    """
    pinned = computed_once(df, "_items", value)
    if pos:
        return pinned.select(*keep, F.posexplode("_items").alias(pos, name))
    return pinned.select(*keep, F.explode("_items").alias(name))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"[{OTHERS}]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """True when the (already lower-cased) text holds one of ``phrases``."""
    return c.rlike("|".join(re.escape(p) for p in phrases))


def ends_sentence(c: Column) -> Column:
    return c.endswith(".") | c.endswith("!") | c.endswith("?")


def unicode_pattern(pattern: str) -> str:
    """Make ``\\b \\d \\s \\w`` Unicode-aware."""
    return f"(?U){pattern}"


def _running_ends(lengths: Column) -> Column:
    """Running sum of an int array.

    Appending copies the array, so sums run over blocks of ``BLOCK`` elements and
    the block totals are added afterwards.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, n: Column) -> Column:
        return let(acc["at"] + n, lambda at: F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out")))

    def ends(values: Column) -> Column:
        return F.aggregate(values, empty, add, lambda acc: acc["out"])

    def join_blocks(blocks: Column) -> Column:
        totals = ends(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(
            b, lambda e: e + F.when(i > 0, F.get(t, i - 1)).otherwise(0)))))

    def run(values: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
            lambda b: ends(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, join_blocks)

    return let(lengths, lambda v: F.when(F.size(v) > BLOCK, run(v)).otherwise(ends(v)))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches with offsets: ``array<struct<value,start,end>>``.

    Every match is set between two marks, so that the pattern is searched once: what lies between
    marks is a gap, a match, a gap and so on, and the running sum of their lengths gives every end.
    A text that holds the mark itself is searched twice.
    """

    def place(hits: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(hits, _running_ends(lengths), lambda hit, end: F.struct(
            hit.alias("value"), (end - F.length(hit)).alias("start"), end.alias("end")))

    def every_other(parts: Column, first: int) -> Column:
        return F.filter(parts, lambda _, i: i % 2 == first)

    def marked(parts: Column) -> Column:
        return let(every_other(parts, 1), lambda hits: F.when(F.size(hits) > 0, place(hits, every_other(parts, 0))).otherwise(none))

    none = F.array().cast(f"array<{SPAN_TYPE}>")
    once = let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), marked)
    twice = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, place(hits, F.split(text, pattern, -1))).otherwise(none))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def slices(*columns: pd.Series, chars: int = SLICE_CHARS) -> Iterator[tuple[pd.Series, ...]]:
    """An Arrow batch in pieces of about ``chars`` characters of its first column, the texts.

    What a pass makes of a text is many times as large as the text; in pieces, a worker's memory does not
    depend on how many rows a batch holds.
    """
    first, held = 0, 0
    for i, text in enumerate(columns[0]):
        held += len(text) if text is not None else 0
        if held >= chars:
            yield tuple(c.iloc[first: i + 1] for c in columns)
            first, held = i + 1, 0
    if first < len(columns[0]):
        yield tuple(c.iloc[first:] for c in columns)


def _tokens(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((None, None, None))
            continue
        found = [m.span() for m in TOKEN.finditer(text)]
        rows.append((text.split(), [a for a, _ in found], [b for _, b in found]))
    return pd.DataFrame(rows, columns=["value", "start", "end"], dtype=object)


def _token_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (texts,) in slices(batch):
            yield _tokens(texts)


def token_spans(text: Column) -> Column:
    """White-space separated tokens with offsets, one linear pass per row in Arrow batches."""
    found = F.pandas_udf(_token_batches, "value array<string>, start array<int>, end array<int>")(text)
    return let(found, lambda t: F.arrays_zip(
        t["value"].alias("value"), t["start"].alias("start"), t["end"].alias("end")))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; blanks dropped."""
    parts = F.split(text, rf"(?<=[.!?])[{SPACES}]+", -1)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)
