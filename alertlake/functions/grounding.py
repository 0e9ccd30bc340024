"""Summary clean-up: is the text grounded in its source?"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import OTHERS, SPACES, ends_sentence, let, sentences, strip, word_count

MIN_WORDS = 4
DROPPED = OTHERS.replace("!-~", "!-/:-`{-~")  # neither a-z, 0-9 nor white space


def normalize_grounding(text: Column) -> Column:
    """Lower case, only ``a-z 0-9`` and single spaces."""
    kept = F.regexp_replace(F.lower(text), rf"[{DROPPED}]+", "")
    return F.trim(F.regexp_replace(kept, rf"[{SPACES}]+", " "))


def _closed(candidate: Column, punctuation: Column) -> Column:
    return F.when(ends_sentence(candidate), candidate).otherwise(F.concat(candidate, punctuation))


def _bare(c: Column, drop: str = ",;:") -> Column:
    return F.regexp_replace(strip(c), rf"[{re.escape(drop)}]+\z", "")


class Source:
    """A normalised text that answers whether it holds another, by the places of its word pairs.

    Text of four or more words is looked for where its second and third word stand together; shorter text
    directly. The places are gathered once for each source.
    """

    def __init__(self, norm: str):
        self.norm, self.words, self.places = norm, set(norm.split(" ")), None

    def _at(self, pair: tuple[str, str]) -> list[int]:
        if self.places is None:
            self.places, at, before = {}, 0, None
            for word in self.norm.split(" "):
                if before is not None:
                    self.places.setdefault((before, word), []).append(at - len(before) - 1)
                at, before = at + len(word) + 1, word
        return self.places.get(pair, [])

    def holds(self, norm: str) -> bool:
        parts = norm.split(" ", 3)
        if len(parts) < 4:
            return norm in self.norm
        back = len(parts[0]) + 1
        return any(p >= back and self.norm.startswith(norm, p - back) for p in self._at((parts[1], parts[2])))


def _normal(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9\s]", "", text.lower()).split())


def _trimmed(sentence: str, source: Source) -> str | None:
    s = sentence.strip()
    norm = _normal(s)
    if not norm or source.holds(norm):
        return s if norm else None
    end = s[-1] if s[-1] in ".!?" else "."

    def ended(c: str) -> str:
        return c if c.endswith((".", "!", "?")) else c + end

    for cut in reversed([m.start() for m in re.finditer(r"[,;:]\s+", s)]):
        clause = s[:cut].strip().rstrip(",;:")
        n = _normal(clause)
        if n.count(" ") + 1 >= MIN_WORDS and n and source.holds(n):
            return ended(clause)
    words_of = s.split()
    norms = [_normal(w) for w in words_of]
    low, high = MIN_WORDS - 1, len(words_of) - 1
    while low < high:  # leading words fit up to some number
        middle = (low + high + 1) // 2
        if source.holds(" ".join(n for n in norms[:middle] if n)):
            low = middle
        else:
            high = middle - 1
    return ended(" ".join(words_of[:low]).strip().rstrip(",;:")) if low >= MIN_WORDS else None


def _trim_each(found: pd.Series, norms: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or n is None else _trimmed(s, Source(n)) for s, n in zip(found, norms)], dtype=object)


def trim_to_source(sentence: Column, source_norm: Column) -> Column:
    """Longest part of a sentence, from its start, that occurs in the source; else null.

    The whole sentence, else the part before the last fitting ``, ; :`` (at least
    four words), else as many leading words as fit (at least four). Words fit
    monotonically, so their number is found by bisection.
    """
    return F.pandas_udf(_trim_each, "string")(sentence, source_norm)


def lead_summary(text: Column, max_chars: int = 300) -> Column:
    """Leading sentences up to ``max_chars`` (always the first); blank text -> its first 200 characters."""
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(a: Column, s: Column) -> Column:
        over = (F.length(a["out"]) > 0) & (F.length(a["out"]) + F.length(s) + 1 > max_chars)
        longer = F.when(F.length(a["out"]) > 0, F.concat(a["out"], F.lit(" "), s)).otherwise(s)
        return F.when(a["full"] | over, F.struct(a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(
            F.struct(longer.alias("out"), F.lit(False).alias("full")))

    led = F.aggregate(sentences(text), zero, step, lambda a: a["out"])
    return F.coalesce(F.nullif(led, F.lit("")), strip(F.substring(text, 1, 200)))


def _without_prefixes(summary: Column) -> Column:
    def without(text: Column, prefix: str) -> Column:
        return let(text, lambda s: F.when(
            F.lower(s).startswith(prefix.lower()), strip(F.substring(s, len(prefix) + 1, 2**31 - 1))).otherwise(s))

    out = strip(summary)
    for prefix in fixed.SUMMARY_PREFIXES:
        out = without(out, prefix)
    return out


def _grounded(found: Sequence[str], norm: str) -> str | None:
    """The kept sentences of one summary; what follows the first stop is not looked at."""
    source, kept, seen = Source(norm), [], {}
    for sentence in found:
        text = _trimmed(sentence, source) or sentence
        own = set(_normal(text).split())
        if not own:
            continue
        shared = Counter(i for word in own for i in seen.get(word, ()))
        drifts = kept and 2 * len(own & source.words) < len(own)
        if drifts or any(2 * n > len(own) for n in shared.values()):
            break
        for word in own:
            seen.setdefault(word, []).append(len(kept))
        kept.append(text)
    return " ".join(kept) if kept else None


def _ground_each(found: pd.Series, norms: pd.Series) -> pd.Series:
    return pd.Series([
        None if s is None or n is None else _grounded(s, n) for s, n in zip(found, norms)], dtype=object)


def clean_summary(summary: Column, source: Column) -> Column:
    """Keep the grounded, non-repeating sentences from the start of a summary.

    Each sentence is first cut to its grounded part. Clean-up stops at a sentence
    that shares more than half its words with an earlier one, or has fewer than
    half of its words in the source (never at the first). Nothing kept -> lead
    sentences of the source. The source is indexed once, so the time grows with
    source plus summary.
    """
    kept = F.pandas_udf(_ground_each, "string")(sentences(_without_prefixes(summary)), normalize_grounding(source))
    return F.coalesce(kept, lead_summary(source))


def cut_drift(summary: Column, *, min_words: int = 8) -> Column:
    """Cut at chat markers, then before off-topic phrases when enough words remain."""
    out = strip(summary)
    for marker in fixed.CHAT_MARKERS:
        out = strip(F.substring_index(out, marker, 1))

    def drift(s: Column) -> Column:
        low = F.lower(s)
        at = F.array_min(F.filter(
            F.array(*[F.instr(low, F.lit(m)) for m in fixed.OFF_TOPIC_MARKERS]), lambda i: i > 1))
        cut = let(at, lambda i: _bare(F.substr(s, F.lit(1), i - 1), ",;:-"))
        return let(cut, lambda c: F.when(c.isNull() | (word_count(c) < min_words), s).otherwise(_closed(c, F.lit("."))))

    return let(out, drift)


def guard_length(cleaned: Column, cut: Column, source: Column) -> Column:
    """``cleaned``, or lead sentences where a summary of 12 words or more was left with fewer than 8."""
    return F.when((word_count(cleaned) < 8) & (word_count(cut) >= 12), lead_summary(source, 220)).otherwise(cleaned)
