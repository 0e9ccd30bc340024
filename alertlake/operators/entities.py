"""Indicators (IOCs), entities and security events in text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import SPACES, SPAN_TYPE, computed_once, let, match_spans, slices, strip, unicode_pattern, unnest

ENTITY = ("struct<text:string,label:string,start:int,end:int,confidence:double,"
          "ioc_type:string,ioc_validated:boolean>")
RULE_ENTITY = "struct<text:string,label:string,ioc_type:string>"
RULE_EVENT = "struct<type:string,keyword:string>"
TOKEN_RUN = "struct<label:string,start:int,end:int,first:int,n:int,raw:string,mean:double>"
ENTITY_LABELS = ("Malware", "Tool", "Indicator", "System", "Vulnerability", "Organization")
FIXED_PART = {"CVE_ID": "cve-", "URL": "http", "Email_Address": "@"}
CVE_WINDOW = 30
HASH_WINDOW = 20


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# ------------------------------------------------------------------------ values
def _may_hold(value: Column) -> Column:
    """Whether any indicator pattern can match: all need one of these marks, hashes 32 characters."""
    return (F.length(value) >= 32) | (F.translate(value, ".:@-", "") != value)


def classify_ioc(value: Column) -> Column:
    """``struct<ioc_type,validated>`` for a value that must match as a whole."""

    def first_match(v: Column) -> Column:
        out = None
        for pattern, kind in fixed.VALUE_PATTERNS:
            hit = v.rlike(unicode_pattern(rf"\A(?:{pattern})\z"))
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out

    kind = let(strip(value), lambda v: F.when(_may_hold(v), first_match(v)))
    return F.struct(F.coalesce(kind, F.lit("Unknown")).alias("ioc_type"), kind.isNotNull().alias("validated"))


def narrow_span(span: Column, start: Column) -> Column:
    """First indicator inside a span, or null: ``struct<text,start,end,ioc_type>``."""

    def search(s: Column) -> Column:
        out = None
        for pattern, kind in fixed.SPAN_PATTERNS:
            p = unicode_pattern(pattern)
            hit = F.regexp_extract(s, p, 0)
            at = start + F.length(F.get(F.split(s, p, 2), F.lit(0)))
            found = F.struct(hit.alias("text"), at.alias("start"), (at + F.length(hit)).alias("end"),
                             F.lit(kind).alias("ioc_type"))
            out = F.when(s.rlike(p), found) if out is None else out.when(s.rlike(p), found)
        return out

    return let(span, lambda s: F.when(_may_hold(s), search(s)))


# -------------------------------------------------------------------- predictions
def softmax_peak(logits: Column) -> Column:
    """Highest softmax probability per token of ``array<array<double>>``."""
    return F.transform(logits, lambda row: 1 / F.aggregate(
        F.transform(row, lambda x: F.exp(x - F.array_max(row))), F.lit(0.0), lambda a, b: a + b))


def argmax(logits: Column) -> Column:
    return F.transform(logits, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def _numbers(values: Sequence) -> list:
    """Array elements as Python numbers; a null among integers makes all of them floats on the way."""
    return [None if v is None or v != v else v for v in (values.tolist() if hasattr(values, "tolist") else values)]


def _token_runs(text: str, starts: list, ends: list, ids: list, scores: list, tags: Sequence[str]) -> list[dict]:
    """Entities of one text as runs of tokens, each with its text and the mean confidence of the tokens inside."""
    done, run = [], None
    ids = [*ids, *[None] * (len(starts) - len(ids))]
    for i, (start, end, number) in enumerate(zip(starts, ends, ids)):
        tag = tags[int(number)] if number is not None and 0 <= number < len(tags) else "O"
        prefix, label = tag[:2], tag[2:]
        special = not (start or end)  # a missing offset closes too
        if not special and run is not None and run["label"] == label:
            near = start is not None and run["end"] is not None and start <= run["end"] + 1
            if prefix == "I-" or (prefix == "B-" and near):
                run["end"], run["n"] = end, run["n"] + 1
                continue
        if run is not None:
            done.append(run)
        run = {"label": label, "start": start, "end": end, "first": i, "n": 1} if prefix == "B-" and not special else None
    if run is not None:
        done.append(run)
    for run in done:
        begin, stop, places = run["start"], run["end"], range(run["first"], run["first"] + run["n"])
        known = begin is not None and stop is not None
        run["raw"] = text[int(begin): int(stop)].strip() if known else None
        inside = [scores[i] if i < len(scores) else None for i in places if known and None not in (starts[i], ends[i])
                  and starts[i] >= begin and ends[i] <= stop]
        total = 0.0
        for score in inside:
            total = None if total is None or score is None else total + score
        run["mean"] = total / len(inside) if inside and total is not None else None
    return done


def spans_from_predictions(text: Column, offsets: Column, label_ids: Column, confidences: Column,
                           *, tags: Sequence[str] = fixed.TAGS) -> Column:
    """Token predictions -> entities.

    ``offsets`` is ``array<struct<start,end>>``; (0,0) marks a special token and
    closes the open entity. ``B-`` merges into an open entity of the same label
    that ends at most one character before, ``I-`` of the same label extends.
    Confidence is the mean over the entity's tokens inside the final span. Tokens are
    merged in one linear pass per row, in Arrow batches; an entity is a run of tokens,
    so only the run travels. Offsets must be in text order.
    """
    starts, ends = (offsets.getField(side).cast("array<int>") for side in ("start", "end"))
    scores = confidences.cast("array<double>")

    def merge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            for piece in slices(*batch):
                yield pd.Series([
                    None if any(x is None for x in row) else _token_runs(row[0], *map(_numbers, row[1:]), tags)
                    for row in zip(*piece)], dtype=object)

    runs = F.pandas_udf(merge, f"array<{TOKEN_RUN}>")(text, starts, ends, label_ids.cast("array<int>"), scores)
    return F.transform(runs, lambda r: finish_entity(r, starts, ends, scores))


def finish_entity(run: Column, starts: Column, ends: Column, scores: Column) -> Column:
    """Classify a run of tokens, narrow an unvalidated indicator, average the confidences of its tokens inside."""
    label = F.when(run["label"].isin(*ENTITY_LABELS), run["label"]).otherwise("Indicator")

    def entity(text: Column, start: Column, end: Column, mean: Column, kind: Column, valid: Column) -> Column:
        return F.struct(text.alias("text"), label.alias("label"), start.alias("start"), end.alias("end"),
                        F.coalesce(F.bround(mean, 4), F.lit(0.0)).alias("confidence"),
                        kind.alias("ioc_type"), valid.alias("ioc_validated")).cast(ENTITY)

    def mean_inside(n: Column) -> Column:
        held = F.arrays_zip(*[
            F.slice(c, run["first"] + 1, run["n"]).alias(k) for k, c in (("start", starts), ("end", ends), ("conf", scores))])
        inside = F.filter(held, lambda t: (t["start"] >= n["start"]) & (t["end"] <= n["end"]))
        return let(F.transform(inside, lambda t: t["conf"]), lambda c: F.try_divide(
            F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.size(c).cast("double")))

    def shaped(kind: Column) -> Column:
        whole = entity(run["raw"], run["start"], run["end"], run["mean"], kind["ioc_type"], kind["validated"])
        inner = F.when(~kind["validated"] & (label == "Indicator"), narrow_span(run["raw"], run["start"]))
        return let(inner, lambda n: F.when(n.isNull(), whole).otherwise(
            entity(n["text"], n["start"], n["end"], mean_inside(n), n["ioc_type"], F.lit(True))))

    return let(classify_ioc(run["raw"]), shaped)


# ------------------------------------------------------------- repair and recovery
def repair_cve(text: Column, entities: Column) -> Column:
    """Extend entities that hold only the beginning of a CVE id."""
    p = unicode_pattern(fixed.CVE)

    def fix(e: Column) -> Column:
        partial = F.upper(e["text"]).startswith("CVE-") & ~e["text"].rlike(unicode_pattern(rf"\A(?:{fixed.CVE})\n?\z"))
        full = F.regexp_extract(F.substr(text, e["start"] + 1, F.lit(CVE_WINDOW)), p, 0)
        longer = let(full, lambda f: F.when(partial & (f != ""), F.struct(
            f.alias("text"), F.lit("Vulnerability").alias("label"), e["start"].alias("start"),
            (e["start"] + F.length(f)).alias("end"), F.greatest(e["confidence"], F.lit(0.9)).alias("confidence"),
            F.lit("CVE_ID").alias("ioc_type"), F.lit(True).alias("ioc_validated")).cast(ENTITY)))
        return F.coalesce(longer, e)

    return F.transform(entities, fix)


def _candidates(text: Column) -> Column:
    """All pattern hits in pattern order, each with type and label; texts without a pattern's fixed part are not scanned."""

    def hits(pattern: str, kind: str, label: str) -> Column:
        found = match_spans(text, unicode_pattern(pattern))
        if kind in FIXED_PART:
            found = F.when(F.contains(F.lower(text), F.lit(FIXED_PART[kind])), found).otherwise(_empty(SPAN_TYPE))
        elif kind == "IP_Address":
            found = F.when(text.rlike(unicode_pattern(r"\d\.\d")), found).otherwise(_empty(SPAN_TYPE))
        return F.transform(found, lambda h: F.struct(
            h["value"].alias("text"), h["start"].alias("start"), h["end"].alias("end"),
            F.lit(kind).alias("ioc_type"), F.lit(label).alias("label")))

    return F.concat(*[hits(*row) for row in fixed.RECOVERY_PATTERNS])


def _recovered(found: Sequence[dict], entities: Sequence[dict]) -> list[dict]:
    """Entities with the accepted hits of one text: positions covered so far are marked, entities found by their sorted ends."""
    size = max([0, *(x["end"] for x in found), *(e["end"] for e in entities)])
    covered = bytearray(size)
    order = sorted(range(len(entities)), key=lambda i: entities[i]["start"])
    starts = [entities[i]["start"] for i in order]
    furthest = list(accumulate((entities[i]["end"] for i in order), max))
    for e in entities:
        covered[e["start"]: e["end"]] = b"\1" * max(e["end"] - e["start"], 0)
    added, replaced = [], set()
    for hit in found:
        begin, end = hit["start"], hit["end"]
        near = order[bisect_right(furthest, begin): bisect_left(starts, end)]
        over = [i for i in near if entities[i]["end"] > begin]
        fragments = bool(over) and all(
            entities[i]["start"] >= begin and entities[i]["end"] <= end and entities[i]["label"] == hit["label"]
            and entities[i]["ioc_validated"] is not None and not entities[i]["ioc_validated"] for i in over)
        bare_hash = hit["ioc_type"] == "File_Hash" and len(hit["text"]) == 40 and not hit["context"]
        if bare_hash or not (fragments or 2 * covered.count(1, begin, end) <= end - begin):
            continue
        if fragments:
            replaced.update(over)
        covered[begin:end] = b"\1" * (end - begin)
        known = [entities[i]["confidence"] for i in over if entities[i]["confidence"] is not None]
        added.append({
            "text": hit["text"], "label": hit["label"], "start": begin, "end": end, "confidence": max([0.85, *known]),
            "ioc_type": hit["ioc_type"], "ioc_validated": True})
    kept = [e for i, e in enumerate(entities) if i not in replaced]
    return sorted([*kept, *added], key=lambda e: (e["start"], e["end"]))


def _plain(items: Sequence | None) -> list[dict]:
    return [] if items is None else [x.asDict() if hasattr(x, "asDict") else dict(x) for x in items]


def _recover(found: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else _recovered(_plain(f), _plain(e)) for f, e in zip(found, entities)], dtype=object)


def recover_iocs(df: DataFrame, *, text: str, entities: str, out: str = "entities") -> DataFrame:
    """``df`` with ``out``: the entities and the indicators the entity model missed, entirely inside the row.

    A hit is skipped when more than half of its characters are already covered,
    unless only unvalidated fragments with its own label lie inside it; those it
    replaces. A 40-digit hash needs a context word in the 20 characters before.
    Accepted hits count as covered for later patterns. Patterns are matched in the
    JVM; hits are then taken in one pass per row, in time linear in their lengths.
    """
    body = F.col(text)

    def with_context(c: Column) -> Column:
        before = F.lower(F.substr(
            body, F.greatest(c["start"] - HASH_WINDOW, F.lit(0)) + 1, F.least(c["start"], F.lit(HASH_WINDOW))))
        named = (c["ioc_type"] == "File_Hash") & before.rlike("|".join(fixed.HASH_CONTEXT_WORDS))
        return F.struct(*[c[n].alias(n) for n in ("text", "start", "end", "ioc_type", "label")], named.alias("context"))

    found = computed_once(df, "_hits", F.transform(_candidates(body), with_context))
    found = computed_once(found, "_known", repair_cve(body, F.coalesce(F.col(entities), _empty(ENTITY))))
    found = computed_once(found, "_all", F.pandas_udf(_recover, f"array<{ENTITY}>")("_hits", "_known"))
    return found.select(*[c for c in df.columns if c != out], F.col("_all").alias(out))


# ------------------------------------------------------------------------- events
def detected_events(text: Column) -> Column:
    """First listed phrase per event type: ``array<struct<event_type,trigger,confidence>>``."""
    kinds = list(dict.fromkeys(kind for _, kind in fixed.EVENT_PHRASES))

    def find(low: Column) -> Column:
        found = []
        for kind in kinds:
            trigger = reduce(
                lambda acc, p: acc.when(low.contains(p), p) if acc is not None else F.when(low.contains(p), p),
                [p for p, k in fixed.EVENT_PHRASES if k == kind], None)
            found.append(F.struct(F.lit(kind).alias("event_type"), trigger.alias("trigger"),
                                  F.lit(fixed.EVENT_CONFIDENCE).alias("confidence")))
        return F.filter(F.array(*found), lambda e: e["trigger"].isNotNull())

    return let(F.lower(text), find)


def detect_events(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """One row per document and event type."""
    return unnest(df, [id], detected_events(F.col(text))).select(id, "item.*")


# ---------------------------------------------------------------- rule-only extract
def _hits(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern; texts without its fixed part are not scanned."""
    found = F.regexp_extract_all(text, F.lit(unicode_pattern(pattern)), F.lit(0))
    needs = {"CVE_ID": F.lower(text).contains("cve-"), "URL": text.contains("http"), "Email_Address": text.contains("@")}
    return F.when(needs[kind], found).otherwise(F.array().cast("array<string>")) if kind in needs else found


def rule_entities(text: Column) -> Column:
    """Indicators, known names and contextual words by rules alone.

    Indicators are distinct by (value, label) with the first pattern winning,
    contextual hits by lower-cased value. Set operations keep it linear.
    """

    def shape(values: Column, label: str, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(
            v.alias("text"), F.lit(label).alias("label"), F.lit(kind).alias("ioc_type")))

    names = F.filter(
        F.array(*[F.struct(F.lit(n).alias("text"), F.lit(n.lower()).alias("low")) for n in fixed.KNOWN_NAMES]),
        lambda n: F.contains(F.lower(text), n["low"]))
    found = F.struct(*[_hits(text, p, kind).alias(f"p{i}") for i, (p, _, kind) in enumerate(fixed.RULE_PATTERNS)])

    def indicators(hit: Column) -> Column:
        """Values of each pattern that no earlier one of its label has found; every pattern is matched once."""
        groups, parts = {}, []
        for i, (_, label, kind) in enumerate(fixed.RULE_PATTERNS):
            hits, seen = hit[f"p{i}"], groups.get(label)
            fresh = F.array_except(hits, seen) if seen is not None else F.array_distinct(hits)
            groups[label] = F.concat(seen, hits) if seen is not None else hits
            parts.append(shape(fresh, label, kind))
        return F.concat(*parts)

    out = [let(found, indicators)]
    out.append(shape(F.transform(names, lambda n: n["text"]), "Malware", "Unknown"))
    for pattern, label in fixed.CONTEXT_PATTERNS:
        hits = F.regexp_extract_all(text, F.lit(unicode_pattern(f"(?i){pattern}")), F.lit(0))

        def first_forms(h: Column) -> Column:
            return let(F.transform(h, F.lower), lambda low: F.transform(
                F.array_distinct(low), lambda d: F.get(h, (F.array_position(low, d) - 1).cast("int"))))

        out.append(shape(let(hits, first_forms), label, "Unknown"))
    return F.concat(*out).cast(f"array<{RULE_ENTITY}>")


def rule_events(text: Column) -> Column:
    """All listed phrases found; types may repeat."""
    return let(F.lower(text), lambda low: F.filter(
        F.array(*[F.struct(F.lit(k).alias("type"), F.lit(p).alias("keyword")) for p, k in fixed.RULE_EVENT_PHRASES]),
        lambda e: F.contains(low, e["keyword"]))).cast(f"array<{RULE_EVENT}>")


def extract_iocs(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """``id, pos, text, label, ioc_type``: one row per extracted entity."""
    return unnest(df, [id], rule_entities(F.col(text)), pos="pos").select(id, "pos", "item.*")


# ------------------------------------------------------------------ stored replies
def first_json_object(reply: Column) -> Column:
    """First balanced ``{...}`` of a text (quotes and escapes respected), else null.

    One pass over the characters with a small fixed-size state.
    """
    tail = F.regexp_extract(reply, r"(?s)\{.*", 0)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"),
                    F.lit(False).alias("escaped"), F.lit(-1).alias("end"))

    def step(a: Column, ch: Column) -> Column:
        plain = ~a["escaped"] & (ch != "\\")
        quoted = F.when(plain & (ch == '"'), ~a["quoted"]).otherwise(a["quoted"])
        outside = plain & ~a["quoted"]
        depth = a["depth"] + F.when(outside & (ch == "{"), 1).when(outside & (ch == "}"), -1).otherwise(0)
        at = a["at"] + 1
        return F.when(a["end"] >= 0, a).otherwise(F.struct(
            at.alias("at"), depth.alias("depth"), quoted.alias("quoted"),
            (~a["escaped"] & (ch == "\\")).alias("escaped"),
            F.when(outside & (ch == "}") & (depth == 0), at).otherwise(F.lit(-1)).alias("end")))

    return let(tail, lambda t: let(
        F.aggregate(F.split(t, ""), zero, step, lambda a: a["end"]),
        lambda end: F.when(end > 0, F.substr(t, F.lit(1), end))))


def parse_entity_replies(df: DataFrame, *, reply: str, text: str) -> DataFrame:
    """Adds ``entities`` and ``events`` from a stored model reply.

    Code fences and trailing commas are forgiven. An unreadable reply, or one with
    an empty list, falls back to the rules on the text.
    """
    body = strip(F.col(reply))
    unfenced = F.when(body.startswith("```json"), strip(
        F.replace(F.replace(body, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(body)
    repaired = let(F.coalesce(first_json_object(unfenced), unfenced), lambda c: F.coalesce(
        F.try_parse_json(c), F.try_parse_json(F.regexp_replace(c, rf",[{SPACES}]*([}}\]])", "$1"))))
    parsed = computed_once(df, "_v", repaired)

    def listed(key: str, kind: str, fallback: Column) -> Column:
        got = F.try_variant_get("_v", f"$.{key}", f"array<{kind}>")
        return F.when(F.size(got) > 0, got).otherwise(fallback)

    return parsed.withColumns({
        "entities": listed("entities", RULE_ENTITY, rule_entities(F.col(text))),
        "events": listed("events", RULE_EVENT, rule_events(F.col(text))),
    }).drop("_v")


def locate_entities(text: Column, entities: Column) -> Column:
    """Entities with offsets of their first occurrence (0,0 when absent).

    Only a validated Indicator keeps an indicator type; confidence is 0.99.
    """

    def place(e: Column) -> Column:
        value = F.coalesce(e["text"], F.lit(""))
        at = F.greatest(F.position(value, text) - 1, F.lit(0))
        found = F.contains(text, value)
        label = F.coalesce(e["label"], F.lit("O"))
        kind = F.when(label == "Indicator", classify_ioc(value))
        return F.struct(
            value.alias("text"), label.alias("label"),
            F.when(found, at).otherwise(0).alias("start"),
            F.when(found, at + F.length(value)).otherwise(0).alias("end"),
            F.lit(0.99).alias("confidence"),
            F.coalesce(kind["ioc_type"], F.lit("Unknown")).alias("ioc_type"),
            F.coalesce(kind["validated"], F.lit(False)).alias("ioc_validated")).cast(ENTITY)

    return F.transform(entities, place)


def iocs_from_entities(df: DataFrame, *, alert_id: str, tenant: str, entities: str, source: str = "NER") -> DataFrame:
    """Entity arrays -> rows of the indicator table."""
    keys = [F.col(alert_id).alias("alert_id"), F.col(tenant).alias("tenant_id")]
    return unnest(df, keys, F.col(entities), name="e").select(
        "alert_id", "tenant_id", F.coalesce("e.ioc_type", F.lit("Unknown")).alias("ioc_type"),
        F.col("e.text").alias("value"), F.lit(source).alias("source"),
        F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))
