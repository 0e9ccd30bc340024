"""Vendor JSON -> canonical alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import computed_once, let
from alertlake.operators.ranking import first_n_per_group

TIMES = (-62_135_596_800_000_000, 253_402_300_799_999_999)  # years 1 to 9999 in microseconds
FALSY_JSON = ("0", "0.0", "-0", "-0.0", "false", "[]", "{}")


# ---------------------------------------------------------------- column helpers
def json_path(keys: Sequence[str]) -> str:
    return "$" + "".join(f'["{k}"]' for k in keys)


def _variant(v: Column, keys: Sequence[str]) -> Column:
    return F.try_variant_get(v, json_path(keys), "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<string>")


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def truthy_text(v: Column) -> Column:
    """Text of a JSON value; empty text, zero, false and empty containers -> null."""
    return let(
        _text(v),
        lambda text: F.when(
            ~((text == "") | (text.isin(*FALSY_JSON) & ~_is_text(v))), text
        ),
    )


def normalize_vendor(vendor: Column) -> Column:
    return F.translate(F.lower(vendor), "- ", "__")


def map_severity(
    value: Column,
    vendor: Column,
    *,
    words: Mapping[str, Mapping[str, str]] = fixed.SEVERITY_WORDS,
    bands: Mapping[str, Sequence[tuple[int, int, str]]] = fixed.SEVERITY_BANDS,
    cast_text: bool = False,
) -> Column:
    """Vendor severity (a variant) -> canonical severity; Medium when unmapped.

    Words apply to JSON text, bands to JSON numbers. ``cast_text=True`` lets a
    number sent as text use the bands as well.
    """
    entries = [
        part
        for name, table in words.items()
        for text, result in table.items()
        for part in (F.lit(f"{name}:{text}"), F.lit(result))
    ]
    parts = F.struct(
        _is_text(value).alias("is_text"),
        F.lower(_text(value)).alias("word"),
        F.try_variant_get(value, "$", "double").alias("number"),
        vendor.alias("vendor"),
    )

    def resolve(p: Column) -> Column:
        number = p["number"]
        if cast_text:
            number = F.coalesce(number, p["word"].try_cast("double"))
            numeric = F.lit(True)
        else:
            numeric = ~p["is_text"]
        level = number.try_cast("long")
        by_word = F.when(
            p["is_text"],
            F.try_element_at(F.create_map(*entries), F.concat_ws(":", p["vendor"], p["word"])),
        )
        by_level = [
            F.when((p["vendor"] == name) & numeric & level.between(low, high), result)
            for name, table in bands.items()
            for low, high, result in table
        ]
        return F.coalesce(by_word, *by_level, F.lit(fixed.DEFAULT_SEVERITY))

    return let(parts, resolve)


def parse_alert_ts(value: Column, *, override: Column | None = None, fallback: Column) -> Column:
    """Timestamp from a variant: epoch seconds or ISO-like text (UTC when no offset).

    Offsets are honoured. ``fallback`` is used when nothing parses; pass the
    ingest time so that a replay gives the same result. Numbers outside the years
    1 to 9999 do not parse.
    """
    parts = F.struct(
        _is_text(value).alias("is_text"), _text(value).alias("text"),
        F.try_variant_get(value, "$", "double").alias("seconds"),
    )

    def resolve(p: Column) -> Column:
        micros = (p["seconds"] * 1_000_000).try_cast("long")
        from_number = F.when(micros.between(*TIMES), F.timestamp_micros(micros))
        dated = F.when(p["text"].rlike(r"^\d{4}-\d{2}-\d{2}"), p["text"])
        from_text = F.coalesce(
            dated.try_cast("timestamp"),
            F.try_to_timestamp(dated, F.lit("yyyy-MM-dd'T'HH:mm:ssXX")),
        )
        return F.when(p["is_text"], from_text).otherwise(from_number)

    candidates = [let(parts, resolve), fallback]
    if override is not None:
        candidates.insert(0, override.try_cast("timestamp"))
    return F.coalesce(*candidates)


def dedup_key(tenant: Column, alert_id: Column, title: Column) -> Column:
    content = F.concat(tenant, F.lit(":"), alert_id, F.lit(":"), title)
    return F.concat(F.lit("dedup:"), F.substring(F.sha2(content, 256), 1, 24))


def extract_paths(
    v: Column, vendor: Column, field: str,
    mappings: Mapping[str, Mapping[str, Sequence[str]]] = fixed.VENDOR_PATHS,
) -> Column:
    """The variant at the vendor's path of ``field``; null for a vendor without one."""
    out = None
    for name, paths in mappings.items():
        if field in paths:
            got = _variant(v, paths[field])
            out = F.when(vendor == name, got) if out is None else out.when(vendor == name, got)
    return out if out is not None else F.lit(None).cast("variant")


# -------------------------------------------------------------------- operators
def resolve_envelope(
    df: DataFrame, *, body: str, vendor_query: str | None = None, tenant_header: str | None = None
) -> DataFrame:
    """Adds ``vendor, tenant_id, raw, ts_override`` from a posted JSON body.

    The body is either an envelope with a ``raw`` key or the raw alert itself, in
    which case the envelope keys are taken out. The query parameter and the
    tenant header win over the body.
    """
    doc = df.withColumn("_v", F.try_parse_json(F.col(body))).withColumn(
        "_m", F.from_json(F.col(body), "map<string,variant>")
    )

    def top(key: str) -> Column:
        return F.try_variant_get("_v", json_path([key]), "string")

    def prefer(column: str | None, key: str) -> Column:
        if column is None:
            return top(key)
        return F.coalesce(F.nullif(F.col(column), F.lit("")), top(key))

    rest = F.to_json(F.map_filter("_m", lambda k, _: ~k.isin(*fixed.ENVELOPE_FIELDS)))
    raw_value = F.try_variant_get("_v", '$["raw"]', "variant")
    wrapped = F.when(raw_value.isNotNull() & (F.schema_of_variant(raw_value) != "VOID"),
                     F.to_json(raw_value))
    raw = F.coalesce(wrapped, rest)
    return doc.select(
        *df.columns,
        prefer(vendor_query, "vendor").alias("vendor"),
        prefer(tenant_header, "tenant_id").alias("tenant_id"),
        F.when(raw.isin("{}", ""), F.col(body)).otherwise(raw).alias("raw"),
        top("timestamp").alias("ts_override"),
    )


def require_tenant(df: DataFrame, *, header: str | None = None, body: str = "tenant_id") -> DataFrame:
    """Header over body; rows without a tenant are dropped."""
    tenant = F.nullif(F.col(body), F.lit(""))
    if header:
        tenant = F.coalesce(F.nullif(F.col(header), F.lit("")), tenant)
    return df.withColumn("tenant_id", tenant).filter(F.col("tenant_id").isNotNull())


def normalize_alerts(
    df: DataFrame,
    *,
    vendor: str = "vendor",
    tenant: str = "tenant_id",
    raw: str = "raw",
    ts_override: str | None = None,
    ingest_ts: str | None = None,
    keep: Sequence[str] = (),
    mappings: Mapping[str, Mapping[str, Sequence[str]]] = fixed.VENDOR_PATHS,
) -> tuple[DataFrame, DataFrame]:
    """Canonical alerts and rejected rows (with ``reason``).

    One narrow projection: the payload is parsed once, no shuffle. ``keep`` names
    input columns to carry along.
    """
    named = df.withColumn("_vendor", normalize_vendor(F.col(vendor)))
    parsed = computed_once(named, "_v", F.try_parse_json(F.col(raw))).withColumn(
        "reason",
        F.when(F.coalesce(F.col(vendor), F.lit("")) == "", "vendor_required")
        .when(~F.col("_vendor").isin(*mappings), "unsupported_vendor")
        .when(F.col("_v").isNull(), "invalid_json"),
    )
    rejected = parsed.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")

    fields = sorted({f for paths in mappings.values() for f in paths})
    located = parsed.filter(F.col("reason").isNull()).select(
        "*", *[extract_paths(F.col("_v"), F.col("_vendor"), f, mappings).alias(f"_{f}") for f in fields]
    )

    def value(field: str) -> Column:
        return F.col(f"_{field}") if field in fields else F.lit(None).cast("variant")

    def optional(field: str) -> Column:
        return truthy_text(value(field))

    def first_item(field: str) -> Column:
        items = _list(value(field))
        return F.nullif(
            F.when(items.isNotNull(), F.get(items, F.lit(0))).otherwise(optional(field)), F.lit("")
        )

    def joined(field: str, sep: str) -> Column:
        return F.coalesce(F.array_join(_list(value(field)), sep), _text(value(field)))

    alert_id = F.coalesce(optional("alert_id"), F.sha2(F.col(raw), 256))
    title = F.coalesce(joined("title", " | "), F.lit(fixed.DEFAULT_TITLE))
    fallback = F.col(ingest_ts).cast("timestamp") if ingest_ts else F.current_timestamp()
    override = F.col(ts_override) if ts_override else None
    no_text = F.lit(None).cast("string")
    shaped = located.select(
        alert_id.alias("alert_id"),
        F.col(tenant).alias("tenant_id"),
        parse_alert_ts(value("timestamp"), override=override, fallback=fallback).alias("timestamp"),
        F.col("_vendor").alias("source"),
        title.alias("normalized_title"),
        map_severity(value("severity"), F.col("_vendor")).alias("severity"),
        F.col(raw).alias("raw_data"),
        first_item("mitre_tactic").alias("mitre_tactic"),
        first_item("mitre_technique").alias("mitre_technique"),
        no_text.alias("entity_type"),
        optional("device_name").alias("device_name"),
        optional("ip_address").alias("ip_address"),
        optional("user_name").alias("user_name"),
        optional("file_hash").alias("file_hash"),
        no_text.alias("url"),
        no_text.alias("domain"),
        F.nullif(joined("category", ", "), F.lit("")).alias("category"),
        no_text.alias("threat_family"),
        no_text.alias("suspicion_level"),
        *keep,
    )
    key = dedup_key(F.col("tenant_id"), F.col("alert_id"), F.col("normalized_title"))
    ok = shaped.withColumn("dedup_key", key).select(*fixed.CANONICAL_FIELDS, *keep)
    return ok, rejected


# What a field of a message may be: (JSON type, may be null). Absent fields get defaults and are never at fault.
MESSAGE_RULES = {
    **{name: ("STRING", False) for name in ("alert_id", "tenant_id", "source", "normalized_title")},
    **{name: ("STRING", True) for name in (
        "mitre_tactic", "mitre_technique", "entity_type", "device_name", "ip_address", "user_name", "file_hash", "url",
        "domain", "category", "threat_family", "suspicion_level", "dedup_key")},
    "timestamp": (None, False), "severity": (None, False),
}


def field_violations(
    present: Callable[[str], Column], field: Callable[[str], Column], rules: Mapping[str, tuple[str | None, bool]],
) -> list[Column]:
    """``null:<field>`` or ``type:<field>`` where a present variant breaks its rule, else null."""
    out = []
    for name, (kind, nullable) in rules.items():
        value = F.coalesce(F.schema_of_variant(field(name)), F.lit("VOID"))
        wrong = F.lit(None).cast("string")
        if not nullable:
            wrong = F.when(value == "VOID", F.lit(f"null:{name}"))
        if kind:
            wrong = F.coalesce(wrong, F.when(~value.isin("VOID", kind), F.lit(f"type:{name}")))
        out.append(F.when(present(name), wrong))
    return out


def check_messages(
    df: DataFrame, *, value: str = "value", ingest_ts: str | None = None, rules: Mapping[str, tuple[str | None, bool]] = MESSAGE_RULES,
) -> DataFrame:
    """Every topic message once: the columns of ``df``, ``alert`` (null if rejected), ``reason`` and ``violations``.

    Severity is capitalised, unknown top-level keys move into ``raw_data``, absent fields get their defaults.
    A message is rejected for bad JSON (``invalid_json``), a severity or timestamp that is none, a ``raw_data``
    that is not an object (empty values aside), or a field that is null or of another JSON type where
    ``rules`` forbid it (``invalid_fields``). ``violations`` names all faults, ``reason`` the first kind.
    """
    fallback = F.col(ingest_ts).cast("timestamp") if ingest_ts else F.current_timestamp()
    doc = computed_once(df, "_m", F.from_json(F.col(value), "map<string,variant>"))

    def field(name: str) -> Column:
        return F.try_element_at(F.col("_m"), F.lit(name))

    def present(name: str) -> Column:
        return F.map_contains_key(F.col("_m"), F.lit(name))

    doc = doc.withColumns({
        "_severity": _text(field("severity")),
        "_severity_is_text": _is_text(field("severity")),
        "_ts": _text(field("timestamp")),
        "_parsed_ts": parse_alert_ts(field("timestamp"), fallback=F.lit(None).cast("timestamp")),
    })
    sev = F.col("_severity")
    severity = F.coalesce(
        F.when(F.col("_severity_is_text"),
               F.concat(F.upper(F.substring(sev, 1, 1)), F.lower(F.substring(sev, 2, 2**31 - 1)))),
        sev, F.lit(fixed.DEFAULT_SEVERITY),
    )
    stamp = F.when(F.col("_ts").isNotNull(), F.col("_parsed_ts")).otherwise(fallback)
    payload = field("raw_data")
    raw_data = F.try_variant_get(payload, "$", "map<string,variant>")
    nothing = F.to_json(payload).isin("null", '""', "0", "false", "[]")
    faults = [
        F.when(F.col("_m").isNull(), F.lit("invalid_json")),
        F.when(~severity.isin(*fixed.SEVERITIES), F.lit("invalid_severity")),
        F.when(stamp.isNull(), F.lit("invalid_timestamp")),
        F.when(payload.isNotNull() & ~nothing & raw_data.isNull(), F.lit("invalid_raw_data")),
    ]
    found = F.array_compact(F.array(*faults, *field_violations(present, field, rules)))
    checked = computed_once(doc, "violations", found)
    first = F.get("violations", F.lit(0))
    checked = checked.withColumn("reason", F.when(first.startswith("invalid_"), first).when(first.isNotNull(), "invalid_fields"))
    extras = F.map_filter("_m", lambda k, _: ~k.isin(*fixed.CANONICAL_FIELDS))

    def merged(added: Column) -> Column:
        base = F.map_filter(raw_data, lambda k, _: ~F.map_contains_key(added, k))
        return F.to_json(F.coalesce(F.map_concat(base, added), added))

    defaults = {
        "alert_id": F.sha2(F.col(value), 256), "tenant_id": F.lit("unknown"),
        "source": F.lit("unknown"), "normalized_title": F.lit(fixed.DEFAULT_TITLE),
    }

    def column(name: str) -> Column:
        if name == "timestamp":
            return stamp
        if name == "severity":
            return severity
        if name == "raw_data":
            return let(extras, merged)
        text = _text(field(name))
        return F.coalesce(text, defaults[name]) if name in defaults else text

    alert = F.when(F.col("reason").isNull(), F.struct(*[column(name).alias(name) for name in fixed.CANONICAL_FIELDS]))
    shaped = computed_once(checked, "alert", alert)  # later filters and fields must not build it again
    return shaped.select(*df.columns, "alert", "reason", "violations")


def canonicalize(
    df: DataFrame, *, value: str = "value", ingest_ts: str | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(canonical alerts, rejected messages with ``reason`` and ``violations``): see :func:`check_messages`."""
    checked = check_messages(df, value=value, ingest_ts=ingest_ts)
    ok = checked.filter(F.col("reason").isNull()).select("alert.*", *keep)
    return ok, checked.filter(F.col("reason").isNotNull()).select(*df.columns, "reason", "violations")


def cap_per_request(
    df: DataFrame, *, request: Sequence[str], order: Sequence[str], cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows within the cap, the other rows with ``reason``); without a cap all rows are kept.

    A request keeps its first ``cap`` rows by ``order``, which must be unique in it.
    """
    over = F.lit("over_request_cap").alias("reason")
    if cap is None:
        return df, df.filter(F.lit(False)).select("*", over)
    kept = first_n_per_group(df, group=request, order=order, n=cap)
    keys = kept.select(*[F.col(c).alias(f"_{c}") for c in (*request, *order)])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*request, *order)]
    return kept, df.join(keys, same, "left_anti").select("*", over)


def ingest_outcomes(df: DataFrame, *, duplicate: str) -> DataFrame:
    """One outcome row per ingested alert."""
    return df.select(
        F.lit(True).alias("accepted"), "alert_id", "tenant_id", "source",
        F.col(duplicate).alias("deduplicated"),
    )


def supported_vendors(
    spark: SparkSession, mappings: Mapping[str, Mapping[str, Sequence[str]]] = fixed.VENDOR_PATHS
) -> DataFrame:
    return spark.createDataFrame([(name,) for name in mappings], "vendor string")


__all__ = [
    "canonicalize", "cap_per_request", "check_messages", "dedup_key", "extract_paths",
    "ingest_outcomes", "map_severity", "normalize_alerts", "normalize_vendor",
    "parse_alert_ts", "require_tenant", "resolve_envelope", "supported_vendors", "truthy_text",
]
