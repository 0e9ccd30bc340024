"""Feature tables: engineered columns, smoothed target encoding, hash encoding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import fixed
from alertlake.functions.text import SPACES, computed_once, let
from alertlake.operators.joins import BROADCAST_ROWS, SHARE, balanced_lookup
from alertlake.operators.normalize import truthy_text
from alertlake.session import materialize


# ------------------------------------------------------------ engineered columns
def timestamp_parts(df: DataFrame, *, ts: str = "Timestamp") -> DataFrame:
    """``hour_of_day``, ``day_of_week`` (Monday 0), ``month``; the source is dropped."""
    t = F.col(ts).try_cast("timestamp")
    return df.withColumns({
        "hour_of_day": F.hour(t).cast("float"),
        "day_of_week": F.weekday(t).cast("float"),
        "month": F.month(t).cast("float"),
    }).drop(ts)


def _items(c: Column, sep: str, drop_blank: bool) -> Column:
    parts = F.split(c, re.escape(sep), -1)
    if drop_blank:
        parts = F.filter(parts, lambda p: p.rlike(f"[^{SPACES}]"))
    return parts


def multi_value_stats(
    df: DataFrame, *, column: str, sep: str = ";", drop_blank: bool = False,
    flag: str = "has_mitre", count: str = "mitre_technique_count",
) -> DataFrame:
    """Presence flag and item count of a separated list; the source is dropped.

    ``drop_blank=False`` is the training form (flag = not null, ``;``),
    ``drop_blank=True`` the serving form (blank items ignored, ``,``).
    """
    c = F.col(column)
    n = F.when(F.length(c) > 0, F.size(_items(c, sep, drop_blank))).otherwise(F.lit(0))
    has = (n > 0) if drop_blank else c.isNotNull()
    return df.withColumns({count: n.cast("float"), flag: has.cast("float")}).drop(column)


def null_indicators(df: DataFrame, *, columns: Sequence[str] = fixed.SPARSE_COLUMNS) -> DataFrame:
    """``has_<column>``: neither null nor empty. Absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({
        f"has_{c}": F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("float")
        for c in present
    }) if present else df


def fill_categories(df: DataFrame, *, columns: Sequence[str] = fixed.CATEGORY_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING)) for c in present
    }) if present else df


def encode_label(label: Column) -> Column:
    """Grade text -> 0, 1, 2; anything else -> null."""
    pairs = [part for i, g in enumerate(fixed.GRADES) for part in (F.lit(g), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), label)


def engineer_features(
    df: DataFrame, *, drop: Sequence[str] = fixed.IDENTIFIER_COLUMNS, ts: str = "Timestamp",
    multi_value: str = "MitreTechniques", sep: str = ";",
    indicators: Sequence[str] = fixed.SPARSE_COLUMNS,
    categories: Sequence[str] = fixed.CATEGORY_COLUMNS,
) -> DataFrame:
    """All engineered columns in one narrow projection."""
    out = df.drop(*[c for c in drop if c in df.columns])
    if ts in out.columns:
        out = timestamp_parts(out, ts=ts)
    if multi_value in out.columns:
        out = multi_value_stats(out, column=multi_value, sep=sep)
    return fill_categories(null_indicators(out, columns=indicators), columns=categories)


# --------------------------------------------------------------- target encoding
TINY = 16  # categories that fit a literal map


def fit_target_encoder(
    df: DataFrame, *, cols: Sequence[str], label: str, min_samples_leaf: int = 1,
    smoothing: float = 1.0, singleton_to_prior: bool = True,
) -> DataFrame:
    """``(column, category, n, enc, prior)`` for a numeric label.

    ``w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))`` and
    ``enc = prior * (1 - w) + mean * w``. With ``singleton_to_prior`` a category
    seen once gets the prior, as some releases of the published encoder do.

    One scan for all columns: the unpivoted rows are combined before the shuffle,
    so only distinct (column, category) pairs travel. They are written out, as
    the prior is read off the same table.
    """
    long = df.filter(F.col(label).isNotNull()).select(label, *[F.col(c).cast("string").alias(c) for c in cols])
    stats = materialize(
        long.unpivot([label], list(cols), "column", "category")
        .groupBy("column", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("total")),
        "encoder-stats",
    )
    prior = stats.filter(F.col("column") == cols[0]).agg(F.sum("total") / F.sum("n")).scalar()
    weight = 1 / (1 + F.exp(-(F.col("n") - min_samples_leaf) / F.lit(float(smoothing))))
    enc = F.col("prior") * (1 - weight) + F.col("total") / F.col("n") * weight
    if singleton_to_prior:
        enc = F.when(F.col("n") == 1, F.col("prior")).otherwise(enc)
    return (
        stats.filter(F.col("category").isNotNull())
        .withColumn("prior", prior)
        .select("column", "category", "n", enc.alias("enc"), "prior")
    )


def _frequent(df: DataFrame, cols: Sequence[str], k: int = SHARE) -> DataFrame:
    """(column, category): about the ``k`` most frequent values of each column, found in one pass."""
    tops = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).agg(
        *[F.expr(f"approx_top_k(`{c}`, {k}, {20 * k})").alias(c) for c in cols])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.transform(c, lambda t: t["item"]).alias("items")) for c in cols])
    return tops.select(F.explode(each).alias("e")).select("e.column", F.explode("e.items").alias("category")).filter(
        F.col("category").isNotNull())


def apply_target_encoder(
    df: DataFrame, enc: DataFrame, *, cols: Sequence[str], id: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace categories by their encoding; unknown and missing become the prior.

    The categories per column are counted first: at most ``TINY`` become a literal
    map, up to ``broadcast_rows`` are broadcast. Columns with more
    share one shuffle: their values are unpivoted, looked up with heavy categories
    broadcast, and pivoted back on the unique ``id``; without an ``id`` each such
    column is looked up in turn.
    """
    sizes = {
        r["column"]: r["count"]
        for r in enc.filter(F.col("column").isin(*cols)).groupBy("column").count().collect()
    }
    small = [c for c in cols if sizes.get(c, 0) <= broadcast_rows]
    large = [c for c in cols if c not in small]
    tiny: dict[str, list[Column]] = {c: [] for c in small if sizes.get(c, 0) <= min(TINY, broadcast_rows)}
    for r in enc.filter(F.col("column").isin(*tiny)).collect() if tiny else []:
        tiny[r["column"]] += [F.lit(r["category"]), F.lit(r["enc"])]
    prior = enc.agg(F.max("prior")).scalar()
    out = df
    for c, pairs in tiny.items():
        known = F.try_element_at(F.create_map(*pairs), F.col(c).cast("string")) if pairs else F.lit(None).cast("double")
        out = out.withColumn(f"_e_{c}", known)
    for c in [c for c in small if c not in tiny]:
        part = enc.filter(F.col("column") == c).select(
            F.col("category").alias(f"_k_{c}"), F.col("enc").alias(f"_e_{c}"))
        out = out.join(F.broadcast(part), F.col(c).cast("string") == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")
    if large:
        wanted = enc.filter(F.col("column").isin(*large)).select("column", "category", F.col("enc").alias("_e"))
        # Frequent values of these rows, unseen ones included, are answered by broadcast; so is null.
        heavy = _frequent(out, large).join(wanted, ["column", "category"], "left").unionByName(
            df.sparkSession.createDataFrame([(c, None, None) for c in large], "column string, category string, _e double"))
        light = wanted
        if id is not None:
            long = out.select(id, *[F.col(c).cast("string").alias(c) for c in large]).unpivot(
                [id], large, "column", "category").filter(F.col("category").isNotNull())
            looked = balanced_lookup(long, heavy=heavy, light=light, keys=["column", "category"], value="_e")
            wide = looked.groupBy(F.col(id).alias("_id")).pivot("column", large).agg(F.max("_e"))
            wide = wide.select("_id", *[F.col(c).alias(f"_e_{c}") for c in large])
            out = out.join(wide, out[id] == wide["_id"], "left").drop("_id")
        else:
            for c in large:
                only = F.col("column") == c
                out = balanced_lookup(
                    out, heavy=heavy.filter(only).select(F.col("category").alias(c), F.col("_e").alias(f"_e_{c}")),
                    light=light.filter(only).select(F.col("category").alias(c), F.col("_e").alias(f"_e_{c}")),
                    keys=[c], value=f"_e_{c}")
    filled = out.withColumn("_prior", prior)
    return filled.withColumns({c: F.coalesce(F.col(f"_e_{c}"), F.col("_prior")) for c in cols}).drop(
        *[f"_e_{c}" for c in cols], "_prior")


def hash_encode(
    df: DataFrame, *, cols: Sequence[str],
    ordinal: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """First 32 bits of ``md5("position:value")`` scaled to 0..1; missing -> 0.

    ``ordinal`` gives columns whose known values map to fixed numbers instead.
    """
    ordinal = {"SuspicionLevel": fixed.SUSPICION_ORDINAL} if ordinal is None else ordinal

    def encode(seed: int, name: str) -> Column:
        c = F.col(name).cast("string")
        digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 8)
        hashed = F.conv(digest, 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
        value = F.when(c.isNull() | c.isin("", fixed.MISSING), F.lit(0.0)).otherwise(hashed)
        if name in ordinal:
            pairs = [part for k, v in ordinal[name].items() for part in (F.lit(k), F.lit(float(v)))]
            value = F.coalesce(F.try_element_at(F.create_map(*pairs), c), value)
        return value

    return df.withColumns({c: encode(i, c) for i, c in enumerate(cols)})


# ------------------------------------------------------- canonical alert -> vector
def snake(name: str) -> str:
    return "".join(f"_{ch}" if ch.isupper() and i else ch for i, ch in enumerate(name)).lower()


def resolve_features(alerts: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical alerts -> 12 numeric features and 37 category texts.

    A category is taken from the raw payload, then from a canonical column of the
    same name, then from aliases, then from nested vendor paths.
    """
    parsed = computed_once(alerts, "_m", F.from_json("raw_data", "map<string,variant>"))
    columns = set(alerts.columns)

    def raw(name: str) -> Column:
        return F.try_element_at(F.col("_m"), F.lit(name))

    def listed(v: Column) -> Column:
        return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ", "),
                          F.try_variant_get(v, "$", "string"))

    def canonical(name: str) -> list[Column]:
        names = dict.fromkeys([name.lower(), snake(name)])
        return [F.nullif(F.col(n), F.lit("")) for n in names if n in columns]

    def direct(name: str) -> Column:
        from_raw = let(raw(name), lambda v: F.when(truthy_text(v).isNotNull(), listed(v)))
        return F.coalesce(from_raw, *canonical(name))

    def nested(path: Sequence[str]) -> Column:
        inner = "$" + "".join(f'["{k}"]' for k in path[1:])
        return listed(F.try_variant_get(raw(path[0]), inner, "variant"))

    def category(name: str) -> Column:
        options = [F.col(f"_direct_{name}") if name in fixed.SPARSE_COLUMNS else direct(name)]
        options += [F.col(a) for a in fixed.CANONICAL_ALIASES.get(name, ()) if a in columns]
        options += [nested(p) for p in fixed.RAW_ALIASES.get(name, ())]
        return F.coalesce(F.nullif(F.coalesce(*options), F.lit("")), F.lit(fixed.MISSING))

    staged = parsed.withColumns({f"_direct_{c}": direct(c) for c in fixed.SPARSE_COLUMNS}).withColumn(
        "_techniques",
        F.coalesce(F.nullif(F.col("mitre_technique"), F.lit("")),
                   F.try_variant_get(raw("MitreTechniques"), "$", "string")))
    staged = multi_value_stats(staged, column="_techniques", sep=",", drop_blank=True)
    t = F.col("timestamp").cast("timestamp")
    numeric = {
        "hour_of_day": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t),
        "has_mitre": F.col("has_mitre"), "mitre_technique_count": F.col("mitre_technique_count"),
        **{f"has_{c}": F.col(f"_direct_{c}").isNotNull() for c in fixed.SPARSE_COLUMNS},
    }
    return staged.select(
        *keep, *[numeric[n].cast("float").alias(n) for n in fixed.NUMERIC_FEATURES],
        *[category(n).alias(n) for n in fixed.CATEGORY_COLUMNS],
    )


def assemble_features(
    df: DataFrame, *, keep: Sequence[str] = (), features: Sequence[str] = fixed.FEATURES,
    vector: str | None = None,
) -> DataFrame:
    """Features in their fixed order as floats; ``vector`` adds an ML vector column."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"feature columns absent: {absent}")
    out = df.select(*keep, *[F.col(f).cast("float").alias(f) for f in features])
    if vector:
        return VectorAssembler(inputCols=list(features), outputCol=vector, handleInvalid="keep").transform(out)
    return out


def profile_dataset(df: DataFrame, *, label: str, categories: Sequence[str]) -> DataFrame:
    """Rows per class with the shape of the feature table."""
    n_features = len([c for c in df.columns if c != label])
    n_cat = len([c for c in df.columns if c in set(categories)])
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col(label).alias("class"), "rows", F.lit(n_features).alias("n_features"),
        F.lit(n_cat).alias("n_categorical"), F.lit(n_features - n_cat).alias("n_numeric"))
