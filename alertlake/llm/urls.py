"""URL filter: host/path rules first, then logistic regression on hashed character n-grams.

All steps are DataFrame expressions or JVM-side ML stages; no Python runs on executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import lower_ascii, materialize


class Rule(NamedTuple):
    """``verdict`` for a host, all its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


# The rules of the page filter.
PAGE_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (key, verdict) of the longest fitting rule, else null. ``rules`` is a short parameter list."""
    found = F.lit(None).cast("struct<key:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.key)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.key).alias("key"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Character n-grams of host and path, marked by the part they come from. Linear in the length."""
    def of(mark: str, text: Column) -> list[Column]:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def of_size(n: int) -> Column:
            starts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
            return F.transform(starts, lambda c, i: F.concat(F.lit(mark), c, *(F.get(chars, i + k) for k in range(1, n))))

        return [of_size(n) for n in sizes]

    return F.concat(*of("h", host), *of("p", path))


def labelled_sample(urls: DataFrame, *, url: str, label: Column, limit: int) -> DataFrame:
    """At most ``limit`` distinct (url, label) rows with a label, chosen by hash of the url.

    The bound makes the training table small whatever the input; repeated rows count once.
    """
    known = urls.select(F.col(url).alias("url"), label.cast("double").alias("label")).where("url is not null and label is not null")
    return known.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(limit)


class UrlModel:
    """Logistic regression on hashed n-grams, fitted on a small labelled table (url, label 1 = block)."""

    def __init__(self, features: int = 1 << 14, regularisation: float = 0.01, iterations: int = 50):
        self.tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features)
        self.lr = LogisticRegression(
            featuresCol="_features", labelCol="label", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_block", regParam=regularisation, maxIter=iterations)
        self.fitted = None

    def fit(self, labelled: DataFrame) -> UrlModel:
        rows = materialize(labelled.coalesce(1), "urls")
        if rows.select("label").distinct().count() == 2:
            parts = rows.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("_grams"))
            self.fitted = self.lr.fit(self.tf.transform(parts))
        elif only := rows.select("label").first():
            self.fitted = only[0]
        return self

    def blocks(self, df: DataFrame, host: str, path: str, into: str) -> DataFrame:
        """Adds ``into``: true where the model blocks. Without labels nothing is blocked."""
        if self.fitted is None or isinstance(self.fitted, float):
            return df.withColumn(into, F.lit(self.fitted == 1.0))
        scored = self.fitted.transform(self.tf.transform(df.withColumn("_grams", grams(F.col(host), F.col(path)))))
        return scored.withColumn(into, F.col("_block") == 1.0).drop("_grams", "_features", "_probability", "_raw", "_block")


def filter_urls(pages: DataFrame, *, id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = PAGE_RULES,
                labelled: DataFrame | None = None, max_labelled: int = 5000) -> DataFrame:
    """One row per input row: ``id``, host, path, rule (key or null), verdict (allow or block), by_model.

    ``labelled`` (url, label) trains the model that decides urls no rule fits. Without it the
    urls that the rules do decide are the labelled table, at most ``max_labelled`` of them.
    Null urls and urls without ``://`` have empty host and path and are judged by the model;
    repeated rows are kept; an empty input gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id).alias(id), F.col(url).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = labelled_sample(
            rows, url="_url", limit=max_labelled,
            label=F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0))
    judged = UrlModel().fit(labelled).blocks(rows, "host", "path", "_blocked")
    return judged.select(
        id, "host", "path", F.col("_rule.key").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("_rule").isNull().alias("by_model"))
