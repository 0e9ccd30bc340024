"""From raw documents to a training mix: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm import decontaminate, mixing, paragraphs, simhash, toxicity
from alertlake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores below its threshold.

    Null and empty texts score alike, as repeated rows do; without labels no document goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours: the one with the least id.

    Null, empty and blank texts are one group. Of rows with the same id the least text hash stays, of equal rows one.
    """
    return simhash.drop_near_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows.

    Null, empty and blank texts stay as they are; a text of which nothing is left goes. Rows that agree in id and
    text are one document, a null id is later than all others.
    """
    return paragraphs.remove_passages(docs, size="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item.

    Null, empty and blank texts have no words and stay, as all documents do without items; repeated rows fare alike.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with how often each is taken (copies) and how many words that is (taken).

    Columns of these two names are replaced. Texts without words are never taken; repeated rows are documents
    of their own; a null source is a source.
    """
    docs, number = docs.drop("copies", "taken"), "_row"
    while number in docs.columns:
        number += "_"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    mixed = mixing.mix_sources(rows, keep=(number,)).where("copies > 0").select(number, "copies", "taken")
    return rows.join(mixed, number).drop(number)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# Toxicity has no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
