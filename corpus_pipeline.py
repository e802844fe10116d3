"""A corpus pipeline of five stages over the table documents. Each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from skein.llm.common import materialise, table
from skein.llm.queries import toxicity_model


# Odd rows go through all stages: a null or empty text is never toxic, has no line to lose, is a copy of every other text
# without words, leaks nothing and gives the mix nothing; a null doc_id, lang or source is a value like any other; ties and
# repeated rows are settled by each operator, and of repeated rows the near-copy stage keeps one; an empty table gives an
# empty table; very long texts are read whole; further columns are passed on by all stages but the last.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3, by a model of the labelled ones outside the held-out fold."""
    return toxicity.accept(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that match an earlier one; n_chars follows (null for a null text)."""
    out = line_dedup.dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, candidates by SimHash with pigeonring and, beyond
    its bits, by MinHash bands, all tested by an exact Jaccard of 0.8."""
    return near_copies.first_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found again, exactly or edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, with its source's size and target."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The trained, hashed and aligned stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
