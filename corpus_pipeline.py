"""A corpus pipeline: each stage is one operator of ``tallyloom.llm`` over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tallyloom.llm._common import forget, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the prior is the share of toxic texts among the labelled ones."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, labels, prior=toxicity.labelled_share(labels)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that 3 documents hold stay in one of them; ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays."""
    return ngram_join.keep_one_per_component(docs, k=5, percent=80).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order in which to read them, with their texts: every source at least once, small ones up to twice."""
    return mixing.mix_sources(docs, max_repetition=2.0, keep=("text", "lang", "n_chars"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can neither train the toxicity model nor follow links to components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reading: the document as the stages left it, and its place in the order."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
