"""Corpus pipeline: documents in, training mixture out.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns the documents that go on, with the columns of ``documents``.  The
last stage returns the mixture: documents as often as drawn, numbered by
``copy``.  ``run`` applies the stages to ``documents`` and writes what each one
keeps to the shared checkpoint folder, so a lost executor repeats one stage's
tasks and not the chain.

Nulls, empty texts, repeated rows and other columns are treated as each
operator's docstring says; an empty table passes through all stages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadforge.llm import decontaminate, lines, mix, quality, simhash
from spreadforge.llm.tables import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows leave the texts; ``n_chars``
    follows the text."""
    kept = lines.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: three-word shingles, at most
    three differing bits."""
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights."""
    return mix.mixed(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]

#: the first stage is a trained classifier, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
