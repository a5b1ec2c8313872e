"""A corpus pipeline: quality, near-duplicates, decontamination, private data,
packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``docs``. Stages handle null and
empty texts, repeated rows and extra columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloc.llm.common import ship_package, table, written
from caseloc.llm.decontaminate import drop_contaminated
from caseloc.llm.packing import pack_documents
from caseloc.llm.pii import pseudonymize
from caseloc.llm.quality import keep_good
from caseloc.llm.simhash import drop_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weakly supervised classifier keeps."""
    ship_package(spark)
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies (SimHash fingerprints that
    differ in two bits or less, or five-word shingles with a similarity of 0.8 or
    more): the one with the smallest doc_id."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark table."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data in their texts replaced by surrogates."""
    return pseudonymize(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a text: the sequence it goes to and its place."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier, SimHash and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
