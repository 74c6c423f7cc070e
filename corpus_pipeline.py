"""The corpus pipeline: language, exact copies, near copies, contamination, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents; all but the last keep the
columns of ``documents``. Between stages the rows are a Parquet table.

Decisions go by row: a row that repeats a ``doc_id`` with another text is judged by its own text,
except that near copies of one of a document's texts count for all of them. Rows without a ``doc_id``
pass the three stages that compare documents. Null or empty texts have no letters, so the first stage drops
them. Other columns than those of ``documents`` are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from tidemark.llm.work import materialize
from tidemark.scratch import importable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (undecided, or no letters) go."""
    dictionaries = language_id.fit(docs)
    return language_id.classify(docs.select(*COLUMNS), dictionaries).filter(~F.col("rejected")).select(*COLUMNS)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` but for the rows found, told by ``doc_id`` and ``sum``, a hash of the text."""
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"))
    return keyed.join(found.select("doc_id", "sum").distinct(), ["doc_id", "sum"], "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    decided = exact_dedup.exact_dedup(docs)
    gone = decided.filter("not kept and doc_id is not null").select("doc_id", "digest").distinct()
    keyed = docs.select(*COLUMNS, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return keyed.join(gone, ["doc_id", "digest"], "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays."""
    return _without(docs, jaccard_join.jaccard_join(docs).filter("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words inside benchmark windows go."""
    return _without(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights, in global random order."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The first stage compresses texts, which SQL can't express; tests hold the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
