"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last return
the columns of ``documents``. A null text is an empty one. Rows with a null doc_id are kept by stages that compare
documents, which they take no part in.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantarium.llm import packing, passages, pii, quality, simhash
from quantarium.llm.common import drop_stored, small_batches, split_by_ids, stored, tables_of
from quantarium.llm.tokens import vocabulary_path

#: Fixed: the columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Documented bound: pieces of text that a worker's encoder keeps; the workers of earlier stages hold memory beside it.
#: The encoder goes with its task: Spark keeps idle workers for a minute, into the next stage or run.
PIECES = 250_000


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _stage(step):
    """Tables of the stages before go when a stage begins: its input has been written by then."""

    @functools.wraps(step)
    def run_step(spark, docs, sf_dir):
        drop_stored(spark, "pipeline", docs)
        with tables_of("pipeline"), small_batches(spark):
            return step(spark, docs, sf_dir)

    return run_step


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, failing and repeated lines go."""
    kept = quality.line_quality(docs.select(*COLUMNS)).where("kept")
    return _documents(kept.withColumn("text", F.col("clean_text")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Rows with one doc_id are one document: of them, the one whose text has the smallest MD5 stays (a null text counts as
    empty; of equal ones, any). Rows with a null doc_id take no part and stay. An empty table gives an empty one.
    """
    found = simhash.near_duplicate_texts(docs.select("doc_id", "text"), similarity=0.8)
    later = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "later")
    again = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    maybe, other = split_by_ids(docs.select(*COLUMNS), later.union(again))
    rest = maybe.join(later, "doc_id", "left_anti")
    single, double = rest.join(again, "doc_id", "left_anti"), rest.join(again, "doc_id", "left_semi")
    row = F.struct(*COLUMNS)
    one = double.groupBy("doc_id").agg(F.min_by(row, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("r"))
    return single.unionByName(one.select("r.*")).unionByName(other)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too are cut out; documents left empty go."""
    return _documents(passages.cut_passages(docs.select(*COLUMNS), words=50, similarity=0.8))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    found = pii.personal_data(docs.select(*COLUMNS), keep=COLUMNS)
    return _documents(found.withColumn("text", F.col("redacted")))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids along the curve."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary_path(), width=1024, end_id=0, pieces=PIECES, keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with tables_of("pipeline"):
            docs = stored(found, name)
    return STAGES[-1][1](spark, docs, sf_dir)
