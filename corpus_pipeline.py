"""The corpus pipeline: quality classifier, line dedup, near-duplicate join, decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the columns of `documents`.

Defined results of every stage: a null text is an empty one and stays null where its document stays; a null id is an id
of its own, and rows that repeat an id share its fate; ties are settled by the operators' own rules (the smallest id of
a group of near copies, the largest id that holds a line); columns of any name besides `doc_id` and `text` are carried
unchanged, `n_chars` following the text where lines go; empty tables give empty results, and without labels or
benchmark nothing is rejected for quality or leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from kinloom.llm.common import fresh, parted, staged


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go; its labels are those of the table `labels`."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    column = fresh(docs, "score")
    return quality.score(docs, forest, score_col=column).filter(F.col(column) >= 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in five documents or more stay in the document with the largest id only."""
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone (gone_id); only rows that a bitmap of hashes holds for possible are shuffled."""
    gone = staged(gone.distinct(), "gone")
    near, rest = parted(docs, F.xxhash64("doc_id"), gone.select(F.xxhash64("gone_id").alias("x")))
    column = fresh(docs, "gone_id")
    ids = gone.select(F.col("gone_id").alias(column))
    return near.join(ids, F.col("doc_id").eqNullSafe(F.col(column)), "left_anti").unionByName(rest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of Jaccard 0.8 or more over five-word shingles, the one with the smallest id stays."""
    of = ngram_join.ngram_components(docs, size=5, percent=80)
    stays = of.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return _without(docs, stays.filter("not stays").select(F.col("doc_id").alias("gone_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark` go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated").select(F.col("doc_id").alias("gone_id")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL can express the classifier, the decontamination or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
