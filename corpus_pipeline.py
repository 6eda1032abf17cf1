"""A pipeline over documents: each stage works on what the one before kept, as a table in the shared folder.

A stage returns the columns of documents, the last one all but the text, with
rates. Rows with a null doc_id are kept by every stage that decides by doc_id,
and never matched; a doc_id that repeats stays or goes with all its rows, but
for near_duplicates, which keeps one. An empty table passes through all stages.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontam, line_dedup, mixing, ngram_join, quality_lm
from quarrykit.llm.store import discard, prepare, scratch, settled, table, without_ids
from quarrykit.plans.tables import written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage begins without what those before left in the driver: plans and broadcasts that Python's cycles of DataFrames still hold, and a grown heap."""

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        return work(spark, docs, sf_dir)

    return begun


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, any of the rows of their doc_id; null and blank texts are."""
    with scratch():
        judged = quality_lm.quality_classifier(docs, table(spark, sf_dir, "labels"))
        gone = settled(judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("accepted").alias("any")).where("NOT any").select("doc_id"))
    return without_ids(docs, gone).select(*DOCUMENT)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines, also of single ones; one of which nothing is left goes. n_chars follows the text."""
    prepare(spark)
    left = line_dedup.line_dedup(docs, short=True).where("n_removed = 0 OR trim(text) != ''")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by 0.8 of their five-word shingles: the one of the least doc_id, and of its rows the least."""
    prepare(spark)
    found = ngram_join.jaccard_components(docs, k=5, percent=80)
    left = without_ids(docs, found.where("component_id != doc_id").select("doc_id").distinct())
    again = settled(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left.select(*DOCUMENT)
    one = docs.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return without_ids(left, again).select(*DOCUMENT).unionByName(one.select(*DOCUMENT))


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a test item."""
    with scratch():
        found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
        gone = settled(found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct())
    return without_ids(docs, gone).select(*DOCUMENT)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate to repeat them at, without text; those of rate 0 go."""
    return mixing.mix_to_targets(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "lang", "source", "n_chars"]).where("rate > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: No SQL: the language model, the shingle join and the fit of rates aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what a stage made is deleted once the next one has read it."""
    docs = before = table(spark, sf_dir, "documents")
    for i, (_, work) in enumerate(STAGES):
        with scratch():
            docs = work(spark, docs, sf_dir)
            docs = written(docs, "stage", kept=True) if i + 1 < len(STAGES) else settled(docs)
        if i:
            discard(before)
        before = docs
    return docs
