"""Corpus pipeline: quality, exact dedup, near-duplicate join, decontamination, packing.

Each stage is (name, function) and takes (spark, docs, sf_dir); its result is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

A row is told from others by a hash of its doc_id and text, not by its doc_id:
ids may be null or repeat.  Rows that repeat both are copies, of which the
first dedup keeps one.  Null texts count as empty; other columns pass as they
are; of an empty table every stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import cuckoo, decontam, packing, parity, quality
from spanveil.llm.common import scratch_path
from spanveil.llm.queries import tokenizer_path

#: A document of which less than this speaks for quality goes.
QUALITY_THRESHOLD = 0.3

_KEY = "__row_key"


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's hash as doc_id, for operators that name rows by it."""
    return docs.select(_row_key().alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it is fitted on the labels of the documents themselves.

    An empty text is scored as such.  Labels of no document, or null ones, take
    no part; without any, all documents stay.
    """
    model = quality.QualityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(docs) >= QUALITY_THRESHOLD)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, the row with the largest doc_id stays; of rows that repeat it, one.

    A null doc_id ranks below all others.  All empty and null texts are one group.
    """
    key = lambda doc_id, sha: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)
    kept = cuckoo.exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(_KEY)).distinct()
    named = docs.withColumn(_KEY, key(F.col("doc_id"), F.lower(F.hex(cuckoo.text_digest(F.col("text"))))))
    return named.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).drop(_KEY)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the row with the smallest doc_id stays, null ids last; of rows that tie, the one with the smallest hash."""
    found = parity.similar_components(_keyed(docs)).select(F.col("doc_id").alias(_KEY), "component_id")
    ids = docs.select(_row_key().alias(_KEY), F.col("doc_id").alias("__id"))
    rank = F.struct(F.col("__id").isNull(), "__id", _KEY)
    first = found.join(ids, _KEY).groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col(f"first.{_KEY}").alias(_KEY))
    return docs.withColumn(_KEY, _row_key()).join(first, _KEY, "left_semi").drop(_KEY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontam.contaminated_windows(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.withColumn(_KEY, _row_key()).join(found.select(F.col("doc_id").alias(_KEY)).distinct(), _KEY, "left_anti").drop(_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document and its place in a sequence; a document without text is its end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
