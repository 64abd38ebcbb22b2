"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and but for the last returns the columns of ``documents``, and others that docs has besides.
Null ids stay; rows that share an id but not the text are judged each by its own text, except that of near
copies one row an id stays, that of the least text by hash.  An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkrig.llm import decontaminate, kn_classifier, ngram_join, packing, suffix_dedup
from fieldkrig.llm.common import small_side, table, unused, written
from fieldkrig.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and those without text, which have no perplexity.  Rows that repeat are judged alike."""
    return kn_classifier.filter_quality(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows without an id or without words stay."""
    groups = ngram_join.jaccard_components(docs)
    (own,) = unused(docs, "_id")
    gone = written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct(), "near_copies")
    kept = docs.join(small_side(gone, 2_000_000), F.col("doc_id") == F.col(own), "left_anti")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if not repeated.isEmpty():  # rows that share an id: one stays
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in kept.columns]), F.struct(F.xxhash64("text"), "text"))
        own = kept.filter("doc_id is not null").groupBy(F.col("doc_id").alias(unused(docs, "_key")[0])).agg(first.alias("_first")).select("_first.*")
        kept = own.unionByName(kept.filter("doc_id is null"))
    return kept.select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a document of which nothing is left goes, one that was empty before stays."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True)
    left = cut.filter((F.col("n_bytes") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go; those without text stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, packed into sequences; one row per piece.  Null or empty text is the end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", pack),
]

#: Tokenisation and the model of the classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
