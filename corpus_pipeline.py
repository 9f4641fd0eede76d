"""The corpus pipeline: five stages over `documents`, each of which works on all rows that the stage before kept.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame). All stages but the last return the columns of documents; the
last returns the packed pieces. run() writes every stage as Parquet and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.llm import exact_dedup, mixing, ngram_join, packing, quality_model
from decidra.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier (trained on the labelled rows of documents) rejects.

    Each row is judged by its whole text, however long: equal texts go or stay together, a null or empty one is scored like
    others. Without labels of both kinds every score is 0.5, and nothing is rejected. No rows give no rows."""
    weights = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if weights is None:
        return docs.select(COLUMNS)
    scored = quality_model.scored(docs, weights, keep=("text", "lang", "source", "n_chars"))
    return scored.filter(F.col("score") >= 0.7).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (of rows that even share their doc_id, one).

    Null, empty and blank texts are one group, so one of them stays; a null doc_id comes last among equals."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), "text_sha256")
    named = docs.withColumn("_sha", F.sha2(exact_dedup.normalised(), 256))
    own = named.join(kept, (F.col("_sha") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # only rows that repeat the kept one are left here; the join has put them together already
    first = Window.partitionBy("_sha").orderBy(F.length("text").desc_nulls_last(), "text", "lang", "source")
    return own.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select(COLUMNS)


def _digest() -> F.Column:
    """With doc_id, tells rows apart that are not the same document."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """As many rows of docs with a doc_id and text as kept (doc_id, _sha) has: rows that share both are alike."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_key")).groupBy("_id", "_key").agg(F.count("*").alias("_n"))
    named = docs.select(*COLUMNS, _digest().alias("_sha"))
    own = named.join(kept, (F.col("_sha") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    alike = Window.partitionBy("_key", "_id").orderBy("lang", "source", "n_chars")
    return own.withColumn("_row", F.row_number().over(alike)).filter("_row <= _n").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id, then digest of the text) of each component of near-duplicate links stays.

    Texts without words (null, empty) are linked with nothing and all stay. A null doc_id comes last. Rows that share a doc_id
    are told apart by their texts."""
    found = ngram_join.ngram_join(docs.select(*COLUMNS, _digest().alias("_sha")), carry=("_sha",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sha")).alias("k")
    leaders = found.filter("n_shingles > 0").groupBy("component").agg(first).select("k.doc_id", "k._sha")
    return _only(docs, leaders.union(found.filter("n_shingles = 0").select("doc_id", "_sha")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their leaves, none twice: 90 % of all tokens by the default weights.

    Null languages and sources are leaves of their own; texts without words cost nothing and stay; rows that share a doc_id
    count each."""
    return _only(docs, mixing.mix(docs.select(*COLUMNS, _digest().alias("_sha")), percent=90, epochs=1, carry=("_sha",)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a null or empty text is one piece, the end id. Repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: The classifier and the tokenizer have no SQL form; tests hold exact and near against brute force, quality against labels, mix
#: against its share of words, and run() against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k}")
    return docs
