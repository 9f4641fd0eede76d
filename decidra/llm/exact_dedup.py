"""Exact dedup by a content sort, in DataFrame operations only.

The normalised texts (all of `[\\x20\\x09-\\x0D]` deleted) are range-partitioned on their first characters and a hash
of the rest, so that the sampled splitters, which go through the driver, are short whatever the texts' length. Each
partition is then sorted externally on these and the whole texts, which puts equal texts side by side, and the window
compares each whole text with its neighbour. Of equal texts the one with the most code points stays, then the smallest doc_id.

A text with very many copies would fill one range. Copies are therefore counted first (map-side combined, by a 64-bit
hash, which only steers placement), and the rows of such a text get a salt as second sort key, by their place in the input, so that
rows without doc_id or with one doc_id are dealt as well: its copies form several runs whose leaders (a bounded number) are
merged afterwards. All other texts have salt 0 and are decided by the sort
alone.

Nulls count as empty, and all texts without content form one group. A null doc_id sorts after the others. Repeated rows
(the same doc_id and text) are copies like any others: one of them stays. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.llm.common import cut, plain_text, table


#: Characters of a text in the splitters.
HEAD = 32


def normalised(column: str = "text") -> F.Column:
    """The text without `[\\x20\\x09-\\x0D]`."""
    out = plain_text(column)
    for space in " \t\n\x0b\f\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, salts: int = 64, hot_rows: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    hot_rows: a text with more copies than this and more than a 1/(4 * partitions) share of all rows is salted, so at
    most 4 * partitions texts are, and the merged leaders are at most `salts` times that."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.length(plain_text()).cast("long").alias("_len"), normalised().alias("_norm"))
    base = base.withColumns({"_head": F.substring("_norm", 1, HEAD), "_hash": F.xxhash64("_norm")})
    counts = base.groupBy("_hash").agg(F.count("*").alias("_n"))
    total = docs.count()
    hot = [r["_hash"] for r in counts.filter(F.col("_n") > max(hot_rows, total // (4 * parts))).select("_hash").collect()]
    salted = base.withColumn("_salt", F.when(F.col("_hash").isin(hot), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)) + 1).otherwise(F.lit(0))) if hot else base
    place = ["_head", "_hash", *(["_salt"] if hot else [])]
    run = Window.partitionBy(*place, "_norm")
    best_first = run.orderBy(F.col("_len").desc(), F.col("doc_id").asc_nulls_last())
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = salted.repartitionByRange(*place).select(
        "doc_id", "_len", *place[2:], F.row_number().over(best_first).alias("_row"),
        F.first("doc_id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
        F.sha2("_norm", 256).alias("text_sha256"),
    )
    if not hot:
        return runs.select("doc_id", "keep_id", "group_size", (F.col("_row") == 1).alias("kept"), "text_sha256")
    runs = cut(runs, "op3-runs")
    group = Window.partitionBy("text_sha256")
    ordered = group.orderBy(F.col("_len").desc(), F.col("doc_id").asc_nulls_last())
    leaders = runs.filter((F.col("_salt") > 0) & (F.col("_row") == 1)).select(
        "text_sha256", "_salt", F.first("doc_id").over(ordered).alias("_keep"), F.sum("group_size").over(group).alias("_size"),
        (F.row_number().over(ordered) == 1).alias("_leads"),
    )
    # At most 4 * partitions * salts rows, whatever the input's size.
    joined = runs.join(F.broadcast(leaders), ["text_sha256", "_salt"], "left")
    return joined.select(
        "doc_id", F.when(F.col("_salt") > 0, F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"),
        ((F.col("_row") == 1) & F.coalesce("_leads", F.lit(True))).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY len DESC, doc_id ASC NULLS LAST)
"""
