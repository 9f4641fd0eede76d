"""Quality rules for documents and for their hosts.

Every text is measured by rules (words, symbols, repeated lines, repeated 8-word windows). Rule failures are then summed
by host, each host's failure rates are shrunk towards all hosts' by a beta prior fitted to the hosts by moments, and the
host's verdict is joined back to its documents: a host of which most documents fail takes the rest of its documents
along. A host with few rows stays near the prior, so a handful of bad pages does not condemn it.

A null text has no words, and so fails as too short. A null host has no verdict: its documents stand for themselves.
Rows that share a doc_id are measured one by one. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, plain_text, slices, small_batches, table

MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number, and the distinct values by number."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)


def repeated_words(word: np.ndarray, doc: np.ndarray, docs: int, width: int = WINDOW) -> np.ndarray:
    """For each document, the words inside `width`-word windows that it has twice or more. width: a power of 2.

    Windows are numbered by doubling (pairs of words, of pairs, ...), so equal numbers are equal words: no hashes."""
    n = len(word)
    if n < width:
        return np.zeros(docs, np.int64)
    number, reach = word, 1
    while reach < width:
        number, reach = pairs(number[: len(number) - reach], number[reach:]), 2 * reach
    at = np.flatnonzero(doc[: len(number)] == doc[width - 1 : width - 1 + len(number)])
    key = pairs(doc[at], number[at])
    again = at[np.bincount(key, minlength=1)[key] > 1] if len(at) else at
    edge = np.bincount(again, minlength=n + 1) - np.bincount(again + width, minlength=n + 1)[: n + 1]
    covered = np.cumsum(edge)[:n] > 0
    return np.bincount(doc[covered], minlength=docs)


def measured(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each of these texts (no nulls)."""
    docs = len(text)
    lines = pc.split_pattern(text, "\n")
    line, seen = codes(lines.flatten())
    of = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    with_word = pc.match_substring_regex(seen, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line] if len(line) else np.zeros(0, bool)
    line, of = line[with_word], of[with_word]
    first = np.unique(pairs(of, line), return_index=True)[1] if len(line) else np.zeros(0, np.int64)
    dup_lines = np.bincount(of, minlength=docs) - np.bincount(of[first], minlength=docs)

    parts = pc.ascii_split_whitespace(text)
    flat, doc = parts.flatten(), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    there = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(there), doc[there.to_numpy(zero_copy_only=False)]
    word, words = codes(flat)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[word] if len(word) else word
    sums = np.concatenate([[0], np.cumsum(chars)])
    ends = np.searchsorted(doc, np.arange(docs + 1))

    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + docs + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    is_symbol = np.zeros(256, np.int64)
    is_symbol[list(SYMBOLS)] = 1
    symbols = np.concatenate([[0], np.cumsum(is_symbol[data])])[at - at[0]]
    return {
        "n_words": np.diff(ends), "word_chars": np.diff(sums[ends]), "n_symbols": np.diff(symbols),
        "n_dup_lines": dup_lines, "n_repeat_words": repeated_words(word, doc, docs),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = measured(batch["text"].cast(pa.string()))
        yield pa.record_batch({"doc_id": batch["doc_id"], "host": batch["host"]} | {k: pa.array(v, pa.int64()) for k, v in found.items()})


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures of every row of docs, with its host."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), plain_text().alias("text")).mapInArrow(_measure, MEASURES)


def failures() -> dict[str, F.Column]:
    """The rules whose failures are summed by host."""
    return {
        "base": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(measures: DataFrame, most: float = 0.6, least_weight: float = 2.0) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk), host_kept: false where a shrunk rate is over `most`.

    The prior of a rule is the beta distribution with the mean and the variance of the hosts' raw rates. Its weight
    (alpha + beta) is at least least_weight, also where there are too few hosts to tell a variance."""
    rules = failures()
    sums = measures.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules.items()))
    sums = cut(sums, "op1-hosts")
    prior = sums.agg(*(x for k in rules for x in (F.avg(F.col(f"f_{k}") / F.col("n_docs")).alias(f"m_{k}"), F.var_samp(F.col(f"f_{k}") / F.col("n_docs")).alias(f"v_{k}")))).first()
    rates = {}
    for k in rules:
        mean, var = prior[f"m_{k}"] or 0.0, prior[f"v_{k}"]
        known = var is not None and var == var and var > 0 and 0 < mean < 1
        weight = max(least_weight, mean * (1 - mean) / var - 1) if known else least_weight
        rates[k] = (F.col(f"f_{k}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    kept = F.lit(True)
    for rate in rates.values():
        kept = kept & (rate <= most)
    return sums.select("host", "n_docs", *(r.alias(f"rate_{k}") for k, r in rates.items()), kept.alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every row's measures, base_failed, host_kept and kept."""
    measures = cut(document_rules(docs, host), "op1-measures")
    hosts = host_verdicts(measures).select("host", "host_kept")
    failed = measures.withColumn("base_failed", failures()["base"])
    out = failed.join(hosts, "host", "left")
    return out.withColumn("host_kept", F.coalesce("host_kept", F.lit(True))).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, array_agg(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE len(win) = 8) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > word_chars AS f_symbols, 2 * n_dup_lines > n_words AS f_lines FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f1, count(*) FILTER (f_symbols) AS f2, count(*) FILTER (f_lines) AS f3
      FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f1 / n) AS m1, var_samp(f1 / n) AS v1, avg(f2 / n) AS m2, var_samp(f2 / n) AS v2, avg(f3 / n) AS m3, var_samp(f3 / n) AS v3 FROM h),
k AS (SELECT m1, m2, m3,
             CASE WHEN v1 > 0 AND m1 > 0 AND m1 < 1 THEN greatest(2.0::DOUBLE, m1 * (1 - m1) / v1 - 1) ELSE 2.0 END AS w1,
             CASE WHEN v2 > 0 AND m2 > 0 AND m2 < 1 THEN greatest(2.0::DOUBLE, m2 * (1 - m2) / v2 - 1) ELSE 2.0 END AS w2,
             CASE WHEN v3 > 0 AND m3 > 0 AND m3 < 1 THEN greatest(2.0::DOUBLE, m3 * (1 - m3) / v3 - 1) ELSE 2.0 END AS w3 FROM p),
v AS (SELECT source, (f1 + m1 * w1) / (n + w1) <= 0.6 AND (f2 + m2 * w2) / (n + w2) <= 0.6 AND (f3 + m3 * w3) / (n + w3) <= 0.6 AS host_kept FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept
FROM b LEFT JOIN v USING (source)
"""
