"""Alignment of two tokenizers' tokens, and corpus-wide counts of linked ids.

1. Python tokenises (space and text by byte_bpe_50k, text by piece_bpe_32k, which adds the space itself) and cuts the tokens of
   many texts at once into groups by array operations: both tokenizers' tokens end at offsets into the same bytes, and a group
   ends where tokens of both end. It gives each text's groups as printed and its links, all pairs of ids across a group, as codes.
2. The text's small columns and its codes are written once.
3. A pair's count is the number of rows that hold its code, its A id's highest count is a maximum over that. Both are added up
   in each task before they are shuffled. The table of pairs is joined back to the codes: broadcast if it has at most
   `most_pairs` rows, which is counted first (some 100 bytes each in memory), else by a shuffle of both sides, with the same rows.

Texts that are null or empty, or whose bytes the pieces do not give back (those with U+2581), have no tokens: zeros and an
empty digest. A group of many tokens on both sides costs memory by its pairs of ids. Repeated rows count each, as do rows
without doc_id. Very long texts are tokenised in full; a task holds the tokens and links of TEXT_BYTES of text, or of one longer
text, at once. Columns beyond doc_id and text are ignored. No rows give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm import tokens
from decidra.llm.common import cut, lean, plain_text, slices, small_batches, table

#: A code is an A id, shifted by this, plus a B id.
SHIFT = 20
TOKENS = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<bigint>"


@functools.cache
def _printed(size_a: int, size_b: int) -> pa.Array:
    """Each A id with `,` and with `|` behind it, then each B id with `,` and with `;`."""
    return pa.array([f"{i}{mark}" for n, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(n) for mark in marks], pa.string())


def stops(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many A tokens and how many B tokens each group ends. The tokens, of texts in a row, end at these bytes."""
    ends = np.zeros(max(ends_a[-1:].tolist(), default=0) + 1, np.uint8)
    ends[ends_a] = 1
    ends[ends_b] |= 2
    return np.flatnonzero(ends[ends_a] == 3) + 1, np.flatnonzero(ends[ends_b] == 3) + 1


def shown(ids_a: np.ndarray, stop_a: np.ndarray, ids_b: np.ndarray, stop_b: np.ndarray, printed: pa.Array, size_a: int) -> pa.Array:
    """The groups as printed, a token each: a group's A tokens stand behind all groups before, its B tokens behind these."""
    words = np.empty(len(ids_a) + len(ids_b), np.int32)
    for ids, own, others, skip in ((ids_a, stop_a, np.append(0, stop_b[:-1]), 0), (ids_b, stop_b, stop_a, size_a)):
        last = np.zeros(len(ids), bool)
        last[own - 1] = True
        words[np.arange(len(ids)) + np.repeat(others[: len(own)], np.diff(own, prepend=0))] = 2 * (ids.astype(np.int32) + skip) + last
    return printed.take(pa.array(words))


def linked(ids_a: np.ndarray, stop_a: np.ndarray, ids_b: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (codes), each A token with the B tokens of its group, and how many come before each A token and in all."""
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    each = np.repeat(n_b, n_a)
    upto = np.concatenate([[0], np.cumsum(each)])
    other = np.repeat(np.repeat(stop_b - n_b, n_a) - upto[:-1], each)
    other += np.arange(len(other))
    links = np.repeat(ids_a.astype(np.int64) << SHIFT, each)
    links |= ids_b[other]
    return upto, links


def tokenised(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, the numbers of A tokens, B tokens and groups, the groups as printed and the links (a code each, ascending); zeros
    and nothing where the texts have no tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = tokens.ids(path_a), tokens.piece_ids(path_b)
        size_a = np.array([len(one.bpe.decode_single_token_bytes(i)) for i in range(one.bpe.max_token_value + 1)], np.int64)
        size_b = np.array([len(x) for x in other.bytes_of], np.int64)
        printed = _printed(len(size_a), len(size_b))
        for batch in slices(batches, most=tokens.TEXT_BYTES):
            text = pa.array([" " + t if t else "" for t in batch["text"].to_pylist()], pa.string())
            ids_b, bounds_b = other.encode(text)
            lost = np.concatenate([[0], np.cumsum(ids_b == other.pieces.unk_id())])[bounds_b]
            lost = lost[1:] > lost[:-1]
            if lost.any():
                text = pa.array(["" if x else t for t, x in zip(text.to_pylist(), lost.tolist(), strict=True)], pa.string())
                ids_b, bounds_b = other.encode(text)
            ids_a, bounds_a = one.encode(text)
            stop_a, stop_b = stops(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
            # where texts begin among the groups, the printed bytes and the links
            of_group = np.searchsorted(stop_a, bounds_a, "right")
            words = shown(ids_a, stop_a, ids_b, stop_b, printed, len(size_a))
            at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1][bounds_a + bounds_b] if len(words) else bounds_a
            data = memoryview(words.buffers()[2] or b"")
            lines = pa.array([str(data[a : b - 1], "ascii") if b > a else "" for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())
            del words, data
            upto, links = linked(ids_a, stop_a, ids_b, stop_b)
            of_link = upto[bounds_a]
            # in order within their texts
            links |= np.repeat(np.arange(batch.num_rows) << 2 * SHIFT, np.diff(of_link))
            links.sort()
            links &= (1 << 2 * SHIFT) - 1
            columns = [batch["doc_id"], *map(pa.array, map(np.diff, (bounds_a, bounds_b, of_group))), lines]
            yield pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(of_link, pa.int32()), pa.array(links))], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])
        one.forget()
        other.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return own.mapInArrow(lean(work), TOKENS)


def aligned(tokens_of: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (a code each, ascending) of each row of tokenised()."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return tokens_of.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links")


def pair_counts(rows: DataFrame) -> DataFrame:
    """code, count (rows that hold it), best (no other B id has a higher count with its A id)."""
    counts = cut(rows.select(F.explode(F.array_distinct("links")).alias("code")).groupBy("code").agg(F.count("*").alias("count")), "op12-counts")
    highest = counts.groupBy(F.shiftright("code", SHIFT).alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.shiftright("code", SHIFT)).join(highest, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_pairs: int = 1_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    small_batches(docs.sparkSession)
    rows = cut(aligned(tokenised(docs, path_a, path_b)).withColumn("row", F.monotonically_increasing_id()), "op12-rows")
    pairs = cut(pair_counts(rows), "op12-pairs")
    few = pairs.count() <= most_pairs
    each = rows.select("row", F.explode("links").alias("code"))
    joined = each.join(F.broadcast(pairs) if few else pairs.hint("merge"), "code")
    sums = joined.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    back = rows.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return back.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
