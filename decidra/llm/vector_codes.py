"""Vector codes by Lloyd's rounds that are kept up to date by what has changed.

Every vector is cut into equal consecutive parts; each part position has a codebook of `entries` entries, learned in whole
numbers (floor(scale * x)), so results do not depend on the order of any sum.

The vectors' integers are written once with the last assignment of their parts. A round reads that table, assigns each part
to its nearest entry and writes the table anew. What a part adds to the running sums of its entries is known from the rounds
before: only parts whose assignment has changed send their integers, with plus to the new entry and with minus to the old
one, added up in each task before they are shuffled. The running sums and counts (a row for each component of the codebooks,
whatever the number of vectors) are the model; it is on the driver between rounds and goes to the tasks with their function.
A lost executor costs the round at most: each is a table in the shared folder, those before the last two are deleted.

Rows whose vector is null or holds a null, NaN or infinite component are left out. The first vector (smallest vec_id, nulls
last, then by its components) gives the length; rows of another length stay, with null code and error. A length that is no multiple of the
number of parts is cut as evenly as it goes. Scaled components beyond 2^27 count as 2^27, so that squared distances fit in 64
bits. Equal vec_ids are rows of their own; with fewer rows than entries the codebooks are smaller. A null label is a label.
Columns beyond vec_id, embedding and label are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, drop_older, table

#: Vectors that are compared with the codebooks at once.
RUN = 2048
LIMIT = 1 << 27


def bounds(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and the last ends."""
    return [k * length // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, books: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and part: its entry (the first of the nearest) and the squared distance. books: entries x length."""
    code = np.zeros((len(x), len(at) - 1), np.int64)
    error = np.zeros(code.shape, np.int64)
    for run in range(0, len(x), RUN):
        own = x[run : run + RUN]
        for p, (a, b) in enumerate(zip(at, at[1:])):
            far = np.zeros((len(own), len(books)), np.int64)
            for k in range(a, b):
                far += (own[:, k, None] - books[None, :, k]) ** 2
            code[run : run + RUN, p] = far.argmin(1)
            error[run : run + RUN, p] = far.min(1)
    return code, error


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, entries: int, at: list[int]) -> np.ndarray:
    """What the changed parts add to the sums (entries x length) and to the counts (entries x parts), side by side.

    old: -1 where a part had no entry."""
    length, parts = x.shape[1], len(at) - 1
    out = np.zeros((entries, length + parts), np.int64)
    for p, (a, b) in enumerate(zip(at, at[1:])):
        moved = old[:, p] != new[:, p]
        if not moved.any():
            continue
        for sign, entry in ((1, new[moved, p]), (-1, old[moved, p])):
            there = entry >= 0
            np.add.at(out[:, length + p], entry[there], sign)
            np.add.at(out[:, a:b], entry[there], sign * x[moved][there][:, a:b])
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def assigned(state: DataFrame, books: np.ndarray, at: list[int]) -> DataFrame:
    """The state with each part's entry anew; was: the entry before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = nearest(_matrix(batch["x"], at[-1]), books, at)
            yield pa.record_batch([batch["vec_id"], batch["label"], batch["x"], _lists(code, pa.int32()), batch["code"]], names=["vec_id", "label", "x", "code", "was"])

    return state.select("vec_id", "label", "x", "code").mapInArrow(work, "vec_id long, label string, x array<int>, code array<int>, was array<int>")


def moved(state: DataFrame, entries: int, at: list[int]) -> dict[int, int]:
    """Changes of the sums and counts by their place: at most a row for each of them, whatever the number of vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((entries, at[-1] + len(at) - 1), np.int64)
        for batch in batches:
            total += changes(_matrix(batch["x"], at[-1]), _matrix(batch["was"], len(at) - 1), _matrix(batch["code"], len(at) - 1), entries, at)
        place = np.flatnonzero(total)
        yield pa.record_batch({"place": pa.array(place, pa.int64()), "change": pa.array(total.ravel()[place], pa.int64())})

    sent = state.filter("code <> was").select("x", "code", "was").mapInArrow(work, "place long, change long")
    return {r["place"]: r["change"] for r in sent.groupBy("place").agg(F.sum("change").alias("change")).collect()}


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray] | None:
    """(vec_id, label, code (its parts' entries), error) of each vector, and the codebooks (entries x length). None: no vectors.

    label comes back as text."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    infinite = F.array(*(F.lit(float(x)) for x in ("nan", "inf", "-inf")))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull()) & ~F.arrays_overlap("v", infinite)
    whole = F.transform("v", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale))).cast("int"))
    own = cut(raw.filter(sound).select("vec_id", "label", whole.alias("x")), "op11-vectors")
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["x"])
    alike = own.filter(F.size("x") == length)
    start = alike.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books, at = np.array([r["x"] for r in start], np.int64).reshape(len(start), length), bounds(length, parts)
    entries = len(books)
    sums = np.zeros((entries, length + parts), np.int64)
    part_of = np.repeat(np.arange(parts), np.diff(at))
    state = alike.withColumn("code", F.array_repeat(F.lit(-1), parts))
    name = f"op11-state-{uuid.uuid4().hex}"
    for _ in range(rounds):
        state = cut(assigned(state, books, at), name)
        drop_older(name, keep=2)
        for place, change in moved(state, entries, at).items():
            sums.ravel()[place] += change
        count = sums[:, length:][:, part_of]
        books = np.where(count > 0, sums[:, :length] // np.maximum(count, 1), books)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(_matrix(batch["x"], length), books, at)
            yield pa.record_batch([batch["vec_id"], batch["label"], _lists(code, pa.int32()), pa.array(error.sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = state.select("vec_id", "label", "x").mapInArrow(last, "vec_id long, label string, code array<int>, error long")
    other = own.filter(F.size("x") != length).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def books_sha256(books: np.ndarray, parts: int) -> str:
    at = bounds(books.shape[1], parts)
    every = (str(x) for a, b in zip(at, at[1:]) for entry in books[:, a:b].tolist() for x in entry)
    return hashlib.sha256(",".join(every).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded, books = found
    coded = cut(coded, "op11-codes")
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    two = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.array_join(two, "").alias("code"), "error", "label_error", F.lit(books_sha256(books, 8)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rounds from scratch: each groups all parts by their nearest entry."""
    steps = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"p AS MATERIALIZED (SELECT n, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, (n - 1)::BIGINT AS entry, x FROM p WHERE n <= {entries})",
    ]
    near = (
        "SELECT n, part, arg_min(entry, struct_pack(d, entry)) AS entry, min(d) AS d, any_value(x) AS x FROM (SELECT p.n, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
        " FROM p JOIN b{k} b ON p.part = b.part) GROUP BY n, part"
    )
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        if k < rounds:
            # sums of whole numbers, rounded down: x - mod(x) is divided without rest
            mean = f"SELECT part, entry, list(m ORDER BY pos) AS x FROM (SELECT part, entry, pos, ((s - ((s % c) + c) % c) // c)::BIGINT AS m FROM (SELECT part, entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS c FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS pos FROM a{k}) GROUP BY part, entry, pos)) GROUP BY part, entry"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN ({mean}) m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"c AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n)")
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM (SELECT part, entry, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS x FROM b{rounds}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.sha AS codebooks_sha256 FROM v JOIN c USING (n), h"


SQL = _sql()
