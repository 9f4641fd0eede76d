"""Delta-maintained codebooks against rounds that start from scratch."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import vector_codes as vc  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, error double"


def plain(rows, parts=8, entries=16, rounds=6):
    """vec_id -> (code, error), the codebooks, in plain whole numbers."""
    whole = [(i, [int(np.floor(4096 * np.float64(np.float32(c)))) for c in v]) for i, v, _ in rows]
    length = len(whole[0][1])
    at = [k * length // parts for k in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(at, at[1:])] for _, v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        own = [[near(p, c[p])[0] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [c[p] for c, o in zip(cut, own) if o[p] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = {}
    for (i, _), c in zip(whole, cut):
        found = [near(p, c[p]) for p in range(parts)]
        out[i] = ([k for k, _ in found], sum(d for _, d in found))
    return out, books


def check(spark, rows, parts=8, entries=16, rounds=6):
    docs = spark.createDataFrame([(*r, "c", 1, 0.5) for r in rows], SCHEMA).repartition(3)
    coded, books = vc.vector_codes(docs, parts, entries, rounds)
    sound = sorted((r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])), key=lambda r: r[0])
    want, want_books = plain(sound, parts, entries, rounds)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert got == want
    length = len(sound[0][1])
    for p in range(parts):
        a, b = p * length // parts, (p + 1) * length // parts
        assert books[:, a:b].tolist() == want_books[p]
    return books, want_books


def test_rounds_against_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(400 + i, rows[3][1], None) for i in range(150)]  # a hot vector
    rows += [(600, None, 1), (601, [None] + [0.5] * 15, 1), (602, [float("nan")] * 16, 1), (603, [float("inf")] + [0.0] * 15, 2), (604, [float("-inf")] + [0.0] * 15, None)]
    books, want = check(spark, rows)
    flat = ",".join(str(x) for part in want for entry in part for x in entry)
    assert vc.books_sha256(books, 8) == hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("length, parts, entries, rounds", [(8, 8, 16, 6), (10, 4, 3, 2), (1, 2, 2, 0), (64, 8, 16, 1)])
def test_ties_few_rows_and_uneven_parts(spark, length, parts, entries, rounds):
    rng = np.random.default_rng(length)
    rows = [(i, (rng.integers(-2, 3, length) / 4).astype(np.float32).tolist(), 0) for i in range(12)] + [(50 + i, [0.25] * length, 0) for i in range(4)]
    check(spark, rows, parts, entries, rounds)


def test_other_lengths_large_components_and_no_rows(spark):
    docs = spark.createDataFrame([(5, [0.0] * 8, 1, "c", 1, 0.5), (6, [1.0] * 9, 1, "c", 1, 0.5), (None, [3e38] * 8, 1, "c", 1, 0.5), (7, [], 1, "c", 1, 0.5), (5, [0.0] * 8, None, "c", 1, 0.5)], SCHEMA)
    coded, books = vc.vector_codes(docs)
    got = sorted(map(repr, ((r.vec_id, r.code and len(r.code), r.error) for r in coded.collect())))
    assert got == sorted(map(repr, [(5, 8, 0), (5, 8, 0), (6, None, None), (7, None, None), (None, 8, 0)]))
    assert len(books) == 3 and books.max() == vc.LIMIT
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)) is None
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1, "c", 1, 0.5)], SCHEMA)) is None


def test_only_changed_parts_are_sent():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (50, 12))
    old, new = rng.integers(-1, 4, (2, 50, 3))
    new = np.abs(new)
    at = vc.bounds(12, 3)
    sums = lambda code: vc.changes(x, np.full_like(code, -1), code, 4, at)
    first = np.maximum(old, 0)
    assert (sums(first) + vc.changes(x, first, new, 4, at) == sums(new)).all()
    assert not vc.changes(x, new, new, 4, at).any()
