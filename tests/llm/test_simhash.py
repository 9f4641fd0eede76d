"""SimHash near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("decidra.llm")
from decidra.llm import entries, simhash_dedup  # noqa: E402


def plain_print(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def plain_components(prints, ids, radius):
    """By row, the smallest id reachable, from all pairs."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                up[top(a)] = top(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [least.get(top(k)) for k in range(len(prints))]


def check(got, rows, n, radius=3):
    prints = [plain_print(t, n) for _, t in rows]
    want = zip((i for i, _ in rows), (f"{p:016x}" for p in prints), plain_components(prints, [i for i, _ in rows], radius), strict=True)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(entries.queries()["op13_simhash_dedup"](spark, sf).collect(), rows, 3)


@pytest.mark.parametrize("tile", [4096, 8])
def test_near_copies_and_edge_cases(spark, tile):
    rng = random.Random(5)
    rows = [(None, "no id " * 9), (1, None), (2, ""), (3, " \n\t\x0b"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Émile Ö É ß"), (8, "émile ö é ß"), (9, "a\x85b c\xa0d e"), (1, None)]
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 90, 400]))]
        for k in range(12):
            own = list(base)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((100 + 20 * g + k if k % 5 else None, rng.choice([" ", "\n", "  "]).join(own)))
    rows.append((900, " ".join(f"v{i % 977}" for i in range(90000))))  # more than one run of shingles
    rows.append((901, rows[-1][1] + " tail"))
    wide = [(i, t, "x", 3, 4, 5) for i, t in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, print string, cell long, home int, component_id int").repartition(3)
    got = simhash_dedup.simhash_dedup(docs, n=3, tile=tile).collect()
    check(got, rows, 3)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})  # there are links between different prints


def test_no_rows(spark):
    assert simhash_dedup.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_tiles_and_cells_lose_no_link(radius, spark):
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 63, 40, np.uint64)
    prints = [0, (1 << 64) - 1]
    for c in core.tolist():
        for _ in range(15):
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                c ^= 1 << b
            prints.append(c)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = simhash_dedup.links(spark.createDataFrame(signed, "print long"), radius, 16).collect()
    at = {p[0]: k for k, p in enumerate(signed)}
    labels = simhash_dedup.forest(len(prints), np.array([at[r.a] for r in got], int), np.array([at[r.b] for r in got], int))
    assert labels.tolist() == plain_components(prints, list(range(len(prints))), radius)


def test_cells_within_the_radius():
    assert 2 * len(simhash_dedup.near_cells(3)) + 1 == 129
    assert simhash_dedup.near_cells(0) == []
