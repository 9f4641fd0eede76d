"""The registered queries against SQL or brute force, on the smallest tables."""

import zlib

import pytest

pytest.importorskip("decidra.llm")
import __spark_entry__  # noqa: E402
from decidra.llm import entries  # noqa: E402

SQL = entries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf, agree):
    agree(entries.queries()[name](spark, sf), SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))
    assert set(entries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = entries.queries()["op4_quality_model"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline_stages(spark, sf):
    """Each stage against a plain reading of what it must keep."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = p.quality(spark, docs, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality}
    known = [r.doc_id for r in docs.collect() if r.doc_id in labels]
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.9 * len(known)

    squeeze = lambda t: "".join((t or "").split())
    exact = p.exact(spark, docs, sf).collect()
    assert len(exact) == len({squeeze(r.text) for r in docs.collect()}) == len({squeeze(r.text) for r in exact})

    near = p.near(spark, docs, sf).collect()
    assert {r.doc_id for r in near} <= {r.doc_id for r in docs.collect()}
    mixed = p.mix(spark, docs, sf)
    assert mixed.columns == p.COLUMNS
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 0.8 * words(docs.collect()) < words(mixed.collect()) <= 0.9 * words(docs.collect()) + 1


def test_pipeline_against_plain_stages(spark, sf):
    """near() against brute force, and run() against the stages one by one, each from rows that lie in memory."""
    import collections

    import corpus_pipeline as p
    from test_small import brute_components, check_sequences

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda df: spark.createDataFrame(df.collect(), docs.select(p.COLUMNS).schema)
    unique = held(p.exact(spark, held(p.quality(spark, docs, sf)), sf))
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    assert rows
    # with ids that are distinct, a row stays if it names its component, or has no words
    leaders = sorted(d for d, n, c in brute_components(rows, 5, 80) if n == 0 or c == d)
    near = held(p.near(spark, unique, sf))
    assert sorted(r.doc_id for r in near.collect()) == leaders
    mixed = p.mix(spark, near, sf).collect()
    kept = {r.doc_id for r in mixed}
    assert kept and len(kept) == len(mixed) and kept <= set(leaders)

    got = p.run(spark, sf).collect()
    check_sequences(got, 2048)
    assert {r.doc_id for r in got} == kept
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert pieces == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in p.pack(spark, held(spark.createDataFrame(mixed, docs.select(p.COLUMNS).schema)), sf).collect())


def test_pipeline_on_odd_rows(spark, sf):
    """Nulls, rows that share a doc_id, repeated rows, a long text, no rows."""
    import corpus_pipeline as p

    base = [f"word{i * 7919 % 104729}" for i in range(200)]
    a, b, other = " ".join(base), " ".join(base[:190]), " ".join(reversed(base))
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(3, a), (5, b), (5, other), (5, other), (None, None), (None, ""), (None, b + " end"), (7, long), (8, long + " x"), (9, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _sha string").repartition(3)
    seen = lambda df: sorted(map(repr, ((r.doc_id, r.text) for r in df.collect())))
    assert seen(p.near(spark, docs, sf)) == sorted(map(repr, [(3, a), (5, other), (None, None), (None, ""), (7, long), (9, "")]))
    assert seen(p.exact(spark, docs, sf)) == sorted(map(repr, [(3, a), (5, b), (5, other), (None, b + " end"), (7, long), (8, long + " x"), (9, "")]))
    mixed = [(r.doc_id, r.text) for r in p.mix(spark, docs, sf).collect()]
    assert set(mixed) <= set(rows) and sum(len((t or "").split()) for _, t in mixed) <= 0.9 * sum(len((t or "").split()) for _, t in rows)
    assert p.pack(spark, docs, sf).select("doc_id", "piece").filter("piece = 0").count() == len(rows)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_the_rest_does_not_import_llm():
    import os
    import re

    import decidra

    top = os.path.dirname(decidra.__file__)
    for folder, _, names in os.walk(top):
        if os.path.relpath(folder, top).split(os.sep)[0] != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"decidra\.llm|from \.+llm", open(os.path.join(folder, n), encoding="utf-8").read()), n
