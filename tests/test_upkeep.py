"""The registry's upkeep: every query against its SQL, outcomes, versions, streams that stop and start again."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from decidra.functions import exchange, scalars
from decidra.operators import catalog, registry, requests, reviews
from decidra.plans import upkeep
from decidra.sources.versions import UniqueViolation, VersionConflict, Versions
from decidra.streaming import feed

SQL = upkeep.oracle_sql()


@pytest.mark.parametrize("name", sorted(upkeep.queries()))
def test_query(name, spark, sf, agree):
    agree(upkeep.queries()[name](spark, sf), SQL[name])


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


REGISTRY = "id long, product_name string, origin_product_no long, source_url string, review_analysis string, created_at timestamp, updated_at timestamp"
INCOMING = "id long, product_name string, origin_product_no long, source_url string"


def test_rows_behind_a_refused_row_are_admitted(spark):
    """As one after the other would: 2 clashes with 1, so 3, which only shares a value with 2, is admitted, and so on."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, *"abcdefghij"])) for i in range(40)] + [(100, 50, "p"), (101, 50, "q"), (102, 51, "q"), (103, 51, "r"), (104, 52, "r")]
    want, taken = [], [{}, {}]
    for i, *values in rows:
        hit = min(((t[v], k) for k, (t, v) in enumerate(zip(taken, values)) if v is not None and v in t), default=None)
        want.append((i, hit[0] if hit else i, registry.KEYS[hit[1]] if hit else None))
        if not hit:
            for t, v in zip(taken, values):
                if v is not None:
                    t[v] = i
    got = registry.admitted(spark.createDataFrame(rows, "id long, origin_product_no long, source_url string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == want


def test_outcomes_of_registration(spark):
    old = datetime.datetime(2024, 1, 1)
    have = spark.createDataFrame([(1, "a", 10, "u1", "{}", old, old), (2, "b", 20, "u2", None, old, old), (3, "c", None, None, "x", old, old)], REGISTRY)
    new = spark.createDataFrame([(11, "a1", 10, "u1"), (12, "a2", 10, "n12"), (13, "z", 10, "u2"), (14, "n", 40, "n14"), (15, "m", 41, "n14"), (16, "o", 41, "n16"), (17, "p", None, None), (18, "b2", 41, "u2")], INCOMING)
    after, changes = registry.register(have, new, now())
    assert sorted(map(tuple, changes.collect())) == [
        (11, "superseded", 1, None), (12, "updated", 1, None), (13, "conflict", 2, "source_url"), (14, "created", 14, None), (15, "conflict", 14, "source_url"), (16, "created", 16, None), (17, "created", 17, None), (18, "conflict", 16, "origin_product_no"),
    ]
    rows = {r.id: r for r in after.collect()}
    assert sorted(rows) == [1, 2, 3, 14, 16, 17]
    assert (rows[1].product_name, rows[1].source_url, rows[1].review_analysis, rows[1].created_at) == ("a2", "n12", "{}", old) and rows[1].updated_at.year == 2025
    assert rows[2].updated_at == old and rows[14].created_at.year == 2025 and rows[14].review_analysis is None
    after, changes = registry.insert(have, new, now())
    assert {r.id: (r.outcome, r.registry_id) for r in changes.collect()} == {11: ("conflict", 1), 12: ("conflict", 1), 13: ("conflict", 1), 14: ("created", 14), 15: ("conflict", 14), 16: ("created", 16), 17: ("created", 17), 18: ("conflict", 2)}
    assert after.count() == 6
    empty = have.limit(0)
    assert registry.register(empty, new.limit(0), now())[1].count() == 0 and registry.register(empty, new, now())[1].filter("outcome = 'created'").count() == 4


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), unique=("id", "source_url"))
    rows = lambda *x: spark.createDataFrame(list(x), "id long, source_url string")
    assert store.latest() == 0
    one = store.commit(rows((1, "a"), (2, None), (3, None)), 0)
    two = store.commit(rows((1, "a")), one)
    with pytest.raises(VersionConflict):
        store.commit(rows((9, "z")), one)  # started from a version that is not the newest
    with pytest.raises(UniqueViolation, match="source_url"):
        store.commit(rows((1, "a"), (2, "a")), two)
    assert (store.latest(), store.read().count(), store.read(one).count()) == (2, 1, 3)
    assert not store.folder.create("versions/000000000002", "x")  # the step that decides between two writers
    # nothing of a failed commit stays
    assert len(store.folder.names("data")) == 2 and store.folder.names("drafts") == []
    store.commit(rows(), two)
    store.vacuum(keep=1)
    assert store.numbers() == [3] and len(store.folder.names("data")) == 1 and store.read().count() == 0


def test_two_writers_at_once(spark, tmp_path):
    import threading

    store = Versions(spark, str(tmp_path / "t"))
    done, failed = [], []

    def write(k):
        try:
            done.append(store.commit(spark.range(k + 1), 0))
        except VersionConflict:
            failed.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done == [1] and len(failed) == 3 and store.numbers() == [1]


# --- streams


def write_pages(spark, path, rows):
    schema = "product long, page int, status int, last boolean, contents array<struct<id:string,content:string>>"
    spark.createDataFrame(rows, schema).write.mode("append").partitionBy("page").json(path)


def full(tag, n=20):
    return [(None, f"{tag} {i}") for i in range(n)]


def run(spark, at, limit=1):
    found = feed.collected_stream(feed.review_feed(spark, f"{at}/pages", limit), most=50)
    query = found.writeStream.foreachBatch(feed.published(f"{at}/out")).option("checkpointLocation", f"{at}/state").start()
    try:
        query.processAllAvailable()
        query.processAllAvailable()  # after a restart the first answer of the source may be what is known
        return [p["sources"][0]["endOffset"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_a_feed_that_stops_between_pages(spark, tmp_path):
    first = [(1, 0, None, None, full("a")), (2, 0, None, None, full("b")), (3, 0, None, True, full("c", 3)), (4, 0, 503, None, full("d")), (5, 0, None, None, [("k", "x"), ("k", "y"), (None, "  x  z "), (None, "")])]
    write_pages(spark, f"{tmp_path}/pages", first)
    run(spark, tmp_path)
    out = lambda: spark.read.schema(f"{feed.COLLECTED}, batch int").parquet(f"{tmp_path}/out")
    assert sorted((r.product, r["count"]) for r in out().groupBy("product").count().collect()) == [("3", 3), ("5", 2)]
    second = [(1, 1, None, None, full("a2", 4)), (2, 1, 500, None, []), (3, 1, None, None, full("late"))]
    write_pages(spark, f"{tmp_path}/pages", second)
    ends = run(spark, tmp_path)  # a new query from the checkpoint: page 0 is not read again
    assert len(ends) == 1 and "2" in str(ends[0])
    got = {(r.product, r.pos): r.content for r in out().collect()}
    assert len(got) == out().count() == 3 + 2 + 24  # the failed products publish nothing, the earlier ones stay
    assert got["5", 1] == "x" and got["5", 2] == "x z"
    batch = reviews.collected(spark.createDataFrame([*first, *second], "product long, page int, status int, last boolean, contents array<struct<id:string,content:string>>"), 50)
    assert sorted((str(r.product), r.pos, r.content) for r in batch.collect()) == sorted((p, n, c) for (p, n), c in got.items())


def test_the_source_admits_a_bounded_number_of_pages(spark, tmp_path):
    write_pages(spark, f"{tmp_path}/pages", [(1, k, None, k == 4, full(f"p{k}")) for k in range(5)])
    ends = run(spark, tmp_path, limit=2)
    assert [int("".join(c for c in str(e) if c.isdigit())) for e in ends] == [2, 4, 5]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "product long, at long, message string")
    said = lambda p, t: '{"type": "reviews", "productId": "%d", "reviews": ["%s"]}' % (p, t)
    batches = [rows((1, 5, said(1, "a")), (1, 3, said(1, "b")), (2, 1, "no")), rows((1, 1, said(1, "late")), (2, 2, said(2, "c"))), rows((3, 1, said(3, "d")))]
    write = feed.first_messages_published(str(tmp_path / "out"), "reviews")
    read = lambda: sorted((r.product, r.at, tuple(r.reviews)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for k, b in enumerate(batches):
        write(b, k)
    want = [(1, 3, ("b",)), (2, 2, ("c",)), (3, 1, ("d",))]
    assert read() == want
    for k in (1, 2, 0):
        write(batches[k], k)
    assert read() == want


def test_analyses_follow_reviews_in_any_split(spark, tmp_path):
    from decidra.streaming import analysis

    rows = [("a", k, f"r{k % 7}") for k in range(12)] + [("b", 0, "  x  y "), ("b", 1, ""), ("b", 2, None), ("b", 3, "x y"), (None, 0, "nobody"), ("c", 0, " ")] + [("d", k, f"{k} " * 3) for k in range(30)]
    schema = "product string, pos int, review string"
    clean = [(p, k, " ".join(r.split())) for p, k, r in rows if p and r and r.split()]
    asked = {}
    for name, cuts in {"one": [100], "two": [3, 100], "many": [1, 2, 3, 7, 7, 9, 100]}.items():
        at, low = f"{tmp_path}/{name}", 0
        for n, cut in enumerate(cuts):
            spark.createDataFrame([r for r in rows if low <= r[1] < cut], schema).repartition(3).write.parquet(f"{at}/in/part={n}")
            low = cut
            arrived = spark.readStream.schema(schema).parquet(f"{at}/in/part=*")
            found = analysis.analyses_stream(arrived, most=20)
            found.writeStream.outputMode("update").foreachBatch(feed.published(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        once = {}
        for p, k, r in clean:
            once.setdefault((p, r), k)
        distinct = spark.createDataFrame([(p, k, r) for (p, r), k in once.items()], schema)
        want = {r.product: r.analysis for r in reviews.analyze(distinct, most=20).collect()}
        got = {r.product: (r.n, r.analysis) for r in analysis.latest(spark, f"{at}/out").collect()}
        assert {p: a for p, (_, a) in got.items()} == want and set(want) == {"a", "b", "d"}
        assert got["d"][0] == 20 and got["b"][0] == 1
        asked[name] = spark.read.parquet(f"{at}/out").groupBy("product").count().collect()
    # a is complete after pos 6, d after pos 19; b after its first review: no analysis is asked for where nothing has changed
    assert {r["product"]: r["count"] for r in asked["many"]} == {"a": 4, "b": 1, "d": 7 - 1}


def test_published_analyses_follow_reviews_in_any_split(spark, tmp_path):
    from decidra.functions.scalars import WS
    from decidra.streaming import analysis

    rows = [("a", k, f"r{k % 7}") for k in range(12)] + [("b", 0, "  x  y "), ("b", 1, ""), ("b", 2, None), ("b", 3, "x y"), (None, 0, "nobody"), ("c", 0, " \u3000\n")] + [("d", k, f"{k} " * 3) for k in range(30)]
    rows += [("e", None, "\ufefflast\u2028 of\x0ball "), ("e", 0, "first"), ("e", 2, "last of all"), ("e", 2, "\U0001f600"), ("e", 2, "\uffee"), ("e", 5, "first")]
    schema = "product string, pos int, review string"
    once = {}
    for p, k, r in rows:
        text = re.sub(f"[{WS}]+", " ", r or "").strip(" ")
        if p and text:
            once[p, text] = min(k or 0, once.get((p, text), 99))
    for name, cuts in {"one": [100], "two": [3, 100], "many": [1, 2, 3, 7, 7, 9, 100]}.items():
        at, low, seen = f"{tmp_path}/{name}", 0, []
        for n, cut in enumerate(cuts):
            spark.createDataFrame([r for r in rows if low <= (r[1] or 0) < cut], schema).repartition(3).write.parquet(f"{at}/in/part={n}")
            low = cut
            arrived = spark.readStream.schema(schema).parquet(f"{at}/in/part=*")
            query = arrived.writeStream.foreachBatch(analysis.analyses_published(f"{at}/out", most=20)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            seen += [len(p["stateOperators"]) for p in query.recentProgress]
        lists = {}
        for (p, r), k in sorted(once.items(), key=lambda x: (x[1], x[0][1])):
            lists.setdefault(p, []).append(r)
        want = {p: (len(r[:20]), reviews.stub_analyzer(p, r[:20])) for p, r in lists.items()}
        assert {r.product: (r.n, r.analysis) for r in analysis.latest(spark, f"{at}/out").collect()} == want and set(want) == {"a", "b", "d", "e"}
        assert not any(seen)
        out = spark.read.parquet(f"{at}/out")
        if name == "many":  # an analysis only where something has changed; a review is kept once
            assert {r["product"]: r["count"] for r in out.groupBy("product").count().collect()} == {"a": 4, "b": 1, "d": 7 - 1, "e": 2}
            # the second batch again, with all that came later still there
            shown = lambda: sorted(map(tuple, out.filter("batch = 1").collect()))
            before = shown()
            analysis.analyses_published(f"{at}/out", most=20)(spark.read.schema(schema).parquet(f"{at}/in/part=1"), 1)
            out = spark.read.parquet(f"{at}/out")
            assert shown() == before and before
        kept = [(r.product, x) for r in out.collect() for x in r.added]
        assert sorted(kept) == sorted((p, x) for p, r in lists.items() for x in r[:20])


def test_analyses_of_many_products_keep_no_state_store(spark, sf):
    import glob

    at = f"{spark.conf.get('spark.checkpoint.dir')}/decidra/analyses-*"
    old = set(glob.glob(at))
    upkeep.queries()["stream_analyses"](spark, sf)
    (own,) = set(glob.glob(at)) - old
    assert glob.glob(f"{own}/state/offsets/*") and not glob.glob(f"{own}/state/state/*")


# --- requests, lookups, dates


def test_guards_account_for_every_request(spark):
    texts = [None, "", "x", "[]", "{}", '{"productName": " p ", "reviews": [" a ", "", 3, "b"]}', '{"productName": "", "reviews": ["a"]}', '{"productName": "p", "reviews": "a"}', '{"productName": 3, "reviews": ["a"]}']
    rows = requests.analysis_requests(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string"), "none").collect()
    assert [r.rejected for r in rows] == ["body"] * 4 + ["productName", None, "productName", "reviews", "productName"]
    assert (rows[5].product, rows[5].category, rows[5].reviews) == ("p", "none", ["a", "b"])


def test_answers_to_requests(spark):
    asked = spark.createDataFrame([(1, 5, None), (2, 6, None), (3, 7, None), (4, None, None), (5, 5, "body")], "r int, k int, rejected string")
    rows = spark.createDataFrame([(5, "a"), (6, "b"), *[(6, "c")] * 9, (None, "d")], "no int, v string")
    got = requests.responded(asked, rows, "k", "no")
    assert got.columns == ["k", "r", "rejected", "status"] and {r.r: r.status for r in got.collect()} == {1: 200, 2: 409, 3: 404, 4: 404, 5: 400}
    assert {r.status for r in requests.responded(asked, rows.limit(0), "k", "no").collect()} == {404, 400} and requests.responded(asked.limit(0), rows, "k", "no").count() == 0


def test_weights_read_as_numbers(spark):
    texts = {None: {}, "": {}, "[1]": {}, "7": {}, "{}": {}, '{"a": 3, "b": "4.5", "c": "x", "d": null, "e": "", "f": false, "g": [1], "h": {}, "i": -2, "j": "1e2", "k": "Infinity"}': {"a": 3.0, "b": 4.5, "d": 0.0, "e": 0.0, "f": 0.0, "i": 0.0, "j": 10.0}}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exchange.coerced_weights(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == texts


def test_comparisons(spark):
    rows = spark.createDataFrame([("x", k, k % 3) for k in range(9)] + [("y", 1, 1), ("z", 3, 1), ("z", 2, 1), (None, 4, 0), (None, 5, 0)], "g string, id long, s int")
    assert {r.g: r.ids for r in catalog.compared(rows, "g", F.desc("s"), F.col("id")).collect()} == {"x": "2,5,8,1,4", "z": "2,3", None: "4,5"}


def test_lookups_assert_when_they_run(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, w string")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    good = requests.looked_up(wanted, rows((1, "x"), (2, "y"), (3, "z"), (3, "zz")), "k")
    assert sorted((r.w, r.v) for r in good.collect()) == [("a", "x"), ("b", "y"), ("c", "x")]
    with pytest.raises(Exception, match="several rows for k 1"):
        requests.looked_up(wanted, rows((1, "x"), (2, "y"), *[(1, "z")] * 50), "k").collect()
    missing = rows((1, "x"))
    with pytest.raises(Exception, match="no row for k 2"):
        requests.looked_up(wanted, missing, "k").collect()
    assert sorted((r.w, r.v) for r in requests.looked_up(wanted, missing, "k", required=False).collect()) == [("a", "x"), ("b", None), ("c", "x")]


def test_date_texts(spark):
    at = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp() * 1000)
    cases = {
        "2024": at(2024, 1, 1), "2024-03": at(2024, 3, 1), "2024-03-05": at(2024, 3, 5), " 2024-03-05T06:07Z ": at(2024, 3, 5, 6, 7), "2024-03-05 06:07:08.25+00": at(2024, 3, 5, 6, 7, 8) + 250,
        "2024-03-05T06:07:08+09:00": at(2024, 3, 4, 21, 7, 8), "2024-03-05T06:07:08-0130": at(2024, 3, 5, 7, 37, 8), "2024/3/5": at(2024, 3, 5), "2024/03/05 6:07:08": at(2024, 3, 5, 6, 7, 8), "Mar 5, 2024": at(2024, 3, 5),
        "5 Mar 2024 16:07:08": at(2024, 3, 5, 16, 7, 8), "Tue, 05 Mar 2024 06:07:08 GMT": at(2024, 3, 5, 6, 7, 8), "05 Mar 2024 06:07:08 +0200": at(2024, 3, 5, 4, 7, 8),
        "soon": None, "": None, "2024-13-01": None, "2024-02-31T00:00:00Z": None, "20240305": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.epoch_ms(F.col("t")).alias("ms")).collect()
    assert {r.t: r.ms for r in got} == cases
