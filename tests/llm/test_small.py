"""Every operator on small hand-made tables: nulls, empty and long texts, ties, repeated rows, no rows, more columns."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("decidra.llm")
from decidra.llm import chat_format, exact_dedup, html_extract, license_scan, mixing, ngram_join, packing, quality_model, quality_rules, suffix_dedup  # noqa: E402
from decidra.llm.common import running, spread  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, tokens long, node long, domain string, component_id long"
PROSE = " ".join(f"word{i % 37}x{i}" for i in range(120))
TEXTS = [
    None, "", "  \n\t ", "one", "one two three", PROSE, PROSE, PROSE.replace(" ", "  "), PROSE + " tail", PROSE.upper(), "a b " * 30, "x", "Ein Satz.\n" * 9 + "Ende <a> | # *",
    "the same line\nthe same line\n\nthe same line", "émile " * 25, "word " * 9000,
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s1"][i % 4], None, "h", 7, 7, "d", 5) for i, t in enumerate(TEXTS)]
    return [*out, out[5], out[5], (None, "no id here " * 9, "en", "s1", None, "h", 7, 7, "d", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(rows):
    return sorted(map(repr, rows))


# --- op1


def measures(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(docs, rows, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == bag((r[0], *measures(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept <= (not r.base_failed)
    assert all(r.host_kept for r in got if r.host is None)
    assert quality_rules.quality_rules(empty).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = [(i, f"{PROSE} {i}", f"s{i % 5}") for i in range(100)]
    bad = [(200 + i, "short", "bad") for i in range(40)] + [(300, f"{PROSE} fine", "bad"), (301, f"{PROSE} alone", "tiny"), (302, "short", "tiny2")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(100)) and not got[300] and got[301]


# --- op2


def test_mixing(docs, rows, empty, spark):
    taken = mixing.mix(docs).collect()
    assert all(r.tokens == len(words(dict((x[0], x[1]) for x in rows)[r.doc_id])) for r in taken)
    assert mixing.mix(empty).count() == 0
    total = sum(len(words(r[1])) for r in rows)
    assert sum(r.tokens * r.copies for r in taken) <= total * 80 // 100


def brute_budget(tree, budget, weights, level=0):
    """tree: nested dict of capacities; fills children by weight, level by level. weights: by level."""
    if not isinstance(tree, dict):
        return budget
    own = weights[level]

    def size(t, at):
        return sum(size(x, at + 1) for k, x in t.items() if weights[at].get(k, 1)) if isinstance(t, dict) else t

    left, open_, given = budget, {k for k in tree if own.get(k, 1)}, dict.fromkeys(tree, 0)
    while open_:
        total = sum(own.get(k, 1) for k in open_)
        full = [k for k in open_ if size(tree[k], level + 1) * total <= left * own.get(k, 1)]
        if not full:
            given |= {k: left * own.get(k, 1) // total for k in open_}
            break
        k = min(full, key=lambda k: (size(tree[k], level + 1) / own.get(k, 1), k))
        given[k] = size(tree[k], level + 1)
        left -= given[k]
        open_.remove(k)
    return {k: brute_budget(tree[k], given[k], weights, level + 1) for k in tree}


NO_WEIGHTS = [{}, {"domain": {"d0": 0}}, {"language": {"en": 0}}, {"origin": {"a": 0}}, {"domain": {"d1": 0}, "language": {"de": 0}, "origin": {"b": 0}}, {"domain": {"d0": 0, "d1": 0}}]


@pytest.mark.parametrize("weights", [{"domain": {"d0": 2}, "language": {"en": 3}, "origin": {"b": 5}}, *NO_WEIGHTS])
def test_shortages_go_to_siblings_first(spark, weights):
    leaves = {"d0": {"en": {"a": 100, "b": 1000}, "de": {"a": 10}}, "d1": {"en": {"a": 50, "b": 40}, "fr": {"c": 900}}}
    rows = [(d, lang, o, n) for d, x in leaves.items() for lang, y in x.items() for o, n in y.items()]
    levels = [weights.get(k, {}) for k in mixing.LEVELS]
    for percent in (10, 77, 100):
        got = mixing.budgets(spark.createDataFrame(rows, "domain string, language string, origin string, tokens long"), percent, 1, weights).collect()
        want = brute_budget(leaves, sum(r[3] for r in rows) * percent // 100, levels)
        assert all(r.given == want[r.domain][r.language][r.origin] for r in got)
        held = sum(r[3] for r in rows if all(w.get(k, 1) for w, k in zip(levels, r)))
        assert sum(r.given for r in got) > min(held, 2100 * percent // 100) - 8


def test_a_weight_of_zero_takes_nothing(spark):
    rows = [(i, ["a b c", "", None, "d " * 40][i % 4], ["en", "de"][i % 2], f"s{i % 3}", "x", 3) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, copies int")
    got = mixing.mix(docs, 100, 1, {"language": {"en": 0}}).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[2] == "de"} and all(r.copies == 1 for r in got if r.tokens)
    assert mixing.mix(docs, 100, 1, {"language": {"en": 0, "de": 0}}).count() == 0


def test_running_sums_do_not_depend_on_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 7 as v")
    sums = lambda n: bag(running(df, ["g"], spread("id"), F.col("v"), per_bucket=n).select("id", "pos").collect())
    assert sums(10) == sums(10**6)
    places = running(df, ["g"], spread("id"), per_bucket=10).groupBy("g").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert all(r.p == list(range(len(r.p))) for r in places)


# --- op3


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact_dedup(docs, rows, empty, hot):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    got = exact_dedup.exact_dedup(docs, hot_rows=hot, salts=3).collect()
    want = [(r[0], min(groups[normal(r[1])])[3], len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows]
    assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == bag(want)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_many_copies_are_salted(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the  hot text' when id % 3 = 1 then 'the hot text' else concat('own ', id) end as text")
    got = exact_dedup.exact_dedup(df, hot_rows=100).groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("group_size").alias("g"), F.count_if("kept").alias("k"), F.countDistinct("keep_id").alias("u"), F.min("keep_id").alias("m")).collect()
    assert all(r.n == r.g and r.k == 1 and r.u == 1 for r in got) and max(got, key=lambda r: r.n).m == 0


# --- op4


def test_quality_model(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    weights = quality_model.train(docs, labels)
    got = quality_model.scored(docs, weights).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = collections.defaultdict(set)
    for parts in (1, 3, 7):
        for r in quality_model.scored(docs.repartition(parts), weights).collect():
            by_text[dict((x[0], x[1]) for x in rows)[r.doc_id]].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    assert quality_model.train(empty, labels.limit(0)) is None
    assert {r.score for r in quality_model.scored(docs, None).collect()} == {0.5}
    assert quality_model.scored(empty, weights).count() == 0


def test_quality_gradient():
    """Backpropagation against differences."""
    import numpy as np
    import pyarrow as pa

    p = {k: v.astype(np.float64) for k, v in quality_model.start(3).items()}
    text = pa.array(["some text here " * 40, "", "other"], pa.string())
    d = np.array([0.3, -0.2, 0.5])
    logit, kept = quality_model.forward(p, text)
    assert np.allclose(quality_model.logits({k: v.astype(np.float32) for k, v in p.items()}, text), logit, atol=1e-4)
    grads = quality_model.backward(p, kept, d)
    for name, at in (("w1", (3, 2)), ("w2", (1, 1)), ("w3", (4,)), ("b2", (0,)), ("emb", (ord("e"), 1))):
        step = 1e-3
        both = []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * step
            both.append(float(quality_model.forward(q, text)[0] @ d))
        assert abs((both[0] - both[1]) / (2 * step) - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


# --- op5


def brute_components(rows, n, t):
    sets = []
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r[1])]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= t * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if r[0] is None else r[0])
    return [(r[0], len(s), None if least[find(i)] == 1 << 62 else least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_ngram_join(docs, rows, empty):
    got = ngram_join.ngram_join(docs, 4, 85).collect()
    want = brute_components(rows, 4, 85)
    # an empty text is linked with nothing: it is its own component
    want = [(d, n, d if n == 0 else c) for d, n, c in want]
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(want)
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_copies(spark, rounds, monkeypatch):
    """Families of edited copies, some of whose members link only through others."""
    import random

    rng = random.Random(4)
    rows = []
    for family in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(ngram_join.near_components, "__defaults__", (rounds,))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(brute_components(rows, 4, 85))


# --- op6


def test_chat_format(spark, agree):
    turns = [(1, 0, "user", "hi <|im_end|> <\\|im_start|>"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, None, None), (2, None, "assistant", ""), (2, 5, "assistant", "<\\\\|im_end|> 한글 🙂"), (None, 0, "user", "x"), (3, 0, "user", "y" * 50_000), (1, 1, "assistant", "a")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, ids string").repartition(2)
    out = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = [t[3] or "" for t in own if t[2] == "assistant"]
        r = out[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert r.loss_chars == sum(map(len, said)) and r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r.formatted_chars == sum(24 + len(t[2] or "") + len(chat_format.escape(t[3] or "")) for t in own)
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 10)
    ids, mask, begin = chat_format.assemble(["user", "assistant"], ["a <|im_end|> b", "c"])
    assert (ids[mask] < chat_format.TURN_START).all() and begin[0] == 0 and begin[-1] == len(ids)
    turns, told = chat_format.read_back(ids, mask)
    assert turns == [("user", "a <|im_end|> b"), ("assistant", "c")] and told == ["c"]
    assert chat_format.written(ids) == "<|im_start|>user\na <\\|im_end|> b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


# --- op7


def brute_repeats(texts, size):
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("portion", [5000, 1])
def test_suffix_dedup(docs, rows, empty, portion):
    got = suffix_dedup.suffix_dedup(docs, 400, portion).collect()
    want = brute_repeats([(r[1] or "").encode() for r in rows], 400)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bag((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("portion", [5000, 3, 1])
def test_suffix_dedup_on_passages(spark, portion):
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (390, 400, 401, 900, 1700)]
    rows = [(i, text(rng.randrange(300)) + "".join(rng.choice(passages) + text(rng.randrange(40)) for _ in range(rng.randrange(4)))) for i in range(60)]
    rows += [(100, "ab" * 500), (101, "z" * 399), (102, "z" * 401)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 400, portion).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in out}
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed and (r.n_removed or r.text == dict(rows)[r.doc_id]) for r in out)
    for (i, _), want in zip(rows, brute_repeats([t.encode() for _, t in rows], 400), strict=True):
        assert got[i] == want


@pytest.mark.parametrize("portion", [5000, 1])
def test_suffix_dedup_without_ids(spark, portion):
    import random

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b, c, d, whole = (text(n) for n in (450, 600, 500, 700, 800))
    rows = [(1, text(90) + a + text(50)), (None, text(300) + a + text(80)), (None, b + text(200)), (None, text(200) + b), (2, text(600)), (None, text(600))]
    rows += [(None, whole)] * 3 + [(3, text(30) + whole[:500]), (None, c + text(70)), (4, c + text(70)), (-(1 << 63), text(20) + d), (None, d + text(9))]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 400, portion).collect()
    want = brute_repeats([t.encode() for _, t in rows], 400)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bag((r[0], *w) for r, w in zip(rows, want, strict=True))


def fewest(items, capacity):
    """The fewest sequences, by trying every placement."""
    items, best = sorted(items, reverse=True), len(items)

    def enter(i, filled):
        nonlocal best
        if len(filled) >= best:
            return
        if i == len(items):
            best = len(filled)
            return
        for j in range(len(filled)):
            if filled[j] + items[i] <= capacity and filled[j] not in filled[:j]:
                filled[j] += items[i]
                enter(i + 1, filled)
                filled[j] -= items[i]
        enter(i + 1, [*filled, items[i]])

    enter(0, [])
    return best


def test_packing_against_every_placement():
    import random

    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([7, 10, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts, least = collections.Counter(items), fewest(items, capacity)
        assert packing.lower_bound(counts, capacity) <= least == sum(t for _, t in packing.pack_counts(counts, capacity))


def test_packing_of_many_pieces_meets_its_bound():
    import random

    rng = random.Random(4)
    for low, high in ((700, 1100), (1000, 1060)):
        counts = collections.Counter(rng.randint(low, high) for _ in range(3000))
        assert sum(t for _, t in packing.pack_counts(counts, 2048)) == packing.lower_bound(counts, 2048)
    counts = {x: 10**8 for x in range(1, 2049)}
    assert sum(t for _, t in packing.pack_counts(counts, 2048)) == packing.lower_bound(counts, 2048)


def test_suffix_array():
    import random

    from decidra.llm.suffix_array import suffix_array

    rng = random.Random(1)
    for _ in range(500):
        x = [rng.randrange(rng.choice([1, 2, 4, 20])) for _ in range(rng.randrange(50))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


# --- op8


def test_html(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>three.<br><p>Four &lt;five&gt;.</article><footer>&copy; me</footer>"), (4, "u", "plain text without any tags at all, which is a sentence.")]
    got = html_extract.extract(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.text) for r in got}
    assert {(1, ""), (2, ""), (3, ""), (4, "A & B\nOne two three.\nFour <five>.")} <= by


def test_html_on_unseen_pages():
    import random

    from decidra.llm.html_blocks import blocks, vectors

    rng, wrong, n = random.Random(99), 0, 0
    weights = html_extract.train()
    for _ in range(150):
        found = blocks(html_extract.training_page(rng))
        kept = html_extract.label(weights, [vectors(found)])[0]
        wrong += sum(bool(k) != b[3] for k, b in zip(kept, found, strict=True))
        n += len(found)
    assert wrong < 0.01 * n


def test_html_of_deep_pages():
    import time

    from decidra.llm.html_blocks import PATH, blocks, vectors

    n, began = 100_000, time.perf_counter()
    found = blocks('<div class="a">x' * n)
    # the outer tags wrap the page, so their class words do not count; those of the others do
    assert len(found) == n and len({b[1] for b in found[1:]}) == 2
    v = vectors(found[:2] + found[-2:])
    assert v.shape[0] == 4 and v[:, :PATH].sum(1).tolist() == [1, 1, 2, 2]
    # stray ends and inline tags that stay open do not make blocks dearer
    assert len(blocks("<span>" * n + "</b>x" * n)) == 1
    assert len(blocks("<li><div>" + "<span>" * n + "<li>x</li>" * n)) == n
    assert time.perf_counter() - began < 60


def test_html_of_links_in_deep_markup():
    from decidra.llm.html_blocks import blocks

    assert [b[2] for b in blocks("<p><a href=x><b><i><u><em><q>all of it</a><p>none")] == [1.0, 0.0]
    # a block ends an open one of its kind, but none outside its container
    assert [b[0] for b in blocks("<ul><li>a<li>b<div><span>c<li>d</ul>e<p>f<p>g")] == ["a", "b", "c", "d", "e", "f", "g"]


# --- op9


def test_packing(docs, rows, empty):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, 256).collect()
    left = collections.Counter()
    for r in rows:
        ids = [*own.encode(r[1] or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            end = start + (((len(ids) - 1) % 256 + 1) if piece == 0 else 256)
            left[r[0], piece, start, end - start, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start:end]))] += 1
            start, piece = end, piece + 1
    assert left == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    check_sequences(got, 256)
    assert packing.pack_documents(empty).count() == 0


def check_sequences(pieces, capacity):
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_needs_few_sequences():
    import random

    rng = random.Random(2)
    for _ in range(30):
        counts = collections.Counter(min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(rng.randrange(1, 400)))
        plan = packing.pack_counts(counts, 100)
        used = collections.Counter()
        for chosen, times in plan:
            assert sum(chosen) <= 100
            for x in chosen:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in plan) <= packing.least(counts, 100) + 1
    # a perfect packing that best fit alone misses
    assert sum(t for _, t in packing.pack_counts({6: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 14)) == 2
    assert sum(t for _, t in packing.pack_counts({1: 5000, 2000: 3}, 2048)) == 6
    with pytest.raises(ValueError):
        packing.pack_counts({101: 1}, 100)


# --- op10


def test_licenses(docs, rows, empty, spark):
    own = [(100, f"{PROSE}\nLicensed under the Apache License, Version 2.0.\nmore text"), (101, "Released under the MIT License."), (102, "Licensed under the Foobaria License."), (103, PROSE), (104, None)]
    model = license_scan.fit(spark, docs)
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(own, "doc_id long, text string"), model).collect()}
    assert [got[i].licenses for i in range(100, 105)] == ["apache-2.0", "mit", "", "", ""]
    assert (got[102].n_unknown, got[103].n_license, got[104].n_paragraphs) == (1, 0, 0)
    assert license_scan.scan(docs, model).count() == len({r[0] for r in rows})
    assert license_scan.scan(empty, model).count() == 0


def test_wrapped_licenses(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    texts = [mit, bsd, gpl.format(3), gpl.format(2), "/*\n * " + mit.replace("\n", "\n * ") + "\n */\nint main(void);", f"{PROSE}\n{bsd}\n{PROSE}", mit.replace(" ", "\n")]
    texts += [gpl.split("the Free")[0], "Redistribution and use in source and binary forms, with or without\n\nriver and road", f"{mit}\n\n{gpl.format(2)}", f"{mit}\nReleased under the Apache License, Version 2.0."]
    model = license_scan.fit(spark, spark.createDataFrame([], "doc_id long, text string"))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i].licenses for i in range(len(texts))] == ["mit", "bsd", "gpl-3.0", "gpl-2.0", "mit", "bsd", "mit", "", "", "gpl-2.0,mit", "apache-2.0,mit"]
    assert [got[i].n_license for i in (0, 1, 2, 3, 7, 9, 10)] == [1, 1, 1, 1, 0, 2, 2]
    assert [got[i].n_unknown for i in (1, 2, 3, 7)] == [0, 0, 0, 1]
    assert [got[i].n_paragraphs for i in (0, 1, 8)] == [4, 2, 2]


def test_components(spark):
    import random

    from decidra.llm.components import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 1), (7, 3), (3, 7)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
