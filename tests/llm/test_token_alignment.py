"""Alignment of tokenizers against plain loops over tokens of whole texts."""

import base64
import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import entries, token_alignment, tokens  # noqa: E402


@pytest.fixture(scope="module")
def both():
    """Text -> ids and their bytes, by the public libraries on the whole text."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    ranks = {int(n): base64.b64decode(w) for w, n in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))

    def of_piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        a, b = one.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        return (a, [ranks[i] for i in a]), (b, [of_piece(i) for i in b])

    return encode


def plain(rows, both):
    groups_of, counts = [], collections.Counter()
    for _, text in rows:
        if not text:
            groups_of.append(([], [], []))
            continue
        (a, a_bytes), (b, b_bytes) = both(text)
        if not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
            groups_of.append(([], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        groups_of.append((a, b, groups))
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for (i, _), (a, b, groups) in zip(rows, groups_of):
        links = [(x, y) for p, q in groups for x in p for y in q]
        digest = hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest() if groups else ""
        yield i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), digest


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", "x ", "  x", "a  b   c", "a▁b", "▁", "<s> </s> <unk> <|endoftext|>", "<0x41>", "1234567 12.5", " x y", "émile Öl ß", "\U0001f642\U0001f642 x", "東京都庁", "ﬁ Ａ",
    "\x00a\x01", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I've", "tab\tnew\r\nline", "a" * 3000, "한국어 문장", " lead and trail  ",
]


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_edge_cases_and_both_joins(spark, both, most_pairs):
    rng = random.Random(4)
    words = ["the", "fox", "Zwolf", "unbelievably", "antidisestablish", "123", "x=1;", "über", "東京", "", " ", "\n\n", "'s", "naive,", "(a)"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [rows[-1], rows[-1], (None, "no id here"), (500, "word " * 30000)]
    wide = [(i, t, [1], [2], "x") for i, t in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, a_at array<int>, codes array<int>, row string").repartition(3)
    got = token_alignment.token_alignment(docs, most_pairs=most_pairs).select(NAMES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, both)))


def test_query_against_plain_loops(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entries.queries()["op12_token_alignment"](spark, sf).select(NAMES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, both)))


def test_no_rows(spark):
    assert token_alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_by_stretches_are_those_of_whole_texts():
    import public_tokenizers as public
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    texts = [t for t in ODD if t and "▁" not in t] + ["".join(rng.choice("ab  eth\n.1é東'") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    ids, bounds = tokens.PieceIds().encode(pa.array([" " + t for t in texts]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [pieces.encode(t) for t in texts]


def test_few_lambdas(spark):
    # each is interpreted for every element
    rows = token_alignment.aligned(spark.createDataFrame([], token_alignment.TOKENS))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") <= 12  # 19 before


def test_no_lambdas(spark):
    # 12 before: groups, links and their text are made by arrays of many texts at once
    rows = token_alignment.aligned(spark.createDataFrame([], token_alignment.TOKENS))
    assert "lambdafunction(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_many_tokens_on_both_sides():
    rng = random.Random(12)
    for size in [*range(12), 200]:
        # tokens of two or three bytes seldom end at the same byte
        ends = [[*itertools.takewhile(lambda e: e < size, itertools.accumulate(rng.choice((2, 3)) for _ in range(size))), *[size] * (size > 0)] for _ in "ab"]
        a, b = ([rng.randrange(300) for _ in x] for x in ends)
        ids_a, ends_a, ids_b, ends_b = (np.array(x, np.int64) for x in (a, ends[0], b, ends[1]))
        stop_a, stop_b = token_alignment.stops(ends_a, ends_b)
        text = token_alignment.shown(ids_a, stop_a, ids_b, stop_b, token_alignment._printed(300, 400), 300)
        upto, links = token_alignment.linked(ids_a, stop_a, ids_b, stop_b)
        shown, pairs, i, j = "", [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(c) + 1, ends[1].index(c) + 1
            shown += ",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) + ";"
            pairs += [(x << token_alignment.SHIFT) + y for x in a[i:k] for y in b[j:m]]
            i, j = k, m
        assert ("".join(text.to_pylist()), links.tolist(), upto[-1]) == (shown, pairs, len(pairs))
