"""Removal of long repeated byte strings, found with suffix arrays.

Every byte that lies in a string of `size` bytes which also starts somewhere else in the corpus goes. All places are
covered, and memory is bounded:

1. A window of `size` bytes is dealt by its minimizer, the least hash of its `GRAM`-byte strings (the leftmost of equal
   ones). Neighbouring windows mostly share it, so they travel as one region, and equal windows have equal minimizers at
   equal distances: they meet. Regions whose minimizer occurs nowhere else have no repeated window and end here.
2. A task takes the regions of its minimizers in portions, equal regions once. They are cut into 16-byte blocks counted
   from the minimizer, so equal windows have equal blocks at equal places, and the suffix array over the blocks is made
   by linear grouping (suffix_array.py). Neighbours in it give the longest matches; a window that starts e bytes before a
   block is repeated if a suffix of its run of neighbours with `size` - e equal bytes has the same e bytes before it.
3. Repeated windows become spans, which are merged per document and cut out of its text.

A minimizer with more than `portion` regions is not held by one task (hot_spans()): equal regions become one, and if too
many are left, each is cut into quarters by how far a window starts before the minimizer. All windows of a quarter have
some bytes around the minimizer in common, more of them the narrower it is; quarters are dealt by these, until a key has
few enough regions for a suffix array. In the end a quarter is one window, and its key has one region.

Documents with equal texts (128 bits of SHA-256) are one node: if they are long enough, all their bytes go, and one of them
stands in for the others towards the rest. The suffix array's groups are emitted in linear time; its targets are put in
order by sorting, once for each group. Texts are taken as UTF-8. A null or empty text has no bytes. Texts under `size` bytes stay whole.
Repeated rows are equal texts. A row without doc_id counts like any other, its doc_id stays null. Columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, plain_text, slices, small_batches, table
from decidra.llm.suffix_array import suffix_array

GRAM, BLOCK = 64, 16
#: Bytes of regions that one suffix array is made of.
PORTION_BYTES = 1 << 20
#: Stands for a null doc_id where the texts of nodes are fetched. A row that has it as doc_id is only read once more.
NO_ID = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[2]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of `gram` bytes: sums of byte codes times powers, modulo 2^64."""
    n = len(data)
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD[0], _BACK)):
            p = np.full(max(n, 1 << 20), base)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * _powers[1][: n - gram + 1])


def window_runs(data: np.ndarray, size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same leftmost minimizer: its hash and place, the first and the last window."""
    least = gram_hashes(data, gram)
    at = np.arange(len(least), dtype=np.int32)
    width, reach = size - gram + 1, 1
    own = least

    def join(shift: int) -> None:
        nonlocal least, at
        left, right = least[: len(least) - shift], least[shift:]
        later = right < left
        least, at = np.where(later, right, left), np.where(later, at[shift:], at[: len(at) - shift])

    while 2 * reach <= width:
        join(reach)
        reach *= 2
    if width > reach:
        join(width - reach)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return own[place], place, first, last


def repeated_windows(regions: list[bytes], anchors: list[int], often: np.ndarray, size: int, block: int = BLOCK) -> list[np.ndarray]:
    """For each region, which of its windows are repeated, in it or in others; all of them where `often` (it stands for
    several equal regions). anchors: where each region's minimizer is. No two regions with one minimizer are equal."""
    lengths = np.array([len(r) for r in regions], np.int64)
    windows = lengths - size + 1
    # blocks are counted from the anchor: each region is moved to a multiple of the block, zeros in front
    lead = -np.array(anchors, np.int64) % block
    blocks = -(-(lead + lengths) // block)
    start = np.concatenate([[0], np.cumsum((blocks + 2) * block)])  # a block without bytes at each end
    data = np.zeros(start[-1], np.uint8)
    joined = np.frombuffer(b"".join(regions), np.uint8)
    begin = start[:-1] + block + lead  # of each region's bytes
    data[np.arange(len(joined)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)] = joined
    pairs = data.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    rise = np.ones(len(order), np.int64)
    rise[1:] = (ranked[1:] != ranked[:-1]).any(1)
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(rise)
    of_block = np.repeat(np.arange(len(regions)), blocks + 2)
    at_block = np.arange(len(symbol)) - np.repeat(start[:-1] // block, blocks + 2)
    symbol[(at_block == 0) | (at_block == blocks[of_block] + 1)] = 0  # what is between regions
    array = np.array(suffix_array(symbol.tolist()), np.int64)
    array = array[(at_block[array] > 0) & (at_block[array] <= blocks[of_block[array]])]
    if not len(array):
        return [np.zeros(max(0, w), bool) for w in windows.tolist()]

    end_of = begin + lengths
    rest = end_of[of_block[array]] - array * block  # bytes to the region's end
    same = np.zeros(len(array), np.int64)  # equal bytes with the suffix before, up to `size`
    alive = np.arange(1, len(array))
    for d in range(-(-size // block)):
        a, b = np.minimum(array[alive - 1] + d, len(symbol) - 1), np.minimum(array[alive] + d, len(symbol) - 1)
        equal = (symbol[a] == symbol[b]) & (symbol[a] > 0)
        same[alive[equal]] += block
        stop = ~equal
        if stop.any():
            x = pairs[a[stop]] ^ pairs[b[stop]]
            differs = np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, block) != 0
            same[alive[stop]] += np.where(differs.any(1), differs.argmax(1), block)
        alive = alive[equal]
    limit = rest.copy()
    limit[1:] = np.minimum(rest[1:], rest[:-1])
    same = np.minimum(same, limit)

    found = np.zeros(len(data) + 1, bool)
    for e in range(block):
        run = np.cumsum(same < size - e)
        window = array * block - e
        inside = (window >= begin[of_block[array]]) & (rest >= size - e)
        pick = np.flatnonzero(inside)
        if len(pick) < 1:
            continue
        before = np.zeros((len(pick), 2), np.uint64)
        for k in range(e):
            before[:, k // 8] |= data[window[pick] + k].astype(np.uint64) << np.uint64(8 * (k % 8))
        order = np.lexsort((before[:, 1], before[:, 0], run[pick]))
        key = np.column_stack([run[pick].astype(np.uint64), before])[order]
        equal = (key[1:] == key[:-1]).all(1)
        twice = np.zeros(len(pick), bool)
        twice[1:] = equal
        twice[:-1] |= equal
        found[window[pick[order[twice]]]] = True
    return [found[b : b + max(0, w)] | o for b, w, o in zip(begin.tolist(), windows.tolist(), often.tolist(), strict=True)]


def spans_of(windows: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The bytes that these windows cover, as merged (start, end)."""
    hit = np.flatnonzero(windows)
    if not len(hit):
        return []
    gap = np.flatnonzero(np.diff(hit) > size)
    return list(zip(hit[np.concatenate([[0], gap + 1])].tolist(), (hit[np.append(gap, len(hit) - 1)] + size).tolist(), strict=True))


RUNS = "least long, node binary, place int, first int, last int"
REGIONS = "least long, node binary, anchor int, firsts array<int>, hot boolean, region binary"
SPANS = "node binary, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def runs(docs: DataFrame, size: int) -> DataFrame:
    """The window runs of every text of at least `size` bytes; equal texts of a batch once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            seen = set()
            for node, text in zip(batch["node"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                least, place, first, last = window_runs(np.frombuffer(text.as_buffer(), np.uint8), size)
                for column, x in zip(out, (least.view(np.int64), node * len(least), place, first, last), strict=True):
                    column.append(x)
            if out[0]:
                nodes = b"".join(out.pop(1))
                least, *places = map(np.concatenate, out)
                node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(least), [None, pa.py_buffer(nodes)]).cast(pa.binary())
                yield pa.record_batch([pa.array(least, pa.int64()), node, *(pa.array(x, pa.int32()) for x in places)], names=["least", "node", "place", "first", "last"])

    return docs.select("node", "text").mapInArrow(find, RUNS)


def regions(chosen: DataFrame, size: int) -> DataFrame:
    """The bytes of each chosen run, with the minimizer's place in them (anchor); runs of a text with equal bytes once, with
    the places where they start. chosen: node, text, runs (structs)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            rows: list[tuple] = []
            for node, text, own in zip(batch["node"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["runs"].to_pylist(), strict=True):
                alike: dict[tuple, list[int]] = {}
                for r in own:
                    alike.setdefault((r["least"], r["place"] - r["first"], r["hot"], text[r["first"] : r["last"] + size]), []).append(r["first"])
                rows.extend((least, node, anchor, firsts, hot, region) for (least, anchor, hot, region), firsts in alike.items())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["least", "node", "anchor", "firsts", "hot", "region"])

    return chosen.select("node", "text", "runs").mapInArrow(take, REGIONS)


def repeated_spans(found: DataFrame, size: int) -> DataFrame:
    """node, spans: the repeated bytes in these regions, by suffix arrays over portions of whole minimizers.

    found: least, node, anchor, firsts, region and often (the region stands elsewhere, too)."""

    def solve(keys: list[tuple[int, int]], owners: list[dict[bytes, set[int]]], often: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        twice = np.array([o or sum(map(len, own.values())) > 1 for o, own in zip(often, owners, strict=True)], bool)
        spans: dict[bytes, list[tuple[int, int]]] = {}
        for windows, own in zip(repeated_windows(texts, [k[1] for k in keys], twice, size), owners, strict=True):
            if hit := spans_of(windows, size):
                for node, firsts in own.items():
                    spans.setdefault(node, []).extend((first + start, first + end) for first in firsts for start, end in hit)
        rows = [[{"start": a, "end": b} for a, b in merged(own)] for own in spans.values()]
        return pa.record_batch([pa.array(list(spans), pa.binary()), pa.array(rows, _SPANS)], names=["node", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple[int, int, bytes], int] = {}
        keys, owners, oftens, texts, held, current = [], [], [], [], 0, None
        for batch in batches:
            for least, node, anchor, firsts, often, region in zip(*(batch[k].to_pylist() for k in ("least", "node", "anchor", "firsts", "often", "region")), strict=True):
                if least != current and held > PORTION_BYTES:
                    yield solve(keys, owners, oftens, texts)
                    index, keys, owners, oftens, texts, held = {}, [], [], [], [], 0
                current = least
                key = (least, anchor, region)
                at = index.get(key)
                if at is None:
                    index[key] = len(texts)
                    keys.append(key[:2])
                    owners.append({node: set(firsts)})
                    oftens.append(often)
                    texts.append(region)
                    held += len(region)
                else:
                    owners[at].setdefault(node, set()).update(firsts)
                    oftens[at] |= often
        if texts:
            yield solve(keys, owners, oftens, texts)

    return found.select("least", "node", "anchor", "firsts", "often", "region").repartition("least").sortWithinPartitions("least").mapInArrow(work, SPANS)


def quarters(parts: DataFrame, size: int) -> DataFrame:
    """Each region (key, anchor, lo, hi, region, node, firsts, often) as those of its windows that start lo to hi bytes
    before the anchor, for each quarter of lo to hi; the new key holds the bytes that all windows of the quarter have."""
    step = F.ceil((F.col("hi") - F.col("lo") + 1) / 4).cast("int")
    each = parts.select("*", F.explode(F.sequence("lo", "hi", step)).alias("low"))
    each = each.withColumn("high", F.least(F.col("hi"), F.col("low") + step - 1))
    far, near = F.least("high", "anchor"), F.greatest(F.col("low"), F.col("anchor") - F.length("region") + size)
    each = each.withColumns({"far": far, "near": near}).filter("near <= far")
    each = each.withColumn("begin", F.col("anchor") - F.col("far"))
    alike = F.substring("region", F.col("anchor") - F.col("low") + 1, F.lit(size) - F.col("high") + F.col("low"))
    return each.select(
        F.xxhash64("key", "low", "high", alike).alias("key"), F.col("far").alias("anchor"), F.col("low").alias("lo"), F.col("high").alias("hi"),
        F.substring("region", F.col("begin") + 1, F.col("far") - F.col("near") + size).alias("region"), "node", F.transform("firsts", lambda f: f + F.col("begin")).alias("firsts"), "often",
    )


def hot_spans(found: DataFrame, size: int, portion: int) -> DataFrame:
    """repeated_spans() for regions of very common minimizers.

    Each turn merges equal regions, solves the keys that have at most `portion` of them, and cuts those of the others into
    quarters. A region that is repeated as a whole goes on once, for the sake of those that hold a part of it."""
    parts = found.select(F.col("least").alias("key"), "anchor", F.lit(0).alias("lo"), F.lit(size - GRAM).alias("hi"), "region", "node", "firsts", F.lit(False).alias("often"))
    spans, width = None, size - GRAM + 1
    moved = lambda start, end: F.transform("firsts", lambda f: F.struct((f + start).alias("start"), (f + end).alias("end")))
    while True:
        named = F.unhex(F.substring(F.sha2(F.concat(F.encode(F.concat_ws("|", "key", "anchor", "lo"), "utf-8"), F.col("region")), 256), 1, 32))
        parts = cut(parts.withColumns({"rid": named, "where": F.xxhash64("node", "firsts")}), "op7-hot")
        many = F.bool_or(F.col("often") | (F.size("firsts") > 1)) | (F.min("where") < F.max("where"))
        each = cut(parts.groupBy("rid", "key").agg(F.min("where").alias("chosen"), many.alias("many")), "op7-hot-regions")
        crowded = each.groupBy("key").agg(F.count("*").alias("n")).select("key", ((F.col("n") > portion) & F.lit(width > 1)).alias("crowded"))
        state = cut(parts.drop("often", "key").join(each.join(crowded, "key"), "rid"), "op7-hot-state")
        chosen = state.filter(F.col("where") == F.col("chosen"))
        single = chosen.filter("not crowded").select(F.col("key").alias("least"), F.col("rid").alias("node"), "anchor", F.array(F.lit(0)).alias("firsts"), F.col("many").alias("often"), "region")
        solved = cut(repeated_spans(single, size), "op7-hot-solved").withColumnRenamed("node", "rid")
        own = state.filter("not crowded").select("rid", "node", "firsts").join(solved, "rid").select("node", F.flatten(F.transform("spans", lambda s: moved(s["start"], s["end"]))).alias("spans"))
        whole = state.filter("crowded and many").select("node", moved(F.lit(0), F.length("region")).alias("spans"))
        spans = own.union(whole) if spans is None else spans.union(own).union(whole)
        rest = chosen.filter("crowded")
        if rest.isEmpty():
            return spans
        parts, width = quarters(rest.withColumn("often", F.col("many")), size), -(-width // 4)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, size: int = 400, portion: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, n_bytes, copies, text) of docs, and the spans (node, spans) of the nodes that have any."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    own = own.withColumns({"node": F.unhex(F.substring(F.sha2("text", 256), 1, 32)), "n_bytes": F.octet_length("text").cast("long")})
    long = own.filter(F.col("n_bytes") >= size)
    every = cut(runs(long, size), "op7-runs")
    where = F.xxhash64("node", "place")
    shared = every.groupBy("least").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    # written, so that the join reads two tables and Spark can split a very common minimizer's rows
    shared = cut(shared.select("least", (F.col("n") > portion).alias("hot")), "op7-shared")
    chosen = every.join(shared, "least")
    chosen = chosen.groupBy("node").agg(F.collect_set(F.struct("least", "place", "first", "last", "hot")).alias("runs"))
    reps = long.groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id"))
    # rows without doc_id would all stand for their text: one of each text is left, combined before the shuffle
    unnamed = long.filter("doc_id is null").groupBy("node").agg(F.first("text").alias("text")).select(F.lit(NO_ID).alias("doc_id"), "node", "text")
    texts = long.filter("doc_id is not null").select("doc_id", "node", "text").union(unnamed)
    with_text = texts.join(chosen.join(reps, "node"), ["node", "doc_id"])
    found = cut(regions(with_text, size), "op7-regions")
    spans = repeated_spans(found.filter(~F.col("hot")).withColumn("often", F.lit(False)), size).union(hot_spans(found.filter("hot"), size, portion))
    return own, spans.groupBy("node").agg(F.flatten(F.collect_list("spans")).alias("spans"))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, text string"


def suffix_dedup(docs: DataFrame, size: int = 400, portion: int = 5000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans and the text that is left, for every row of docs.

    A removed span may begin or end within a character; what is left of that is not part of the text."""
    own, spans = repeats(docs, size, portion)
    copies = cut(own.groupBy("node").agg(F.count("*").alias("copies")).filter((F.col("copies") > 1)).select("node", F.lit(True).alias("copied")), "op7-copies")
    spans = cut(spans, "op7-spans")
    state = copies.join(spans, "node", "full_outer")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, copied, found in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["copied"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                n = len(text)
                gone = [(0, n)] if copied and n >= size else merged([(s["start"], s["end"]) for s in found or ()])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                rows.append({"text": kept.decode(errors="ignore"), "doc_id": doc, "n_bytes": n, "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": a, "end": b} for a, b in gone]})
            schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return own.join(state, "node", "left").select("doc_id", "text", "copied", "spans").mapInArrow(remove, KEPT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
