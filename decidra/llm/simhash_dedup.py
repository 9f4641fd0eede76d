"""SimHash near-dedup by exact comparison of tiles.

A text's fingerprint is the majority of each bit over the XXH64 hashes (seed 42) of its word shingles, repeats included.
Fingerprints that differ in at most `radius` bits link. Equal fingerprints are one node.

Every pair that can link is compared, none is guessed:

1. A fingerprint's cell is the number of bits set in each of its four quarters. Two fingerprints differ in at least as many
   bits as the counts of their cells differ by in sum, so only cells within the radius of each other are compared (129 of
   83521 at most, each pair of cells once); all other pairs of cells are skipped unread.
2. A cell is dealt by a hash into tiles of about `tile` fingerprints, so a cell of any size is worked by many tasks. A tile
   travels as one packed array to the tiles of the cells near it, once each.
3. A task holds one tile and streams the tiles near it past it: exclusive-or and bit counts of numpy over a block of pairs at
   a time. Of the links in a block of tiles only a spanning forest is sent on (less than one row for each fingerprint), so a
   group of near copies is not expanded into its pairs; components are the same.

What is compared grows with the square of the number of different fingerprints, about a twentieth of all pairs of them: the
method compares exactly. README gives the figures.

Texts are lower-cased in A-Z and split at `[\\x20\\x09-\\x0D]`. A text with fewer words than a shingle is one shingle;
without words (null, empty, blank) the fingerprint is zero and links like any other. Long texts are hashed in runs of
shingles. Repeated rows are equal fingerprints. A row without doc_id links like others and names no component: where no row
of a component has a doc_id, its component_id is null. Columns beyond doc_id and text are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, plain_text, slices, small_batches, table
from decidra.llm.components import components

#: Shingles whose bits are counted at once (64 bytes each).
RUN = 1 << 16
#: Pairs that are compared at once (8 bytes each).
BLOCK = 1 << 19
#: Quarters of a fingerprint: their bits are counted apart.
QUARTERS = 4
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    """The fingerprint of each text (uint64)."""
    joined = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = joined == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one space after each word
    place = np.cumsum(keep) - keep
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bounds = place[np.minimum(first, len(joined) - 1)]
    bounds[-1] = place[-1] + keep[-1]
    packed = joined[keep]
    ends = np.flatnonzero(packed == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    words = np.searchsorted(starts, bounds)  # of each text, its first word
    data, hashed = packed.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)):
        if a == b:
            continue
        size = min(n, b - a)
        total, ones = b - a - size + 1, np.zeros(64, np.int64)
        for run in range(a, a + total, RUN):
            until = min(run + RUN, a + total)
            pairs = zip(starts[run:until].tolist(), ends[run + size - 1 : until + size - 1].tolist(), strict=True)
            h = np.fromiter((hashed(data[x:y], SEED) for x, y in pairs), np.uint64, until - run)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]
    return out


def fingerprinted(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, print (its 64 bits as a long) of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            found = fingerprints(batch["text"].cast(pa.binary()).to_pylist(), n)
            yield pa.record_batch({"doc_id": batch["doc_id"], "print": pa.array(found.view(np.int64))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return own.mapInArrow(name, "doc_id long, print long")


def _cell() -> F.Column:
    """The counts of the quarters, four digits to the base of 17."""
    cell = F.lit(0)
    for k in range(QUARTERS):
        cell = cell * 17 + F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(0xFFFF))
    return cell.cast("int")


def near_cells(radius: int) -> list[tuple[int, ...]]:
    """The steps from a cell to those within the radius, one of each two opposite ones, and none to itself."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(QUARTERS):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in steps if s > (0,) * QUARTERS]


def cell_pairs(cells: DataFrame, radius: int) -> DataFrame:
    """home, cell: each pair of present cells within the radius once, a cell with itself, too; home is the smaller."""
    place = [17 ** (QUARTERS - 1 - k) for k in range(QUARTERS)]
    steps = F.array(*(F.array(*map(F.lit, s)) for s in [(0,) * QUARTERS, *near_cells(radius)]))
    reached = cells.select("cell", F.explode(steps).alias("s"))
    for k, p in enumerate(place):
        reached = reached.filter((F.floor(F.col("cell") / p) % 17 + F.col("s")[k]).between(0, 16))
    other = F.col("cell") + sum(F.col("s")[k] * p for k, p in enumerate(place))
    return reached.select(F.col("cell").alias("home"), other.cast("int").alias("cell")).join(cells.select("cell"), "cell")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(own: np.ndarray, other: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (one spanning forest) between the fingerprints of two runs of tiles; same: other is own."""
    left, right = [], []
    rows = max(1, BLOCK // max(1, len(other)))
    for at in range(0, len(own), rows):
        near = np.bitwise_count(own[at : at + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if not len(i):
            continue
        # nodes are own first, then other, unless they are the same
        base = 0 if same else len(own)
        label = forest(len(own) + len(other) * (not same), i + at, j + base)
        node = np.unique(np.concatenate([i + at, j + base]))
        node = node[label[node] != node]
        left.append(node)
        right.append(label[node])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = own if same else np.concatenate([own, other])
    return every[np.concatenate(left)].view(np.int64), every[np.concatenate(right)].view(np.int64)


def links(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """a, b: links that give the components of the different fingerprints (print)."""
    celled = prints.select("print", _cell().alias("cell"))
    # a row for each cell: 17^4 at most, whatever the input
    cells = cut(celled.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "op13-cells")
    dealt = celled.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    packed = cut(dealt.groupBy("cell", "tile").agg(F.collect_list("print").alias("prints")), "op13-tiles")
    near = cut(cell_pairs(cells, radius).join(cells.select(F.col("cell").alias("home"), F.col("tiles").alias("home_tiles")), "home"), "op13-pairs")
    # the tile of a home meets each tile of the cells near it; of its own cell, those with a number not below its own
    sent = packed.join(near, "cell").select("home", F.explode(F.sequence(F.lit(0), F.col("home_tiles") - 1)).alias("home_tile"), "cell", "tile", "prints")
    sent = sent.filter((F.col("home") != F.col("cell")) | (F.col("tile") >= F.col("home_tile")))
    first = (F.col("home") == F.col("cell")) & (F.col("tile") == F.col("home_tile"))
    order = ["home", "home_tile", F.col("first").desc()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = np.zeros(0, np.uint64), [], 0

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            starts, prints = batch["first"].to_pylist(), batch["prints"]
            at, flat = prints.offsets.to_numpy(), prints.values.to_numpy()
            for k, starts_home in enumerate(starts):
                tile_prints = flat[at[k] : at[k + 1]].view(np.uint64)
                if held and (starts_home or size + len(tile_prints) > 4 * tile):
                    yield found(*tile_links(own, np.concatenate(held), radius, False))
                    held, size = [], 0
                if starts_home:
                    own = tile_prints.copy()
                    yield found(*tile_links(own, own, radius, True))
                else:
                    held.append(tile_prints.copy())
                    size += len(tile_prints)
        if held:
            yield found(*tile_links(own, np.concatenate(held), radius, False))

    met = sent.select("home", "home_tile", first.alias("first"), "prints").repartition("home", "home_tile").sortWithinPartitions(*order)
    return met.select("first", "prints").mapInArrow(work, "a long, b long")


def simhash_dedup(docs: DataFrame, n: int = 5, radius: int = 3, tile: int = 4096) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable by links) of every row of docs."""
    small_batches(docs.sparkSession)
    own = cut(fingerprinted(docs, n), "op13-prints")
    nodes = cut(own.groupBy("print").agg(F.min("doc_id").alias("rep")), "op13-nodes")
    found = components(cut(links(nodes, radius, tile), "op13-links"), "op13-components")
    labels = nodes.join(found.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    lead = labels.join(least, "component").select("print", "component_id")
    return own.join(lead, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), n=3)
