"""N-gram Jaccard self join with vertical partitioning.

Documents are sets of distinct word n-grams (64-bit hashes). Documents with equal sets form one class, and classes are
joined by their smallest doc_id. The n-grams get one global order, rare ones first. The order is cut into fragments;
a document's n-grams of one fragment are a segment; the overlap of two documents is counted segment by segment, each
fragment for itself, and the partial counts are summed per pair.

Which pairs are counted follows from prefixes, without loss. Two sets of similarity t share an n-gram among the first
n - ceil(t n) + 1 of either, and k more of them if the prefixes are k longer:

1. By the order of hashes, the longer prefix of each set is dealt to hash buckets (4 bytes an n-gram; n-grams that
   documents of one batch share travel once). A class with too few shared n-grams has no partner and is done.
2. For the classes left, n-grams get their document frequency, those of one class only are dropped, and the order is
   by frequency: short prefixes of rare n-grams name the candidates.
3. A group of near copies is not expanded into its pairs: each set is compared with one leader that it shares an n-gram
   with, links are merged into components, and only pairs that still lie in different components are compared at the end.
   Every pair that could link two components is compared, so components lose no link.
4. No pair reaches the fragments whose sketches rule it out. A sketch is the parity of a set's n-grams in each of `BITS`
   places; where two sketches differ, at least one n-gram is not common, so this bound, too, loses no link.

Texts are lower-cased in A-Z and split at `[\\x20\\x09-\\x0D]`. A text with fewer words than n is one n-gram; without
words (or null) the set is empty and linked with nothing. Repeated rows are copies of one another. Rows without doc_id
are linked like others, and name no component. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, lean, plain_text, slices, small_batches, table
from decidra.llm.components import components

#: Bytes of text whose sets a task makes at once: with the arrays of their words they take about 25 times as much.
BATCH_BYTES = 2 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(text: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram hashes (uint64)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, doc = parts.flatten(), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    there = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(there), doc[there.to_numpy(zero_copy_only=False)]
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    held = coded.dictionary
    at = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1].tolist() if len(held) else [0]
    data = held.buffers()[2].to_pybytes() if len(held) else b""
    word = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(held))[coded.indices.to_numpy(zero_copy_only=False)]
    bounds = np.searchsorted(doc, np.arange(len(text) + 1))
    gram = np.full(max(0, len(word) - n + 1), np.uint64(n))
    for k in range(n):
        gram = gram * _ODD[0] + word[k : k + len(gram)]
    gram = _mix(gram)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(gram[a : b - n + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in word[a:b]:
                whole = np.array([whole]) * _ODD[0] + w
                whole = whole[0]
            yield _mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def needed(n, t: int):
    """The least overlap of a set of n with any set that it links with: ceil(t n / 100)."""
    return -(-t * n // 100)


def extra(n, t: int):
    """How much longer than a plain prefix the first, wide prefix is: a fifth of the set, 1 at least."""
    return max(1, n // 5)


#: Bits of a set's sketch.
BITS = 1024


def _digest(s: np.ndarray) -> tuple[int, int]:
    """A set's id (63 bits) and a check (64 bits): both together tell sets apart."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return whole >> 65, (whole & ((1 << 64) - 1)) - (1 << 63)


def _sketch(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """The columns of docs but text, and n_shingles, set_id, check: equal sets have equal ids and checks; empty sets none."""
    names = [c for c in docs.columns if c != "text"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(len(s), *(_digest(s) if len(s) else (None, None))) for s in shingle_sets(batch["text"], n)]
            sizes, ids, checks = zip(*found, strict=True)
            yield pa.record_batch({k: batch[k] for k in names} | {"n_shingles": pa.array(sizes, pa.int64()), "set_id": pa.array(ids, pa.int64()), "check": pa.array(checks, pa.int64())})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(lean(name), ", ".join([*kinds, "n_shingles long, set_id long, check long"]))


def representatives(named: DataFrame) -> DataFrame:
    """set_id, check, node, rep, n of each class: node is set_id, or another number for the later ones of several classes
    with one set_id; rep is the smallest doc_id."""
    each = named.filter(F.col("set_id").isNotNull()).groupBy("set_id", "check").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    alike = each.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("check", "rep", "n"))).alias("own")).select("set_id", F.posexplode("own").alias("at", "own"))
    node = F.when(F.col("at") == 0, F.col("set_id")).otherwise(F.shiftrightunsigned(F.xxhash64("set_id", "own.check"), 1))
    return alike.select("set_id", "own.check", node.alias("node"), "own.rep", "own.n")


def size_class(n: np.ndarray, t: int) -> np.ndarray:
    """Sets that can link are in the same class of sizes or in neighbouring ones."""
    return np.floor(np.log(n) / -np.log(min(t, 99) / 100) + 1e-9).astype(np.int64)


def with_partner(key: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """For entries sorted by (key, n): whether another entry of the key has a size that allows a link."""
    near = (key[1:] == key[:-1]) & (100 * n[:-1] >= t * n[1:])
    out = np.zeros(len(key), bool)
    out[1:] = near
    out[:-1] |= near
    return out


def shared_counts(docs: DataFrame, n: int, t: int) -> DataFrame:
    """set_id, shared: at least the number of n-grams in the set's wide prefix that the wide prefixes of sets of like size
    have too."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = {_digest(s)[0]: s for s in shingle_sets(batch["text"], n) if len(s)}
            if not sets:
                continue
            ids = np.fromiter(sets, np.int64, len(sets))
            sizes = np.array([len(s) for s in sets.values()], np.int64)
            heads = [s[: len(s) - needed(len(s), t) + extra(len(s), t)] for s in sets.values()]
            gram, owner = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(s) for s in heads])
            order = np.lexsort((sizes[owner], gram))
            gram, owner = gram[order], owner[order]
            here = with_partner(gram, sizes[owner], t)
            own = np.bincount(owner[here], minlength=len(sets))
            rows: dict[str, list] = {"bucket": [], "ids": [], "sizes": [], "counts": [], "grams": [], "many": []}

            def out(bucket: int, *parts: bytes) -> None:
                for column, x in zip(rows.values(), (bucket, *parts), strict=True):
                    column.append(x)

            known = np.flatnonzero(own)
            if len(known):
                out(int(ids[known[0]] % buckets), ids[known].tobytes(), b"", own[known].astype(np.uint32).tobytes(), b"", b"")
            # of n-grams with partners in this batch, each class of sizes travels once
            many, to_many = np.unique(np.column_stack([_short(gram[here]).astype(np.int64) | size_class(sizes[owner[here]], t) << 32, (gram[here] % np.uint64(buckets)).astype(np.int64)]), axis=0).T if here.any() else np.zeros((2, 0), np.int64)
            gram, owner = gram[~here], owner[~here]
            to = (gram % np.uint64(buckets)).astype(np.int64)
            order, order_many = np.lexsort((owner, to)), np.argsort(to_many, kind="stable")
            at, at_many = np.searchsorted(to[order], np.arange(buckets + 1)), np.searchsorted(to_many[order_many], np.arange(buckets + 1))
            short, many, owner = _short(gram)[order], many[order_many], owner[order]
            for k in range(buckets):
                a, b, c, d = at[k], at[k + 1], at_many[k], at_many[k + 1]
                if b > a or d > c:
                    firsts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                    mine = owner[a:b][firsts]
                    out(k, ids[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(), np.diff(firsts, append=b - a).astype(np.uint32).tobytes(), short[a:b].tobytes(), many[c:d].tobytes())
            yield pa.record_batch([pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()], names=list(rows))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_bucket(batches):
            ids, number = np.unique(np.concatenate([np.frombuffer(r["ids"], np.int64) for r in own]), return_inverse=True)
            counts = np.bincount(number, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in own]))
            yield pa.record_batch({"set_id": pa.array(ids), "shared": pa.array(counts.astype(np.int64))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_bucket(batches):
            keys, owners, widths, manys, done_ids, done = [], [], [], [], [], []
            for r in own:
                ids, counts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.uint32)
                if not r["grams"] and not r["many"]:
                    done_ids.append(ids)
                    done.append(counts)
                    continue
                # 32 bits of n-gram, the rest size class
                keys.append(np.frombuffer(r["grams"], np.uint32).astype(np.int64))
                owners.append(np.repeat(ids, counts))
                widths.append(np.repeat(np.frombuffer(r["sizes"], np.uint32).astype(np.int64), counts))
                manys.append(np.frombuffer(r["many"], np.int64))
            if done:
                yield _counts(np.concatenate(done_ids), np.concatenate(done), buckets)
            if keys:
                key, owner, width, many = np.concatenate(keys), np.concatenate(owners), np.concatenate(widths), np.unique(np.concatenate(manys))
                order = np.lexsort((owner, width, key))
                key, owner, width = key[order], owner[order], width[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                key, owner, width = key[new], owner[new], width[new]
                found = with_partner(key, width, t)
                if len(many):
                    for near in (-1, 0, 1):
                        wanted = key | np.maximum(size_class(width, t) + near, 0) << 32
                        found |= many[np.minimum(np.searchsorted(many, wanted), len(many) - 1)] == wanted
                ids, times = np.unique(owner[found], return_counts=True)
                yield _counts(ids, times, buckets)

    dealt = docs.select("text").mapInArrow(lean(deal), "bucket int, ids binary, sizes binary, counts binary, grams binary, many binary")
    # sorted by Spark, which spills: a task holds one bucket at a time
    counted = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(count), "bucket int, ids binary, counts binary")
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(total), "set_id long, shared long")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket, of batches that are sorted by it."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for bucket, own in itertools.groupby(rows, key=lambda r: r["bucket"]):
        yield bucket, list(own)


def _short(gram: np.ndarray) -> np.ndarray:
    return ((gram >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _counts(ids: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counts by set, packed by a bucket of sets."""
    to = ids % buckets
    order = np.argsort(to, kind="stable")
    at = np.searchsorted(to[order], np.arange(buckets + 1))
    ids, counts = ids[order].astype(np.int64), counts[order].astype(np.int64)
    rows = [(k, ids[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
    columns = list(zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["bucket", "ids", "counts"])


#: A set travels with its open n-grams, once for each of them, if they are no more than this.
HEAD = 200
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)


def _places(bits: int) -> list[F.Column]:
    return [F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << bits)) for k in (1, 2)]


def sieve(ids: DataFrame, bits: int = 26) -> np.ndarray:
    """A Bloom filter of the doc_ids: 2^bits bits (8 MB) whatever their number, merged by ranges before it is read."""
    place = ids.select(F.explode(F.array(*_places(bits))).alias("p")).groupBy(F.shiftright("p", 16).alias("part")).agg(F.collect_set(F.col("p").bitwiseAND(65535).cast("int")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in batch["at"]:
                own = np.zeros(65536, bool)
                own[at.values.to_numpy()] = True
                rows.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.record_batch([batch["part"], pa.array(rows, pa.binary())], names=["part", "own"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in place.mapInArrow(pack, "part long, own binary").collect():
        out[r["part"] * 8192 : (r["part"] + 1) * 8192] = np.frombuffer(r["own"], np.uint8)
    return out


def ordered_sets(docs: DataFrame, chosen: DataFrame, n: int, t: int) -> DataFrame:
    """node, n, bits (its sketch), grams: the chosen sets' n-grams that others have too, in the global order (frequency
    class, hash), for those with enough of them to have a partner. chosen: doc_id, set_id, check and node of one document
    for each set."""
    # most texts end here, before any shuffle; the join decides
    held = docs.sparkSession.sparkContext.broadcast(sieve(chosen))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for k in "ab":
                p = batch[k].to_numpy()
                maybe &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            for own in slices(iter([batch.filter(pa.array(maybe))])):
                found = list(shingle_sets(own["text"], n))
                ids, longs = [_digest(s) for s in found], pa.list_(pa.int64())
                yield pa.record_batch({
                    "doc_id": own["doc_id"], "set_id": pa.array([i for i, _ in ids], pa.int64()), "check": pa.array([c for _, c in ids], pa.int64()), "n": pa.array([len(s) for s in found], pa.int64()),
                    "bits": pa.array([_sketch(s) for s in found], longs), "grams": pa.array([s.view(np.int64) for s in found], longs),
                })

    a, b = _places(26)
    wanted = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).select("doc_id", "text", a.alias("a"), b.alias("b"))
    own = wanted.mapInArrow(lean(sets), "doc_id long, set_id long, check long, n long, bits array<long>, grams array<long>").join(chosen, ["doc_id", "set_id", "check"])
    own = cut(own.select("node", "n", "bits", "grams"), "op5-sets")
    each = own.select("node", "n", "bits", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1").select("gram", F.floor(F.log2("df")).cast("int").alias("class"))
    back = each.select("node", "gram").join(often, "gram").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("class", "gram"))).alias("grams"))
    back = own.select("node", "n", "bits").dropDuplicates(["node"]).join(back, "node")
    return back.filter(100 * F.size("grams") >= t * F.col("n")).select("node", "n", "bits", "grams")


def segments(sets: DataFrame, cuts: int = 4) -> DataFrame:
    """doc_id, fragment, grams: each set cut at the fragments' bounds, which lie in each frequency class at `cuts` - 1
    places of the hash range."""
    fragment = lambda g: g["class"] * cuts + F.pmod(F.shiftrightunsigned(g["gram"], 40), F.lit(cuts)).cast("int")
    named = sets.select("doc_id", F.transform("grams", lambda g: F.struct(fragment(g).alias("f"), g["gram"].alias("g"))).alias("grams"))
    parts = named.select("doc_id", "grams", F.explode(F.array_distinct(F.transform("grams", lambda g: g["f"]))).alias("fragment"))
    return parts.select("doc_id", "fragment", F.transform(F.filter("grams", lambda g: g["f"] == F.col("fragment")), lambda g: g["g"]).alias("grams"))


def linked(pairs: DataFrame, segs: DataFrame, t: int) -> DataFrame:
    """The pairs (a, na, b, nb) that link: partial overlaps by fragment, summed per pair."""
    left = pairs.join(segs.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
    both = left.join(segs.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    overlap = both.select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("partial")).groupBy("a", "na", "b", "nb").agg(F.sum("partial").alias("common"))
    return overlap.filter(100 * F.col("common") >= t * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def can_link(t: int) -> F.Column:
    """No more n-grams can be common than the m that a set shares with any other; a link needs t / (100 + t) of both sizes."""
    return (100 + t) * F.least("m", "other_m") >= t * (F.col("n") + F.col("other_n"))


def sketches_allow(t: int) -> F.Column:
    """The same for the n-grams that are left if one is taken for each bit in which the sketches differ."""
    differ = F.lit(0)
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("other_bits")[k]))
    both = F.col("n") + F.col("other_n")
    return (100 + t) * (both - differ) >= 2 * t * both


def _pairs(x: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Distinct (a, na, b, nb) of rows (doc_id, other) that can link."""
    own = sets.select("doc_id", "n", F.size("grams").alias("m"), "bits")
    x = x.filter("doc_id <> other").distinct().join(own, "doc_id")
    x = x.join(own.toDF("other", "other_n", "other_m", "other_bits"), "other").filter(can_link(t) & sketches_allow(t))
    return _named(x)


def _named(x: DataFrame) -> DataFrame:
    first = F.col("doc_id") < F.col("other")
    return x.select(
        F.when(first, F.col("doc_id")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("n")).otherwise(F.col("other_n")).alias("na"),
        F.when(first, F.col("other")).otherwise(F.col("doc_id")).alias("b"), F.when(first, F.col("other_n")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def near_components(sets: DataFrame, t: int, rounds: int = 8) -> DataFrame | None:
    """node, component over the sets of ordered_sets(); sets without links may be missing. None: no sets.

    Each round names a leader in every n-gram, first the document in the middle, then one from the largest label there,
    and compares each set with one leader of another label. When the pairs between different labels are few, or a round has linked few sets, or
    after `rounds`, each of those pairs is compared."""
    # a document whose n-grams are common among those left stands in the middle of its near copies
    core = F.aggregate("grams", F.lit(0), lambda s, g: s + g["class"]) / F.col("n")
    sets = cut(sets.withColumn("core", core).withColumnRenamed("node", "doc_id"), "op5-ordered")
    segs = segments(sets)
    short = F.col("n") - F.ceil(F.lit(t) * F.col("n") / 100) + 1 - (F.col("n") - F.size("grams"))
    prefix = sets.filter(short > 0).select("doc_id", "core", F.explode(F.slice("grams", F.lit(1), short.cast("int"))).alias("g"))
    prefix = cut(prefix.select("doc_id", "core", F.col("g.gram").alias("gram")), "op5-prefix")
    entries, own, edges, labels, fresh = prefix.count(), sets.count(), None, None, 0
    if not entries:
        return None
    for turn in range(rounds + 1):
        at = prefix.withColumn("component", F.col("doc_id")) if labels is None else prefix.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        pick = F.xxhash64(F.lit(turn), "doc_id") if turn else F.struct(-F.col("core"), F.col("doc_id"))
        parts = at.groupBy("gram", "component").agg(F.count("*").alias("c"), F.min_by("doc_id", pick).alias("lead"), F.max("core").alias("core"))
        largest = F.struct("c", F.xxhash64(F.lit(turn), "lead")) if turn else F.struct("core", "c", -F.col("component"))
        tokens = parts.groupBy("gram").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"), F.max_by(F.struct("lead", "component"), largest).alias("top"))
        tokens = cut(tokens.filter("open > 0"), "op5-open")
        todo = tokens.agg(F.sum("open")).first()[0] or 0
        if not todo:
            break
        last = turn == rounds or todo <= 4 * entries or turn > 0 and 20 * fresh < own
        if last:
            rest = at.join(tokens.select("gram"), "gram", "left_semi").select("gram", "doc_id", "component")
            heads = rest.groupBy("doc_id").agg(F.count("*").alias("c"), F.collect_list("gram").alias("head"))
            heads = heads.select("doc_id", F.when(F.col("c") <= HEAD, F.col("head")).alias("head"))
            held = heads.join(sets.select("doc_id", "n", F.size("grams").alias("m"), "bits"), "doc_id")
            rest = cut(rest.join(held, "doc_id"), "op5-rest")
            other = rest.select("gram", *(F.col(c).alias(f"other_{c}") for c in ("n", "m", "bits", "component", "head")), F.col("doc_id").alias("other"))
            # a pair is made where its first common n-gram is, so once; that of a very long set, at each of them
            once = F.coalesce(F.col("gram") == F.array_min(F.array_intersect("head", "other_head")), F.lit(True))
            new_pair = (F.col("component") != F.col("other_component")) & (F.col("doc_id") < F.col("other"))
            pairs = _named(rest.withColumnRenamed("gram", "g").join(other, (F.col("g") == F.col("gram")) & new_pair & can_link(t) & sketches_allow(t) & once))
        else:
            # of the leaders in its n-grams, a set takes the one in most of them
            led = at.join(tokens, "gram").filter(F.col("component") != F.col("top.component")).groupBy("doc_id", F.col("top.lead").alias("other")).agg(F.count("*").alias("c"))
            pairs = _pairs(led.groupBy("doc_id").agg(F.max_by("other", F.struct("c", "other")).alias("other")), sets, t)
        new = cut(linked(pairs, segs, t), "op5-links")
        edges = new if edges is None else edges.union(new)
        if last:
            break
        labels = cut(components(new if labels is None else new.union(labels.toDF("a", "b")), "op5-rounds"), "op5-labels")
        fresh = new.count()
    return components(edges, "op5-components") if edges is not None else None


def ngram_join(docs: DataFrame, n: int = 5, t: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set_id, component (a number that its sets share), component_id, and the columns in `carry`, for
    every row of docs; links at 100 * intersection >= t * union."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    named = cut(classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, plain_text().alias("text")), n), "op5-classes")
    reps = cut(representatives(named), "op5-reps")
    least = F.ceil(F.lit(t) * F.col("n") / 100)
    need = F.greatest(F.lit(1), F.floor(least / 5))
    chosen = reps.join(shared_counts(own, n, t), "set_id").filter(F.col("shared") >= need).select(F.coalesce("rep", F.lit(NO_ID)).alias("doc_id"), "set_id", "check", "node")
    labels = near_components(ordered_sets(own, cut(chosen, "op5-chosen"), n, t), t)
    own_label = reps.withColumn("component", F.col("node")) if labels is None else reps.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own_label.groupBy("component").agg(F.min("rep").alias("component_id"))
    lead = own_label.join(least, "component").select("set_id", "check", "node", "component", "component_id")
    joined = named.join(lead, ["set_id", "check"], "left")
    return joined.select("doc_id", *carry, "n_shingles", F.col("node").alias("set_id"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=4, t=85).select("doc_id", "n_shingles", "component_id")
