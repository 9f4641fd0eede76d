"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of eight bytes slide over the text, and their activations are averaged over overlapping
chunks of 256 bytes that cover the whole document. A layer turns each chunk into detectors, which are max-pooled (and
averaged) over all chunks and combined into one probability that the quality label is 1.

The network is fitted on the driver to at most `per_class` labelled documents of either label, chosen by a hash of
doc_id; the sample does not grow with the input. Only rows with crc32(doc_id) mod 4 <> 2 are ever learned from. The text
is the only input. Scoring reads every whole text, a MB at a time, and holds a few bytes for each byte of it. There every sum
is made number by number in a fixed order (a filter is a sum of one table row for each of its bytes), so a score depends on
the text alone and not on what is scored with it.

A null or empty text is scored as one chunk without bytes. Repeated rows and equal texts get equal scores. If the labels lack one of the
two classes, there is nothing to learn and every score is 0.5. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import lean, plain_text, slices, small_batches, table

CHUNK, STEP, WIDTH, STRIDE = 256, 128, 8, 4
EMBED, FILTERS, DETECTORS = 6, 32, 64
#: Half chunks whose filters are computed at once when texts are scored.
BLOCK = 1024
SCORES = "doc_id long, score double"


def laid_out(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text filled up to whole half chunks with 256, and where texts start in half chunks."""
    n = len(text)
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    first = np.concatenate([[0], np.cumsum(np.maximum(2, -(-size // STEP)))])
    out = np.full(first[-1] * STEP + WIDTH, 256, np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * STEP - (at[:-1] - at[0]), size)] = data
    return out, first


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    init = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "emb": init(256, EMBED, scale=0.5), "w1": init(WIDTH * EMBED, FILTERS, scale=0.15), "b1": np.zeros(FILTERS, np.float32),
        "w2": init(FILTERS, DETECTORS, scale=0.3), "b2": np.full(DETECTORS, 0.1, np.float32),
        "w3": init(2 * DETECTORS, scale=0.2), "b3": np.zeros(1, np.float32),
    }


def forward(p: dict[str, np.ndarray], text: pa.Array) -> tuple[np.ndarray, dict]:
    """The logit of each text, and what backward() needs."""
    data, first = laid_out(text)
    real = data < 256
    places = (len(data) - WIDTH) // STRIDE
    x = np.append(p["emb"], np.zeros((1, EMBED), p["emb"].dtype), 0)[data]
    step = x.strides[0]
    windows = np.lib.stride_tricks.as_strided(x, (places, WIDTH * EMBED), (STRIDE * step, x.strides[1]))
    mask = real[: places * STRIDE : STRIDE]
    act = np.maximum(windows @ p["w1"] + p["b1"], 0) * mask[:, None]
    per = STEP // STRIDE
    half = act.reshape(-1, per, FILTERS).sum(1)
    count = mask.reshape(-1, per).sum(1).astype(np.float32)
    # a chunk is two halves; a text's last half has no right neighbour
    chunk = np.ones(len(half), bool)
    chunk[first[1:] - 1] = False
    left = np.flatnonzero(chunk)
    total = np.maximum(count[left] + count[left + 1], 1)
    mean = (half[left] + half[left + 1]) / total[:, None]
    z = np.maximum(mean @ p["w2"] + p["b2"], 0)
    begin = first[:-1] - np.arange(len(first) - 1)
    top = np.maximum.reduceat(z, begin, axis=0)
    chunks = np.diff(np.append(begin, len(z)))
    avg = np.add.reduceat(z, begin, axis=0) / chunks[:, None]
    logit = np.concatenate([top, avg], 1) @ p["w3"] + p["b3"]
    return logit, dict(data=data, windows=windows, mask=mask, real=real, act=act, left=left, total=total, mean=mean, z=z, begin=begin, top=top, avg=avg, chunks=chunks)


def backward(p: dict[str, np.ndarray], c: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for these gradients of the logits."""
    g = {"w3": np.concatenate([c["top"], c["avg"]], 1).T @ dlogit, "b3": dlogit.sum(keepdims=True)}
    dfeat = dlogit[:, None] * p["w3"]
    doc = np.repeat(np.arange(len(c["begin"])), c["chunks"])
    dz = dfeat[doc, DETECTORS:] / c["chunks"][doc][:, None]
    is_top = c["z"] == c["top"][doc]
    ties = np.add.reduceat(is_top, c["begin"], axis=0)
    dz = (dz + is_top * dfeat[doc, :DETECTORS] / ties[doc]) * (c["z"] > 0)
    g["w2"], g["b2"] = c["mean"].T @ dz, dz.sum(0)
    dmean = (dz @ p["w2"].T) / c["total"][:, None]
    dhalf = np.zeros((len(c["mask"]) // (STEP // STRIDE), FILTERS), np.float32)
    dhalf[c["left"]] += dmean
    dhalf[c["left"] + 1] += dmean
    dact = np.repeat(dhalf, STEP // STRIDE, axis=0) * (c["act"] > 0)
    g["w1"], g["b1"] = c["windows"].T @ dact, dact.sum(0)
    dwin = (dact @ p["w1"].T).reshape(-1, WIDTH, EMBED)
    demb = np.zeros((256, EMBED), np.float64)
    for k in range(WIDTH):
        at = np.arange(len(dwin)) * STRIDE + k
        d = dwin[:, k] * c["real"][at][:, None]
        for e in range(EMBED):
            demb[:, e] += np.bincount(c["data"][at], d[:, e], 257)[:256]
    g["emb"] = demb.astype(np.float32)
    return g


def logits(p: dict[str, np.ndarray], text: pa.Array) -> np.ndarray:
    """forward() without matrix products, whose sums depend on the number of rows."""
    data, first = laid_out(text)
    tables = [np.append(p["emb"] @ p["w1"][k * EMBED : (k + 1) * EMBED], np.zeros((1, FILTERS), np.float32), 0) for k in range(WIDTH)]
    per = STEP // STRIDE
    half = np.zeros((first[-1], FILTERS), np.float32)
    mask = (data[: first[-1] * STEP : STRIDE] < 256).reshape(-1, per)
    for a in range(0, int(first[-1]), BLOCK):
        b = min(a + BLOCK, int(first[-1]))
        act = np.tile(p["b1"], ((b - a) * per, 1))
        for k, table_ in enumerate(tables):
            act += table_[data[a * STEP + k : b * STEP + k : STRIDE]]
        act = np.maximum(act, 0).reshape(b - a, per, FILTERS)
        for k in range(per):
            half[a:b] += act[:, k] * mask[a:b, k, None]
    count = mask.sum(1).astype(np.float32)
    chunk = np.ones(len(half), bool)
    chunk[first[1:] - 1] = False
    left = np.flatnonzero(chunk)
    mean = (half[left] + half[left + 1]) / np.maximum(count[left] + count[left + 1], 1)[:, None]
    z = np.tile(p["b2"], (len(mean), 1))
    for k in range(FILTERS):
        z += mean[:, k, None] * p["w2"][k]
    z = np.maximum(z, 0)
    begin = first[:-1] - np.arange(len(first) - 1)
    features = np.concatenate([np.maximum.reduceat(z, begin, axis=0), np.add.reduceat(z, begin, axis=0) / np.diff(np.append(begin, len(z)))[:, None].astype(np.float32)], 1)
    out = np.full(len(features), p["b3"][0], np.float32)
    for k in range(2 * DETECTORS):
        out += features[:, k] * p["w3"][k]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Weights after Adam on balanced log loss; None without both labels."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    p, rng = start(seed), np.random.default_rng(seed)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    m, v, t = {k: 0 for k in p}, {k: 0 for k in p}, 0
    epochs = max(epochs, -(-150 * batch // len(texts)))  # 150 steps at least
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            logit, kept = forward(p, pa.array([texts[i] for i in at], pa.string()))
            d = ((sigmoid(logit) - labels[at]) * weight[at] / len(at)).astype(np.float32)
            t += 1
            for k, g in backward(p, kept, d).items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, per_class: int = 700, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Fits to at most per_class learnable documents of each label."""
    # the ids are chosen on the narrow labels table; 2 * per_class of them go to the driver and on to the scan
    learnable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(F.col("quality").isin(0, 1) & ~held_out()).dropDuplicates(["doc_id"])
    chosen = {r["doc_id"]: r["quality"] for q in (0, 1) for r in learnable.filter(F.col("quality") == q).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class).collect()}
    if len(set(chosen.values())) < 2:
        return None
    # as Arrow: rows of Python objects would pass through Python workers of their own
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(chosen, pa.int64())}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([chosen[r["doc_id"]] for r in rows]), seed=seed)


def scored(docs: DataFrame, weights: dict[str, np.ndarray] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and score: a row for each row of docs. Without weights, every score is 0.5."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            text = batch["_text"].cast(pa.string())
            logit = logits(weights, text) if weights else np.zeros(len(text))
            yield pa.record_batch([*(batch[k] for k in names), pa.array(sigmoid(logit), pa.float64())], names=[*names, "score"])

    names = ["doc_id", *keep]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, plain_text().alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]
    return source.mapInArrow(lean(score), ", ".join([*kinds, "score double"]))


def op4_quality_model(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
