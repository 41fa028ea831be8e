"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole document; each filter is max-pooled over a
chunk, a linear layer turns the pooled values into the chunk's logit, and the mean of the chunks' logits gives the
document's probability.  A filter of width w over one-hot bytes is w tables of 256 rows, so a convolution is a sum of table
look-ups and the gradient reaches only the bytes below each maximum.

The network is fitted on the driver on a bounded sample: the SAMPLE training rows whose doc_id has the smallest hash; of a text
of more than LONGEST bytes, PIECES stretches that make up LONGEST bytes, evenly over the whole of it from a start drawn by hash.
Only bytes of the text are inputs.  A null or empty text is one chunk of padding.  Without both
labels among the training rows every score is the share of label 1 (0.5 without rows).  An empty table gives no rows; of columns
with clashing names only the output's is refused.  A document with several labels
counts with the lowest; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, LONGEST, PIECES = 2000, 1 << 16, 16  #: documents, and bytes of each, that the network is fitted on at most
WIDTH, FILTERS = 8, 24
SEGMENT, PER_CHUNK, STEP = 64, 8, 7  #: a chunk is PER_CHUNK segments; chunks start every STEP segments
BLOCK = SEGMENT * STEP * 256  #: positions that are convolved at once
EPOCHS, BATCH, RATE, CHUNKS, CROPPED = 10, 32, 0.01, 6, 0.25  #: of training; CHUNKS of a document in one step at most; share of documents cut short


class Net:
    def __init__(self, filters, bias, weights, intercept):
        self.filters, self.bias, self.weights, self.intercept = filters, bias, weights, intercept

    @staticmethod
    def constant(share: float) -> Net:
        share = min(0.999, max(0.001, share))
        return Net(np.zeros((WIDTH, 256, FILTERS), "f4"), np.zeros(FILTERS, "f4"), np.zeros(FILTERS, "f4"), float(np.log(share / (1 - share))))

    def convolved(self, data: np.ndarray, n: int) -> np.ndarray:
        """Filter values at the first n positions of data, which has WIDTH - 1 bytes more."""
        out = self.filters[0].take(data[:n], axis=0)
        for j in range(1, WIDTH):
            out += self.filters[j].take(data[j : j + n], axis=0)
        return out

    def logit(self, text: bytes) -> float:
        """Mean logit of the chunks, block by block."""
        n = max(1, -(-len(text) // SEGMENT)) * SEGMENT
        data = np.zeros(n + WIDTH - 1, "u1")
        data[: len(text)] = np.frombuffer(text, "u1")
        tops = np.concatenate([self.convolved(data[k : k + BLOCK + WIDTH - 1], min(BLOCK, n - k)).reshape(-1, SEGMENT, FILTERS).max(1) for k in range(0, n, BLOCK)])
        starts = range(0, max(1, len(tops) - PER_CHUNK + STEP), STEP)
        pooled = np.stack([tops[s : s + PER_CHUNK].max(0) for s in starts])
        return float((np.maximum(pooled + self.bias, 0) @ self.weights).mean() + self.intercept)

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text or b""), -30, 30))))


def cropped(chunks: np.ndarray, rng) -> np.ndarray:
    """The first bytes of one chunk, so that the network also learns from documents of a few words."""
    one = chunks[:1] if rng.random() < 0.5 else chunks[rng.integers(len(chunks))][None]
    one = one.copy()
    one[:, int(np.exp(rng.uniform(np.log(12), np.log(300)))) :] = 0
    return one


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Net:
    """Train by Adam on the log loss of whole documents, each step on some chunks of BATCH documents."""
    y = np.array(labels, "f4")
    if not len(y) or y.min() == y.max():
        return Net.constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    size = SEGMENT * PER_CHUNK
    chunks = []
    for t in texts:
        n = max(1, -(-len(t) // (SEGMENT * STEP)))
        data = np.zeros(n * SEGMENT * STEP + size + WIDTH, "u1")
        data[: len(t)] = np.frombuffer(t, "u1")
        chunks.append(np.stack([data[k * SEGMENT * STEP :][: size + WIDTH - 1] for k in range(n)]))
    net = Net.constant(float(y.mean()))
    net.filters = rng.normal(0, 0.1, net.filters.shape).astype("f4")
    net.weights = rng.normal(0, 0.3, FILTERS).astype("f4")
    net.intercept = np.array([net.intercept], "f4")
    params = [net.filters, net.bias, net.weights, net.intercept]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    lanes = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            docs = order[k : k + BATCH]
            parts = [cropped(chunks[d], rng) if rng.random() < CROPPED else c if len(c := chunks[d]) <= CHUNKS else c[rng.choice(len(c), CHUNKS, replace=False)] for d in docs]
            data, owner = np.concatenate(parts), np.repeat(np.arange(len(docs)), [len(p) for p in parts])
            values = net.filters[0].take(data[:, :size], axis=0)
            for j in range(1, WIDTH):
                values += net.filters[j].take(data[:, j : j + size], axis=0)
            where = values.argmax(1)
            pooled = np.maximum(np.take_along_axis(values, where[:, None], 1)[:, 0] + net.bias, 0)
            share = 1 / np.bincount(owner)[owner].astype("f4")
            z = np.bincount(owner, (pooled @ net.weights + net.intercept[0]) * share, len(docs))
            dz = ((1 / (1 + np.exp(-z)) - y[docs]) / len(docs)).astype("f4")[owner] * share
            dp = dz[:, None] * net.weights * (pooled > 0)
            grad = np.zeros_like(net.filters)
            rows, cols = np.nonzero(dp)
            for j in range(WIDTH):
                np.add.at(grad[j], (data[rows, where[rows, cols] + j], lanes[cols]), dp[rows, cols])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(params, (grad, dp.sum(0), pooled.T @ dz, np.array([dz.sum()], "f4")), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * a / (np.sqrt(b) + 1e-8)
    net.intercept = float(net.intercept[0])
    return net


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stretches(text):
    """The bytes of a text, of a long one PIECES stretches spread evenly over it."""
    size, step = F.octet_length(text), F.floor(F.octet_length(text) / PIECES)
    start = F.pmod(F.xxhash64(text), F.greatest(step - LONGEST // PIECES, F.lit(1)))
    parts = [F.substring(text, (start + k * step + 1).cast("int"), F.lit(LONGEST // PIECES)) for k in range(PIECES)]
    return F.when(size <= LONGEST, text).otherwise(F.concat(*parts))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """Fit on labelled rows outside the held-out quarter."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # ids and labels only
    ids = docs.sparkSession.createDataFrame([(r.doc_id, int(r.quality)) for r in picked], "doc_id long, quality int")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).withColumn("text", stretches(F.col("text")))
    rows = sorted(texts.collect(), key=lambda r: r.doc_id)
    net = fit([bytes(r.text) for r in rows], [r.quality for r in rows])
    del rows
    common.trim()
    return net


def score(docs: DataFrame, net: Net, out: str = "score") -> DataFrame:
    """docs with the column out."""
    if out in docs.columns:
        raise ValueError(f"the input has a column {out} already")
    common.ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_table("cnn")
        for b in common.sliced(batches):
            scores = [net.score(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def digests(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The contract's columns."""
    docs = docs.select("doc_id", "text")
    scored = score(common.spread(docs), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
