"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, and learned filters of 8 bytes run over it in steps of 4. The text is covered
whole by overlapping chunks; each filter is max-pooled in each chunk, and the mean and the maximum over chunks
combine into one probability. Training reads a bounded sample of labelled rows (`sample_rows`) whose texts have at most
`sample_bytes` bytes; scoring reads all rows and whole texts.

Null and empty texts are scored as one blank chunk. A doc_id is learned from once: its greatest label, and of several
texts the least. Labels without a quality or doc_id are not learned from; rows without doc_id are scored as any other
and are not held out. Equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import byte_view, documents, slices

STEP, DIM = 4, 8
#: A chunk has CHUNK bytes and begins every STRIDE bytes.
CHUNK, STRIDE = 512, 448
#: Chunks that are worked on together.
BLOCK = 1024
#: Most labelled rows that are learned from, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 1 << 20
THRESHOLD = 0.3


@dataclass
class Net:
    table: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 * STEP * DIM x F
    bias: np.ndarray  # F
    out: np.ndarray  # 2 F
    shift: np.ndarray  # 1

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, self.shift]


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one zero-padded byte array of whole steps; chunks as pairs (first step, end) and each text's first chunk.

    A text of n bytes has ceil(n / STEP) windows, at least one; chunks cover all of them.
    """
    lengths = np.diff(offsets)
    steps = np.maximum(1, -(-lengths // STEP))
    begins = np.concatenate([[0], np.cumsum(steps + 1)])  # a blank step lies between texts
    padded = np.zeros((int(begins[-1]) + 1) * STEP, np.uint8)
    for to, a, b in zip((begins[:-1] * STEP).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        padded[to : to + b - a] = data[a:b]
    width, stride = CHUNK // STEP, STRIDE // STEP
    n_chunks = np.maximum(1, -(-(steps - (width - stride)) // stride))
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], n_chunks)
    a = np.repeat(begins[:-1], n_chunks) + k * stride
    b = np.minimum(a + width, np.repeat(begins[:-1] + steps, n_chunks))
    return padded, np.stack([a, b], 1), first


def _windows(net: Net, padded: np.ndarray) -> np.ndarray:
    rows = net.table[padded].reshape(-1, STEP * DIM)
    half = STEP * DIM
    both = rows @ np.concatenate([net.filters[:half], net.filters[half:]], 1)
    f = net.bias.size
    return both[:-1, :f] + both[1:, f:] + net.bias


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    padded, chunks, first = laid_out(data, offsets)
    by_chunk = np.empty((len(chunks), net.bias.size), np.float32)
    for at in range(0, len(chunks), BLOCK):  # so that memory does not follow the text
        part = chunks[at : at + BLOCK]
        low, high = int(part[0, 0]), int(part[:, 1].max())
        act = np.concatenate([np.maximum(_windows(net, padded[low * STEP : (high + 1) * STEP]), 0), np.zeros((1, net.bias.size), np.float32)])
        by_chunk[at : at + BLOCK] = np.maximum.reduceat(act, (part - low).ravel(), axis=0)[::2]
    most = np.maximum.reduceat(by_chunk, first[:-1], axis=0)
    mean = np.add.reduceat(by_chunk, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([mean, most], 1)


def scores(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.empty(0)
    z = pooled(net, data, offsets).astype(np.float64) @ net.out + net.shift[0]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, n_filters: int = 24, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on log loss. Only the windows that win a pooling carry a gradient, so the backward pass gathers those."""
    rng = np.random.default_rng(seed)
    g = lambda *s: rng.standard_normal(s).astype(np.float32)
    net = Net(g(256, DIM) * 0.5, g(2 * STEP * DIM, n_filters) * 0.12, np.zeros(n_filters, np.float32), g(2 * n_filters) * 0.1, np.zeros(1, np.float32))
    mean_label = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    net.shift[:] = np.log(mean_label / (1 - mean_label))
    if not texts:
        return net
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in net.arrays()]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - epoch / epochs) ** 0.5
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            part = [texts[i] for i in pick]
            data = np.frombuffer(b"".join(part), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            padded, chunks, first = laid_out(data, offsets)
            act = np.concatenate([_windows(net, padded), np.full((1, n_filters), -1, np.float32)])
            width = CHUNK // STEP
            idx = np.minimum(chunks[:, :1] + np.arange(width), chunks[:, 1:] - 1)
            where = chunks[:, :1] + np.argmax(act[idx], axis=1)  # chunk x filter
            where = np.minimum(where, chunks[:, 1:] - 1)
            by_chunk = np.maximum(np.take_along_axis(act, where, 0), 0)
            n = np.diff(first)
            most = np.maximum.reduceat(by_chunk, first[:-1], axis=0)
            mean = np.add.reduceat(by_chunk, first[:-1], axis=0) / n[:, None]
            hidden = np.concatenate([mean, most], 1)
            z = hidden @ net.out + net.shift[0]
            err = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - labels[pick]).astype(np.float32) / len(pick)
            d_hidden = err[:, None] * net.out
            owner = np.repeat(np.arange(len(pick)), n)
            d_chunk = d_hidden[owner, :n_filters] / n[owner, None] + d_hidden[owner, n_filters:] * (by_chunk == most[owner])
            d_chunk = np.where(by_chunk > 0, d_chunk, 0).astype(np.float32)
            bytes_at = padded[(where[:, :, None] * STEP + np.arange(2 * STEP))]  # chunk x filter x 8
            emb = net.table[bytes_at].reshape(*where.shape, -1)
            d_filters = np.einsum("cf,cfk->kf", d_chunk, emb)
            d_emb = (d_chunk[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
            flat = bytes_at.ravel()
            d_table = np.stack([np.bincount(flat, d_emb[:, j], 256) for j in range(DIM)], 1)
            grads = [d_table, d_filters, d_chunk.sum(0), hidden.T @ err + 1e-4 * net.out, np.array([err.sum()])]
            t += 1
            for a, m, d in zip(net.arrays(), moments, grads):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                a -= (lr * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Train on at most sample_rows labelled rows that are not held out, picked by a hash of doc_id among those with a text of at most sample_bytes."""
    labelled = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce("text", F.lit(""))
    short = docs.select("doc_id", text.alias("text")).where(F.octet_length(text) <= sample_bytes)
    picked = labelled.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float32))


def score(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                s = scores(net, *byte_view(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("held"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                yield batch.filter(pa.array(scores(net, *byte_view(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
