"""Quality classifier: random-indexing token vectors, pooled per document, and a small neural network.

Tokens are runs of word characters and runs of other marks, as written. Every token has a sparse random index vector
made from its hash; a token's vector is the sum of the index vectors of its neighbours over all documents. Tokens meet
in ``2 ** BUCKET_BITS`` hash buckets, so the table is bounded whatever the vocabulary. A document is the mean and the
root mean square of its tokens' unit vectors, with the logarithm of their number.

The network (one hidden layer) is fitted in numpy on about ``max_labelled`` labelled documents drawn by a hash of the
id: that bound is a parameter of the model. A fifth of them is set aside to choose the temperature that calibrates the
probabilities. Token statistics use all documents.

Defined cases: a null or empty text pools to zeros and gets the network's answer to that. A row whose id is null is
scored, but not learned from. Rows of labels with a null id or label are ignored. Without labels every score is 0.5.
Repeated rows each get a result row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.llm.base import SPACE_BYTES, Texts, Tokens, byte_table, text_slices

BUCKET_BITS = 14
WIDTH = 64
NONZERO = 4
REACH = 2
BLOCK = 256
#: texts pooled at a time: their counts by bucket are at most 64 x 16,384 numbers
POOLED_TEXTS = 64

# Token kinds by byte; bytes of one kind in a row make a token.
TOKEN_KIND = byte_table(
    {SPACE_BYTES: 0, b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_": 1, bytes(range(128, 256)): 1}, 2
)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each token's index vector, from the low bits of its hash."""
    place = np.empty((len(hashes), NONZERO), dtype=np.int64)
    sign = np.empty((len(hashes), NONZERO), dtype=np.float64)
    for k in range(NONZERO):
        part = (hashes >> np.uint64(8 * k)).astype(np.int64)
        place[:, k] = part & (WIDTH - 1)
        sign[:, k] = 1.0 - 2.0 * (part >> 6 & 1)
    return place, sign


def contexts(texts: DataFrame) -> np.ndarray:
    """The context vector of every bucket over all documents, one row each, of unit length."""
    size = (1 << BUCKET_BITS) * WIDTH

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for t in text_slices(batch.column(0)):
                tokens = Tokens(t, TOKEN_KIND)
                hashes, owners = tokens.hashes(), tokens.owners()
                place, sign = index_entries(hashes)
                row = buckets(hashes) * WIDTH
                for gap in range(1, REACH + 1):
                    same = owners[gap:] == owners[:-gap]
                    before, after = np.flatnonzero(same), np.flatnonzero(same) + gap
                    for mine, other in ((before, after), (after, before)):
                        total += np.bincount((row[mine, None] + place[other]).ravel(), sign[other].ravel(), size)
        blocks = total.astype(np.int64).reshape(-1, BLOCK * WIDTH)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([blocks[i].astype(np.int32).tobytes()], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(body, dtype=np.int32).astype(np.int64)
                sums[i] = sums[i] + own if i in sums else own
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "sums"])

    added = texts.mapInArrow(gather, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary")
    out = np.zeros((1 << BUCKET_BITS, WIDTH), dtype=np.float32)
    for r in added.collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, dtype=np.int64).reshape(BLOCK, WIDTH)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(t: Texts, vectors: np.ndarray) -> np.ndarray:
    """Mean and root mean square of each text's token vectors, and the logarithm of their number."""
    tokens = Tokens(t, TOKEN_KIND)
    counts = np.diff(tokens.first)
    out = np.zeros((t.n, 2 * WIDTH + 1), dtype=np.float64)
    out[:, -1] = np.log1p(counts)
    place = buckets(tokens.hashes())
    column = np.zeros(len(vectors), dtype=np.int64)
    for at in range(0, t.n, POOLED_TEXTS):
        n = counts[at : at + POOLED_TEXTS]
        own = place[tokens.first[at] : tokens.first[at + len(n)]]
        if not len(own):
            continue
        # token counts by text and bucket, times the vectors of the buckets met
        met = np.flatnonzero(np.bincount(own, minlength=len(vectors)))
        column[met] = np.arange(len(met))
        cell = np.repeat(np.arange(len(n)) * len(met), n) + column[own]
        share = np.bincount(cell, minlength=len(n) * len(met)).reshape(len(n), -1) / np.maximum(n, 1)[:, None]
        known = vectors[met].astype(np.float64)
        out[at : at + len(n), :WIDTH] = share @ known
        out[at : at + len(n), WIDTH:-1] = np.sqrt(share @ (known * known))
    # the order of sums depends on the texts worked together, so what lies below single precision is dropped
    return out.astype(np.float32).astype(np.float64)


def pool_column(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled(t, vectors) for t in text_slices(column, 1 << 20)])


# ---------------------------------------------------------------- network


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, units: int = 32, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the cross-entropy over four fifths of the rows, then the temperature with the least loss on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z, target = (x - mean) / scale, y.astype(np.float64)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            rows = train[at : at + 64]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - target[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logits, sign = net.logits(x[held]), np.where(y[held] == 1, 1.0, -1.0)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -sign * logits / t).mean()))
    return net


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", max_labelled: int = 6000,
) -> Network | None:
    """Fit on about ``max_labelled`` of the documents that ``usable`` (of the id) allows and ``labels`` marks 0 or 1."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    marked = marked.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).where(usable)
    rows = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_labelled / max(rows, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = pool_column(batch.column(2), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # the draw is of about max_labelled ids, so it may be broadcast; rows that share an id are one example
    found = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, x binary")
    found = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r.doc_id)
    x = np.frombuffer(b"".join(bytes(r.x) for r in found), dtype=np.float32).reshape(len(found), -1).astype(np.float64)
    return fit(x, np.array([r.label for r in found]))


def score(docs: DataFrame, net: Network | None, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the calibrated probability of label 1 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = np.full(batch.num_rows, 0.5) if net is None else net.probability(pool_column(batch.column(1), vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
