"""Document quality by a byte-level convolutional network in numpy.

A filter sees WIDTH bytes: its response at a position is the sum of one learned
weight per byte value and offset. A text is covered by chunks of CHUNK positions
that overlap by OVERLAP; each chunk keeps the largest response of every filter.
The chunks' values, squashed, are combined by mean and by maximum over the
document, and a linear layer gives one probability.

Training is plain back-propagation with Adam on the driver, from at most
`sample` labelled documents and `per_doc` chunks of each (both bounds are
parameters); everything that is scored is scored over its whole text.

Defined cases: null and empty texts are one chunk of padding and get a score;
repeated rows score alike; repeated labels of a document count once, the larger;
with labels of one class or none every score is the share of label 1 (a half
without labels); no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back, small_batches

WIDTH, FILTERS, CHUNK, OVERLAP, SUB = 5, 16, 256, 64, 64
STEP = CHUNK - OVERLAP
FOLDS, HELD = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def chunk_count(size: int) -> int:
    return max(1, -(-(size - OVERLAP) // STEP))


def pick_chunks(data: bytes, most: int) -> list[bytes]:
    """At most `most` of a text's chunks, evenly spread, padded with zero bytes."""
    n = chunk_count(len(data))
    chosen = sorted({int(x) for x in np.linspace(0, n - 1, min(n, most))})
    size = CHUNK + WIDTH - 1
    return [data[c * STEP:c * STEP + size].ljust(size, b"\0") for c in chosen]


class Net:
    def __init__(self, seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.table = rnd.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rnd.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        r = self.table[0].take(data[:n], axis=0)
        for k in range(1, WIDTH):
            r += self.table[k].take(data[k:k + n], axis=0)
        return r

    def score(self, data: bytes) -> float:
        """Probability of label 1 for a whole text."""
        if self.constant is not None:
            return self.constant
        n = chunk_count(len(data))
        raw = np.zeros(n * STEP + OVERLAP + WIDTH - 1, np.uint8)
        raw[:len(data)] = np.frombuffer(data, np.uint8)
        subs, total = [], n * STEP + OVERLAP
        for at in range(0, total, 1 << 15):  # a multiple of SUB
            end = min(total, at + (1 << 15))
            subs.append(self.responses(raw[at:end + WIDTH - 1]).reshape(-1, SUB, FILTERS).max(axis=1))
        sub = np.concatenate(subs)
        per = STEP // SUB
        pooled = sub[::per][:n]
        for k in range(1, CHUNK // SUB):
            pooled = np.maximum(pooled, sub[k::per][:n])
        h = np.tanh(pooled + self.bias)
        z = float(np.concatenate([h.mean(axis=0), h.max(axis=0)]).astype(np.float64) @ self.out + self.offset[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def train(self, docs: list[list[bytes]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        rnd = np.random.default_rng(seed)
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        params = [self.table, self.bias, self.out, self.offset]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        for epoch in range(epochs):
            order = rnd.permutation(len(docs))
            lr = rate * (1 - epoch / epochs)
            for at in range(0, len(docs), batch):
                mine = order[at:at + batch]
                data = np.frombuffer(b"".join(b"".join(docs[d]) for d in mine), np.uint8).reshape(-1, CHUNK + WIDTH - 1)
                owner = np.repeat(np.arange(len(mine)), [len(docs[d]) for d in mine])
                sizes = np.bincount(owner, minlength=len(mine)).astype(np.float32)
                r = np.zeros((len(data), CHUNK, FILTERS), np.float32)
                for k in range(WIDTH):
                    r += self.table[k].take(data[:, k:k + CHUNK], axis=0)
                where = r.argmax(axis=1)
                h = np.tanh(np.take_along_axis(r, where[:, None], axis=1)[:, 0] + self.bias)
                mean = np.zeros((len(mine), FILTERS), np.float32)
                np.add.at(mean, owner, h)
                mean /= sizes[:, None]
                top = np.full((len(mine), FILTERS), -2, np.float32)
                np.maximum.at(top, owner, h)
                feats = np.concatenate([mean, top], axis=1)
                p = 1 / (1 + np.exp(-np.clip(feats @ self.out + self.offset[0], -40, 40)))
                g = ((p - labels[mine]) * weight[mine] / len(mine)).astype(np.float32)
                gh = (g[owner] / sizes[owner])[:, None] * self.out[:FILTERS]
                gh += g[owner][:, None] * self.out[FILTERS:] * (h == top[owner])
                gr = gh * (1 - h * h)
                gt = np.zeros_like(self.table)
                rows, cols = np.arange(len(data))[:, None], np.arange(FILTERS)[None]
                for k in range(WIDTH):
                    np.add.at(gt[k], (data[rows, where + k], np.broadcast_to(cols, where.shape)), gr)
                grads = [gt, gr.sum(axis=0), feats.T @ g, np.array([g.sum()], np.float32)]
                step += 1
                for q, m, v, d in zip(params, first, second, grads):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    q -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, per_doc: int = 12, seed: int = 5) -> Net:
    """A net from labels(doc_id, quality) of documents outside the held-out fold.

    The sample is the `sample` labelled documents with the smallest hashes, so
    it doesn't depend on order. `per_doc` bounds the chunks that are learnt from of each,
    evenly spread over its text: both are bounds of the training sample alone. At most
    sample * per_doc chunks reach the driver, rows of one doc_id are one before that."""
    known = (
        labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chunks = [pick_chunks((t or "").encode("utf-8", "surrogatepass"), per_doc) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "chunks": chunks})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").mapInPandas(cut, "doc_id long, quality int, chunks array<binary>")
    rows = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("chunks").alias("chunks")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    net = Net(seed)
    net.train([[bytes(c) for c in r["chunks"]] for r in rows], np.array([r["quality"] for r in rows], np.float32), seed=seed)
    return net


def score(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [net.score((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, net: Net, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    names, schema = docs.columns, docs.schema
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            good = [net.score((t.as_py() or "").encode("utf-8", "surrogatepass")) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, schema)
