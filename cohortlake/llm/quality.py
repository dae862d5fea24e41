"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network.

1. Random indexing. Each word hashes to one of ``BUCKETS`` buckets with a fixed sparse ternary index vector; a bucket's
   context vector is the sum of the index vectors of the words within two places, over the whole corpus. Tasks sum their
   own rows; the sums of tasks are added by bucket block, a block at a time. The result is BUCKETS x SIZE numbers,
   whatever the corpus, and so can be broadcast.
2. Pooling. A document is the mean and the standard deviation of its words' normed vectors, the mean likeness of
   neighbouring words, and the logarithm of its length. One pass, no shuffle; the rows are written.
3. A network with one hidden layer, in numpy, on at most ``MAX_TRAIN`` labelled rows (chosen by a hash of the id, the
   same on every run); a fifth of them is kept back to fit the temperature that calibrates the probabilities.

Nulls and edges: a null or empty text pools to zeros and gets the score of that; null ids and repeated rows are scored
each; rows with a null label don't train; several labels of an id count as their largest; without labels of both kinds
every score is the share of label 1 (0.5 without any); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import crc_remainder, hash_sample, materialise, table, tidy

BUCKETS, SIZE, NONZERO, REACH, BLOCK = 1 << 14, 32, 4, 2, 256
FEATURES = 2 * SIZE + 3
MAX_TRAIN = 20_000
_rng = np.random.default_rng(11)
_PLACE = np.argsort(_rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
_SIGN = np.where(_rng.random((BUCKETS, NONZERO)) < 0.5, -1.0, 1.0)


def _bucket(w: W.Words) -> np.ndarray:
    return (w.hash >> np.uint64(50)).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of each bucket over all texts, less the mean, normed to length 1."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * SIZE)
        for batch in rows:
            for w in W.of_column(batch.column(0), W.WITH_MARKS, target=1 << 19):
                b = _bucket(w)
                for gap in range(1, REACH + 1):
                    near = w.doc[gap:] == w.doc[:-gap]
                    left, right = b[:-gap][near], b[gap:][near]
                    for to, of in ((left, right), (right, left)):
                        at = (to[:, None] * SIZE + _PLACE[of]).ravel()
                        total += np.bincount(at, _SIGN[of].ravel(), minlength=BUCKETS * SIZE)
        blocks = total.astype(np.int64).reshape(-1, BLOCK * SIZE)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    sums = docs.select("text").mapInArrow(tidy(count), "block int, sums binary").repartition("block").mapInArrow(tidy(add), "block int, sums binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK * SIZE))
    for r in sums.collect():  # at most BUCKETS / BLOCK rows
        out[r.block] = np.frombuffer(r["sums"], np.int64)
    out = out.reshape(BUCKETS, SIZE)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    seen = size[:, 0] > 0
    if seen.any():
        out[seen] -= out[seen].mean(axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)
    return out.astype(np.float32)


def pooled(w: W.Words, vectors: np.ndarray) -> np.ndarray:
    """The features of each row of a chunk."""
    rows = w.hi - w.lo
    n = np.diff(w.first)
    out = np.zeros((rows, FEATURES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        x = vectors[_bucket(w)]
        starts, count = w.first[some], n[some][:, None]
        mean = np.add.reduceat(x, starts, axis=0) / count
        square = np.add.reduceat(x * x, starts, axis=0) / count
        alike = np.einsum("ij,ij->i", x[:-1], x[1:], dtype=np.float32) * (w.doc[1:] == w.doc[:-1])
        alike = np.append(alike, np.float32(0))
        out[some, :SIZE] = mean
        out[some, SIZE : 2 * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -3] = np.add.reduceat(alike, starts) / np.maximum(count[:, 0] - 1, 1)
        out[some, -2] = np.sqrt((mean * mean).sum(axis=1))
        out[some, -1] = np.log1p(count[:, 0])
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """The columns of ``docs`` but the text, and ``features`` (float32 values as bytes)."""
    keep = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [x.tobytes() for w in W.of_column(batch["text"], W.WITH_MARKS) for x in pooled(w, shared.value)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(got, pa.binary())], names=[*keep, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(tidy(run), f"{schema}, features binary")


@dataclass
class Network:
    """Probability of label 1: standardised input, a hidden layer of tanh units, temperature on the last logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on the log loss with weight decay; the temperature minimises the log loss of the rows kept back."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    size = x.shape[1]
    flat = Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < y.sum() < len(y):
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
            h = np.tanh(z[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -35, 35))) - y[part]) / len(part)
            back = error[:, None] * params[2] * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], error.sum(keepdims=True)]
            t += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, -(2 * truth - 1) * logits / s))
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def chosen_labels(labels: DataFrame, label: str, limit: int, trainable: Column) -> DataFrame:
    """(doc_id, y) of at most about ``limit`` labelled ids: few enough to broadcast."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & trainable)
    return hash_sample(chosen.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id", limit)


def score_quality(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, max_train: int = MAX_TRAIN, label: str = "quality") -> DataFrame:
    """``doc_id`` and ``score`` of each row of ``docs``, after learning from the ``trainable`` labels."""
    docs = docs.select("doc_id", "text")
    pooled_rows = materialise(features(docs, context_vectors(docs)), "features")
    net = learn(pooled_rows, labels, trainable, max_train, label)
    return apply(pooled_rows, net)


def learn(rows: DataFrame, labels: DataFrame, trainable: Column | None, max_train: int, label: str) -> Network:
    chosen = chosen_labels(labels, label, max_train, F.lit(True) if trainable is None else trainable)
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "y").collect()  # bounded by max_train
    got = sorted(got, key=lambda r: (r.doc_id, r["features"]))
    x = np.array([np.frombuffer(r["features"], np.float32) for r in got]).reshape(len(got), FEATURES)
    return train(x, np.array([r.y for r in got]))


def apply(rows: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """``rows`` with the probability in place of the features."""
    keep = [c for c in rows.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["features"].to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(net.probability(x.astype(np.float64)), pa.float64())], names=[*keep, column])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "features")
    return rows.mapInArrow(tidy(run), f"{schema}, {column} double")


def keep_quality(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, at_least: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that score at least ``at_least``, columns unchanged: pooled again in the same pass as scored."""
    texts = docs.select("doc_id", "text")
    vectors = context_vectors(texts)
    net = learn(materialise(features(texts, vectors), "features"), labels, trainable, max_train, "quality")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            vectors, net = shared.value
            x = [pooled(w, vectors) for w in W.of_column(batch["text"], W.WITH_MARKS)]
            if x:
                yield batch.filter(pa.array(net.probability(np.concatenate(x).astype(np.float64)) >= at_least))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole ``documents``, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    got = score_quality(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)
    return got.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
