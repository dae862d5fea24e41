"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between, hashed to 2^22 places. Each of
up to ``SHARDS`` tasks runs FTRL-proximal over its share of at most ``MAX_TRAIN`` labelled documents (chosen by a hash of the
id): a learning rate for each coordinate, and L1 that leaves most weights zero. Features of fewer than
``MIN_DOCUMENTS`` of its documents are left out, as they only tell documents apart. The tasks' weights are averaged. What is
broadcast are the weights other than zero, some thousands; their number is bounded by the training sample.

Nulls and edges: a null or empty text has no features and scores the bias; null ids and repeated rows are scored each;
rows with a null label don't train; several labels of an id count as their largest; without training rows the score is
0.5; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import crc_remainder, table, tidy
from .quality import chosen_labels

BITS, SHARDS, MAX_TRAIN, EPOCHS = 22, 8, 24_000, 3
#: training rows for each shard at least, and documents in which a feature of a shard occurs at least
SHARD_ROWS, MIN_DOCUMENTS = 2_500, 5
#: fixed values of the learner: rate, its offset, L1, L2; these, EPOCHS and MIN_DOCUMENTS have the least log loss over four
#: folds of training rows (crc32(doc_id as text) mod 5 is not 0, fold by crc32 div 5 mod 4); held-out rows had no part in it
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.01
_SALT = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def places(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of a chunk and the row of each; a feature may come several times."""
    h, doc, shift = w.hash, w.doc, np.uint64(64 - BITS)
    out, rows = [h >> shift], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            inside = doc[gap:] == doc[:-gap]
            out.append(W.mix(h[:-gap] * _SALT[0] + h[gap:] * _SALT[gap])[inside] >> shift)
            rows.append(doc[gap:][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights other than zero, and the bias, after ``epochs`` passes in random order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    seen = np.zeros(bias, np.int32)
    for _, at in rows:
        seen[at] += 1
    rows = [(y, at[seen[at] >= MIN_DOCUMENTS]) for y, at in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0, L1)
        return np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            y, at = rows[i]
            at = np.append(at, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    used = np.flatnonzero(np.abs(z[:bias]) > L1)
    return used, weights(used), float(weights(np.array([bias]))[0])


def train(docs: DataFrame, labels: DataFrame, trainable: Column, label: str = "toxic", max_train: int = MAX_TRAIN) -> dict[str, np.ndarray | float]:
    """The averaged model: sorted places, their weights, the bias."""

    def featurise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = []
            for w in W.of_column(batch["text"], W.BY_LETTER):
                at, doc = places(w)
                both = np.unique((doc << BITS) | at)
                cut = np.searchsorted(both >> BITS, np.arange(w.hi - w.lo + 1))
                at = (both & ((1 << BITS) - 1)).astype("<u4")
                got += [at[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"].cast(pa.int32()), pa.array(got, pa.binary())], names=["doc_id", "y", "places"])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(y, np.frombuffer(x, "<u4").astype(np.int64)) for batch in rows for y, x in zip(batch["y"].to_pylist(), batch["places"].to_pylist())]
        if own:
            at, w, bias = ftrl(own)
            yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["n", "places", "weights", "bias"])

    chosen = chosen_labels(labels, label, max_train, trainable)
    count = max(1, min(SHARDS, chosen.count() // SHARD_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shards = rows.mapInArrow(tidy(featurise), "doc_id long, y int, places binary").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int"))
    dealt = shards.repartitionById(count, F.col("shard")).sortWithinPartitions("doc_id", "places").select("y", "places")
    total, weights, bias = 0, np.zeros(1 << BITS), 0.0
    for r in dealt.mapInArrow(tidy(learn), "n long, places binary, weights binary, bias double").collect():  # at most SHARDS rows
        weights[np.frombuffer(r.places, "<i8")] += r.n * np.frombuffer(r.weights)
        bias += r.n * r.bias
        total += r.n
    at = np.flatnonzero(weights)
    return {"places": at, "weights": weights[at] / max(total, 1), "bias": bias / max(total, 1)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and the probability ``score`` of each row: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[model["places"]] = model["weights"]
        for batch in rows:
            sums = []
            for w in W.of_column(batch["text"], W.BY_LETTER):
                at, doc = places(w)
                used = dense[at] != 0
                both = np.unique((doc[used] << BITS) | at[used])
                sums.append(np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], minlength=w.hi - w.lo))
            logits = np.concatenate(sums) + model["bias"] if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole ``documents``, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)
    got = score(docs, model)
    return got.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
