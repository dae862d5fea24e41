"""Order MinHash fingerprints: sensitive to edit distance, not only to which k-mers a text holds.

A text's k-mers (runs of k characters) are numbered by occurrence, so that each pair (k-mer, occurrence) is unique. For
each of m hash functions the ``l`` pairs with the smallest hashes are taken, put back into text order, and the tuple is
hashed: one 32-bit entry of the fingerprint. Two texts agree in an entry when they share the minimal pairs and their
order, so the share of equal entries is a likeness that falls with insertions, deletions and moves.

Nulls and edges: a null text is empty; a text of fewer than k characters is one k-mer; fewer than ``l`` pairs are taken
all. Equal texts have equal fingerprints, on every machine. In ``edited_pairs`` rows that repeat an id are neighbours in
text order; a null id comes last; an only row is its own next; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import mix

HASHES, PAIR, K = 32, 2, 8
_rng = np.random.default_rng(77)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_C = _rng.integers(1, 2**63, PAIR, dtype=np.uint64) | np.uint64(1)
_P = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of each run of k code points, by doubling; k is a power of two."""
    x = points.astype(np.uint32) * np.uint32(_P[0]) + np.uint32(_P[4])
    width, j = 1, 1
    while width < k and len(x) > width:
        x = x ^ (x >> np.uint32(15))
        x = x[:-width] * np.uint32(_P[j % 4]) + x[width:] * np.uint32(_P[(j + 1) % 4])
        width, j = 2 * width, j + 1
    if width < k:  # a text shorter than k is one k-mer
        x = x[:0] if not len(points) else np.array([int(mix(points.astype(np.uint64) * np.arange(1, len(points) + 1, dtype=np.uint64) + np.uint64(len(points))).sum(dtype=np.uint64)) & 0xFFFFFFFF], np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return x ^ (x >> np.uint32(15))


def numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence): the first occurrence keeps the k-mer's hash."""
    both = np.sort((kmers.astype(np.uint64) << np.uint64(32)) | np.arange(len(kmers), dtype=np.uint64))
    order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    s = (both >> np.uint64(32)).astype(np.uint32)
    again = s[1:] == s[:-1]
    if not again.any():
        return kmers
    start = np.flatnonzero(np.concatenate([[True], ~again]))
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    out = kmers.copy()
    late = nth > 0
    where = order[late]
    x = kmers[where] ^ (nth[late].astype(np.uint32) * np.uint32(0x9E3779B9))
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out[where] = x ^ (x >> np.uint32(13))
    return out


def fingerprint(text: str) -> np.ndarray:
    """HASHES entries of 32 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    pairs = numbered(kmer_hashes(points))
    n = len(pairs)
    if not n:
        return np.zeros(HASHES, np.uint32)
    take = min(PAIR, n)
    places = np.empty((HASHES, take), np.int64)
    step = HASHES if n <= 1 << 14 else 1  # of a long text one hash function at a time
    for lo in range(0, HASHES, step):
        some = slice(lo, lo + step)
        h = pairs * _A[some, None]
        h += _B[some, None]
        for j in range(take):
            places[some, j] = least = h.argmin(axis=1)
            h[np.arange(len(h)), least] = 2**32 - 1
    places.sort(axis=1)
    got = (pairs[places].astype(np.uint64) * _C[:take]).sum(axis=1, dtype=np.uint64)
    return (mix(got + np.arange(HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.count_nonzero(x == y)) / len(x)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as lowercase hex) of each document: one pass, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [fingerprint(x or "").astype(">u4").tobytes().hex() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the next."""
    n = len(text)
    return text[: n - n // 3] + following[: n // 3]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document with its edited text and its next document, by descending id; after the last comes the first.

    The ids are cut into ranges at quantiles. The texts are shuffled once, to their range; the first document of each
    range goes to the range before as well, so that no task needs another's rows. What returns to the driver is one id
    for each range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    null_range = len(cuts) + 1
    bucket = F.lit(0)
    if cuts:
        # rank of the id among the cuts, from the top: descending ids give ascending ranges
        bucket = F.lit(len(cuts)) - F.expr(f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < doc_id))")
    ranged = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(null_range)).otherwise(bucket).cast("int"))
    heads = ranged.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()  # a row for each range
    present = sorted(r.bucket for r in heads)
    if not present:
        return spark.createDataFrame([], _OUT)
    # one flagged copy of each head goes to the range before
    to = [(r.bucket, r["head"], present[present.index(r.bucket) - 1]) for r in heads]
    heads = F.broadcast(spark.createDataFrame(to, "bucket int, head long, to int"))
    own = (ranged["bucket"] == F.col("of")) & ranged["doc_id"].eqNullSafe(F.col("head"))
    copies = ranged.join(heads.withColumnRenamed("bucket", "of"), own).groupBy("to", "bucket", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    copies = copies.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    both = ranged.select("doc_id", "text", "bucket", F.lit(False).alias("copy")).unionByName(copies)
    dealt = both.repartitionById(null_range + 1, F.col("bucket")).sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in rows:
            out = []
            for doc, text, b, copy in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                print_ = fingerprint(text)
                if last is not None and last[2] == b:
                    out.append(_row(*last[:2], last[3], text, print_))
                last = None if copy else (doc, text, b, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return dealt.mapInArrow(run, _OUT)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _OUT.split(", ")]


def _row(doc: int | None, text: str, own: np.ndarray, following: str, following_print: np.ndarray) -> tuple:
    new = edited(text, following)
    new_print = fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), sha, own.astype(">u4").tobytes().hex(), new_print.astype(">u4").tobytes().hex(), likeness(own, new_print), likeness(own, following_print)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole ``documents`` and of their edited texts."""
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
