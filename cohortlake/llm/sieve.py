"""A bitmap of ids, to leave rows out of a join that cannot match: at most 8 MB whatever the table, never a false no.

``sift`` tests rows in Python; ``among`` tests them in Spark, so that rows with long texts need no way to a worker and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, unused
from .words import mix

LARGEST = 1 << 26
PART = 1 << 15


def _place(ids: np.ndarray, bits: int, hashed: bool = False) -> np.ndarray:
    x = ids.view(np.uint64)
    return ((x if hashed else mix(x)) & np.uint64(bits - 1)).astype(np.int64)


def passed(ids: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Which of ``ids`` may be among those of the sieve."""
    at = _place(ids, len(sieve) * 8)
    return (sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def sieve_of(ids: DataFrame, count: int, hashed: bool = False) -> np.ndarray:
    """One byte-packed bit for each hash of the one long column of ``ids``, of which there are about ``count``.

    ``hashed``: the column has hashes.
    """
    bits = PART * 8
    while bits < 16 * count and bits < LARGEST:
        bits *= 2

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, bool)
        for batch in rows:
            out[_place(np.array(batch.column(0).drop_null(), np.int64), bits, hashed)] = True
        packed = np.packbits(out).reshape(-1, PART)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    def both(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((bits // 8 // PART, PART), np.uint8)
    for r in ids.mapInArrow(tidy(own), "part int, bits binary").repartition("part").mapInArrow(tidy(both), "part int, bits binary").collect():  # at most 256 rows
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def sift(df: DataFrame, column: str, sieve: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` may be among the ids; with ``inside=False`` those that are surely not (nulls too)."""
    shared = df.sparkSession.sparkContext.broadcast(sieve)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in rows:
            maybe = passed(np.array(batch[column].fill_null(0), np.int64), packed) & np.array(batch[column].is_valid())
            yield batch.filter(pa.array(maybe == inside))

    return df.mapInArrow(tidy(run), df.schema)


def among(df: DataFrame, column: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` may be among the one column of ``ids`` (a written table; rows may repeat).

    With ``inside=False`` those that are surely not (nulls too).
    """
    bits = unused(df.columns, "sieve_bits")
    packed = sieve_of(ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long")).alias("h")), ids.count(), hashed=True)
    row = pa.ListArray.from_arrays(pa.array([0, len(packed) // 8], pa.int32()), pa.array(packed.view("<i8")))
    sieve = df.sparkSession.createDataFrame(pa.table({bits: row}))
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(len(packed) * 8))
    word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(7)).cast("int")  # packed from the high bit of each byte
    return df.join(F.broadcast(sieve), F.col(column).isNotNull() & (F.getbit(F.col(bits)[word], bit) == 1), "left_semi" if inside else "left_anti")
