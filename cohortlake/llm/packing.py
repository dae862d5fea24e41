"""Harmonic packing of documents into token sequences of a fixed capacity.

A document of at most ``capacity`` tokens belongs to a reciprocal-capacity class by its length: class k has the lengths above
capacity/(k + 1) up to capacity/k, and k whole documents fill a bin of class k, for k up to ``CLASSES``. A longer document
has to be cut in any case: it gives full sequences, and its rest is classed like a document. Each worker fills its own
bins, so packing needs no shuffle.

What a bin of class k lacks, less than capacity/(k + 1) tokens, comes first from documents too short for any class, whole
while they fit, then from a stock of full sequences of long documents, which may be cut anywhere, then from a short document
that is cut. A bin for which none of these is there waits; of more than ``WAITING`` bins one is given up to fill the
others. At the end of a partition the classes' open bins fill the waiting ones, and the last sequence is split into powers of two, which
need no padding. So nothing is padded, whatever the lengths, and a bin costs at most one cut. A worker holds
the stock (``STOCK`` sequences of either kind), the waiting bins and one batch of documents.

Nulls and edges: a null text is empty and packs its end id alone; a null id stays null; repeated rows are packed each;
other columns are ignored; an empty table gives no rows. Sequence ids are unique: the partition's number, then a count.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy
from .encoding import Encoder, default_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([(x, pa.int64()) for x in _COLUMNS])


#: classes of a fixed count of documents; full sequences that are held to fill bins; bins that wait for something to fill them
CLASSES, STOCK, WAITING = 8, 16, 64
#: pieces that an encoder of one task keeps, some 50 MB
SMALL_CACHE = 200_000


def reciprocal_class(length: int, capacity: int, classes: int = CLASSES) -> int:
    """The k of capacity/(k + 1) < length <= capacity/k; 0 for a document too short for any class."""
    k = capacity // length
    return k if k <= classes else 0


class Bins:
    """The bins of one worker. A piece is (document, start, its ids as bytes, the document's tokens)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.waiting: deque[list[tuple]] = deque()
        self.short: deque[tuple] = deque()
        self.long: deque[tuple] = deque()
        self.in_short = self.in_long = 0
        self.rows: list[tuple[int, ...]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        """A document with all its ids, 4 bytes each."""
        n = len(ids) // 4
        full = n - n % self.capacity if n > self.capacity else 0
        held = min(full, max(0, STOCK * self.capacity - self.in_long) // self.capacity * self.capacity)
        for start in range(0, full - held, self.capacity):
            self._close([(doc, start, ids[4 * start : 4 * (start + self.capacity)], n)])
        if held:
            self.long.append((doc, full - held, ids[4 * (full - held) : 4 * full], n))
            self.in_long += held
        if full < n:
            self._class((doc, full, ids[4 * full :], n))
        self._serve()

    def _class(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        if k := reciprocal_class(size, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self.waiting.append(self.open.pop(k))
            return
        self.short.append(piece)
        self.in_short += size
        if self.in_short >= STOCK * self.capacity:
            self._fill([])

    def _gap(self, pieces: list[tuple]) -> int:
        return self.capacity - sum(len(x[2]) // 4 for x in pieces)

    def _serve(self) -> None:
        """Fill the bins that wait, as far as there is something to fill them."""
        while self.waiting and self._gap(self.waiting[0]) <= self.in_short + self.in_long:
            self._fill(self.waiting.popleft())
        if len(self.waiting) > WAITING:
            self._give_up()
            self._serve()

    def _give_up(self) -> None:
        """The documents of the last bin that waits, the one for which least was there, fill others."""
        for piece in self.waiting.pop():
            self.short.append(piece)
            self.in_short += len(piece[2]) // 4

    def _fill(self, pieces: list[tuple]) -> None:
        """Close a bin with what it lacks: short documents while they fit, then part of a long one, then of a short one."""
        gap = self._gap(pieces)
        while gap:
            size = len(self.short[0][2]) // 4 if self.short else 0
            if size and (size <= gap or not self.long):
                doc, start, ids, tokens = self.short.popleft()
                self.in_short -= (taken := min(size, gap))
                if taken < size:
                    self.short.appendleft((doc, start + taken, ids[4 * taken :], tokens))
            else:
                doc, start, ids, tokens = self.long.popleft()
                self.in_long -= (taken := min(len(ids) // 4, gap))
                if 4 * taken < len(ids):
                    self.long.appendleft((doc, start + taken, ids[4 * taken :], tokens))
            pieces.append((doc, start, ids[: 4 * taken], tokens))
            gap -= taken
        self._close(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> None:
        """Fill what waits from the open bins and from one another; what is left becomes sequences of powers of two."""
        for k in sorted(self.open):
            for piece in self.open.pop(k):
                self.short.append(piece)
                self.in_short += len(piece[2]) // 4
        self._serve()
        while self.waiting:
            self._give_up()
            self._serve()
        while self.in_short + self.in_long >= self.capacity:
            self._fill([])
        whole, left = self.capacity, self.in_short + self.in_long
        for j in range(left.bit_length() - 1, -1, -1):
            if left >> j & 1:
                self.capacity = 1 << j
                self._fill([])
        self.capacity = whole


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, keep_encoder: bool = True) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text); ``capacity`` is a power of two.

    ``keep_encoder``: workers keep what they have encoded for their next task; without it a task has a small cache
    (``SMALL_CACHE`` pieces) of its own, for workers that share their memory with much else.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer) if keep_encoder else Encoder(tokenizer, SMALL_CACHE)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def out() -> pa.RecordBatch:
            rows, bins.rows = bins.rows, []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=_ARROW)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices([len(x or "") for x in texts], 1 << 20):
                for name, raw in zip(names[lo:hi], encoder.encode(texts[lo:hi])):
                    bins.add(name, raw + end)
                if len(bins.rows) > 20_000:
                    yield out()
        bins.finish()
        if bins.rows:
            yield out()
        del encoder

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op7_packing": op7_packing}
