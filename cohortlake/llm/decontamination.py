"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned over the token windows of the corpus.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words are
lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A document word inside any occurrence of a
window is hit. A hash hit counts only after its words compare equal.

The set is broadcast in blocks of at most ``max_windows`` (window, item) pairs, a bound that is checked by a count: a
benchmark beyond it is scanned block by block over the same documents, with the hits written in between.

Nulls and edges: a null or empty text has no words and no hits; a null id is kept; items without words or without an id
match nothing; repeated items count once by id; extra columns pass through ``mark``; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import materialise, table, tidy

#: names of the columns that ``mark`` adds
WORDS, HITS, BITS, ITEMS = "decon_words", "decon_hits", "decon_bits", "decon_items"
_ADDED = f"{WORDS} long, {HITS} long, {BITS} binary, {ITEMS} array<long>"
_ADDED_ARROW = [pa.field(WORDS, pa.int64()), pa.field(HITS, pa.int64()), pa.field(BITS, pa.binary()), pa.field(ITEMS, pa.list_(pa.int64()))]


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(hash, size, words, item_id) of each distinct window of each item."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for w in W.of_column(batch.column(1), W.BY_LETTER):
                for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    size = min(n, b - a)
                    if size:
                        for i, h in enumerate(W.windows(w.hash[a:b], size).tolist()):
                            out.append((h - 2**63, size, w.text(a + i, a + i + size), ids[w.lo + r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["hash", "size", "words", "item_id"])

    return items.select("item_id", "text").where("item_id is not null").mapInArrow(tidy(run), "hash long, size int, words binary, item_id long").distinct()


class Block:
    """A broadcast block: for each window size its sorted hashes, and the words and items of each hash."""

    def __init__(self, rows: list) -> None:
        self.words: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        self.items: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        sizes: dict[int, set[int]] = defaultdict(set)
        for h, size, text, item in rows:
            sizes[size].add(h + 2**63)
            self.words[size, h + 2**63].add(bytes(text))
            self.items[size, bytes(text)].append(item)
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in sizes.items()}
        self.sieves = {}
        for k, v in self.hashes.items():
            self.sieves[k] = np.zeros(1 << 20, bool)
            self.sieves[k][v >> np.uint64(44)] = True

    def scan(self, w: W.Words) -> tuple[np.ndarray, list[set[int]]]:
        """The hit words of a chunk, and for each row the items found."""
        hit = np.zeros(len(w.hash) + 1, np.int32)
        found: list[set[int]] = [set() for _ in range(w.hi - w.lo)]
        for size, known in self.hashes.items():
            got = W.windows(w.hash, size)
            if not len(got):
                continue
            at = np.flatnonzero(self.sieves[size][got >> np.uint64(44)] & (w.doc[: len(got)] == w.doc[size - 1 :]))
            at = at[known[np.minimum(np.searchsorted(known, got[at]), len(known) - 1)] == got[at]]
            for i in at.tolist():
                text = w.text(i, i + size)
                if text in self.words[size, int(got[i])]:
                    hit[i] += 1
                    hit[i + size] -= 1
                    found[w.doc[i]].update(self.items[size, text])
        return np.cumsum(hit)[:-1] > 0, found


def mark(docs: DataFrame, items: DataFrame, n: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """``docs`` with counts of words and hit words, a bit for each word, and the items found.

    A column of ``docs`` that has the name of an added one gives way to it.
    """
    added = {WORDS, HITS, BITS, ITEMS}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in added))
    spark, windows = docs.sparkSession, item_windows(items, n)
    total = windows.count()
    blocks = max(1, -(-total // max_windows))
    if blocks > 1:
        windows = materialise(windows, "windows")
    names = docs.columns
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("hash", "item_id"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(Block(part.collect()))  # at most about max_windows rows, counted above
        docs = _scan(docs, block, names, first=k == 0)
        if k + 1 < blocks:
            docs = materialise(docs, "marked")
    return docs


def _scan(docs: DataFrame, block, names: list[str], first: bool) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = batch.columns[: len(names)]
            bits, found, counts, hits = [], [], [], []
            for w in W.of_column(own[names.index("text")], W.BY_LETTER):
                hit, items = block.value.scan(w)
                for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    row = hit[a:b]
                    if not first:
                        row = row | np.unpackbits(np.frombuffer(batch[BITS][w.lo + r].as_py(), np.uint8), count=b - a).astype(bool)
                        items[r].update(batch[ITEMS][w.lo + r].as_py())
                    bits.append(np.packbits(row).tobytes())
                    found.append(sorted(items[r]))
                    counts.append(b - a)
                    hits.append(int(np.count_nonzero(row)))
            new = [pa.array(x, f.type) for x, f in zip((counts, hits, bits, found), _ADDED_ARROW)]
            yield pa.RecordBatch.from_arrays([*own, *new], schema=pa.schema([*list(batch.schema)[: len(names)], *_ADDED_ARROW]))

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(names)])
    return docs.mapInArrow(tidy(run), f"{fields}, {_ADDED}")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, drop_above: float = 0.5, max_windows: int = 1_000_000) -> DataFrame:
    """``docs`` without the spans of hit words; documents of which more than ``drop_above`` is hit go altogether."""
    schema = docs.schema
    docs = docs.toDF(*(c if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)))  # apart from the names that are added
    names = docs.columns
    at = names.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts: list[str | None] = batch.column(at).to_pylist()
            if any(batch[HITS].to_pylist()):
                for w in W.of_column(batch.column(at), W.BY_LETTER):
                    for r in range(w.hi - w.lo):
                        if batch[HITS][w.lo + r].as_py():
                            a, b = int(w.first[r]), int(w.first[r + 1])
                            hit = np.unpackbits(np.frombuffer(batch[BITS][w.lo + r].as_py(), np.uint8), count=b - a)
                            raw = texts[w.lo + r].encode()
                            base = int(w.row_start[r])
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                            kept, last = [], 0
                            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                                kept.append(raw[last : int(w.start[a + i]) - base])
                                last = int(w.end[a + j - 1]) - base
                            texts[w.lo + r] = b"".join([*kept, raw[last:]]).decode()
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    marked = mark(docs, items, n, max_windows).where(F.col(HITS) <= drop_above * F.col(WORDS))
    return marked.mapInArrow(tidy(run), docs.schema).toDF(*schema.names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` in whole ``documents``, a row for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform(ITEMS, lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col(WORDS).alias("n_words"), F.col(HITS).alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col(HITS) > 0).alias("contaminated"))


QUERIES = {"op3_decontamination": op3_decontamination}
