"""Byte-level BPE in numpy: batched merge rounds over the symbols of many words, and decoding by a byte table.

A text is cut where the tokenizer always cuts (before a space that follows a visible character), each distinct piece is
encoded once while it stays in a worker's cache, and the words of all new pieces are merged together: their symbols lie in
one flat array; in a round every pair of neighbours is looked up by binary search among the sorted keys of the 50,000
mergeable pairs, each word merges all places of its lowest-ranked pair from the left, and words without a mergeable pair
leave the array. This equals merging one pair at a time, as every merge makes a symbol of its own and a merge that uses a
symbol ranks after the one that makes it; both are checked when the file is read. A round touches the whole of a word,
so a word of more than ``LONG`` bytes is merged with a queue of its pairs instead.

Strings of added tokens (``<|endoftext|>``) in a text become their id, as in the tokenizers library; ``added=False`` makes
them ordinary text. Truncation and padding settings of the file have no effect here.

Nulls and edges: a null text is empty and has no ids; a null id stays null; rows that repeat are kept; other columns are
ignored; an empty table gives no rows. Texts of any length are encoded whole: a task holds the text, its ids, and a cache of
bounded size. Nothing is broadcast but the path, and nothing is returned to the driver.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy
from .encoding import Encoder, default_tokenizer

#: the public pattern of this kind of tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: longer words go through a queue, as the rounds of one word would all pass over its whole length
LONG = 1_024
#: bytes of words that are merged together
AT_ONCE = 1 << 20
_NONE = np.iinfo(np.int64).max
_encoders: dict[tuple[str, bool], MergeEncoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Merges:
    """The pairs of a vocabulary file as sorted keys with rank and product, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, vocab = file["model"], file["model"]["vocab"]
        if model["type"] != "BPE" or file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level BPE without normaliser and leading space")
        letters = byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        made = np.full(max(vocab.values()) + 1, -1)
        made[ids[:, 2]] = np.arange(len(ids))
        if len(np.unique(ids[:, 2])) != len(ids) or (made[ids[:, :2]].max(axis=1, initial=-1) >= np.arange(len(ids))).any():
            raise ValueError(f"{path}: merges that share a product or precede their parts")
        self.base = len(made)
        keys = ids[:, 0] * self.base + ids[:, 1]
        self.rank = np.argsort(keys)
        self.keys, self.product = keys[self.rank], ids[self.rank, 2]
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = {c: i for i, c in enumerate(letters)}
        words = {i: bytes(byte[c] for c in token) for token, i in vocab.items()} | {i: token.encode() for token, i in self.added.items()}
        self.words = [words.get(i, b"") for i in range(max(words) + 1)]  # an id without a token decodes to nothing

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, a large one where there is none, and its place among the sorted keys."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank, at = self.look_up(symbol[:-1], symbol[1:])
            rank[word[:-1] != word[1:]] = _NONE
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            open_ = lowest != _NONE
            merged = np.flatnonzero(open_ & (rank == lowest))
            # of places that overlap (a symbol repeated), every second one from the left
            head = np.append(True, np.diff(merged) != 1) if len(merged) else np.zeros(0, bool)
            since = np.arange(len(merged)) - np.maximum.accumulate(np.where(head, np.arange(len(merged)), 0))
            merged = merged[since % 2 == 0]
            symbol[merged] = self.product[at[merged]]
            keep = np.ones(len(symbol), bool)
            keep[merged + 1] = False
            if not open_.all():
                done.append((word[~open_], symbol[~open_]))
                keep &= open_
            symbol, word = symbol[keep], word[keep]
        if not done:
            return [b""] * len(words)
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        raw = symbol[order].astype("<u4").tobytes()
        cut = np.append(0, np.cumsum(np.bincount(word, minlength=len(words)))) * 4
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one long word: its pairs in a queue by rank and place, n log n steps."""
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        rank, at = self.look_up(np.array(symbol[:-1]), np.array(symbol[1:]))
        n, keys, base = len(symbol), self.keys, self.base
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbol[i], symbol[i + 1], a) for i, (r, a) in enumerate(zip(rank.tolist(), at.tolist())) if r != _NONE]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, a = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbol[i] != left or symbol[j] != right:
                continue  # a neighbour has changed since
            symbol[i], symbol[j] = int(self.product[a]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    key = symbol[k] * base + symbol[after[k]]
                    a = int(np.searchsorted(keys, key))
                    if a < len(keys) and keys[a] == key:
                        heapq.heappush(queue, (int(self.rank[a]), k, symbol[k], symbol[after[k]], a))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()


class MergeEncoder(Encoder):
    """The cutting and caching of ``Encoder`` over ``Merges``; equal to the library's ``encode`` and ``decode``."""

    def __init__(self, path: str, added: bool = True, cache_size: int = 600_000) -> None:
        import regex

        self.merges = Merges(path)
        self.words = regex.compile(PATTERN).findall
        self.added = self.merges.added if added else {}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache, self.cache_size = {}, cache_size

    @classmethod
    def of(cls, path: str, added: bool = True) -> MergeEncoder:
        """One encoder for each Python worker."""
        if (path, added) not in _encoders:
            _encoders[path, added] = cls(path, added)
        return _encoders[path, added]

    @staticmethod
    def forget() -> None:
        _encoders.clear()

    def _split(self, piece: str) -> list[str]:
        """The words of a piece; an added token is one of them."""
        if self.around is None or self.around.search(piece) is None:
            return self.words(piece)
        return list(chain.from_iterable([p] if p in self.added else self.words(p) for p in self.around.split(piece)))

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        split = [self._split(p) for p in pieces]
        known = {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        new = list(set(chain.from_iterable(split)).difference(known))
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        for lo, hi in slices([len(raw[i]) for i in short], AT_ONCE):
            some = short[lo:hi]
            known.update(zip([new[i] for i in some], self.merges.merge([raw[i] for i in some])))
        known.update((new[i], self.merges.merge_long(w)) for i, w in enumerate(raw) if len(w) > LONG)
        for words in split:
            yield known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def _learn(self, parts: list[str]) -> None:
        for lo in range(0, len(parts), 50_000):
            some = parts[lo : lo + 50_000]
            self.cache.update(zip(some, self._ids([f" {x}" for x in some])))

    def decode(self, ids: bytes) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers; bytes that are no UTF-8 become U+FFFD."""
        words, n = self.merges.words, len(self.merges.words)
        values = np.frombuffer(ids, "<u4")
        values = values[values < n] if values.size and values.max() >= n else values
        return b"".join([words[i] for i in values.tolist()]).decode("utf-8", "replace")


def _by_text(encoder: Callable[[], MergeEncoder], work: Callable[[MergeEncoder, list], Iterable[tuple]], column: int, cost: Callable[[object], int], schema: pa.Schema) -> Callable:
    """A task over batches whose first columns are passed on and whose column ``column`` is worked on in small groups."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder()
        for batch in rows:
            values = batch.column(column).to_pylist()
            for lo, hi in slices([cost(v) for v in values], 1 << 20):
                made = list(zip(*work(one, values[lo:hi])))
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(schema) - len(made))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(m, f.type) for m, f in zip(made, list(schema)[len(arrays) :]))], schema=schema)

    return tidy(run)


_IDS = [("n_tokens", pa.int64()), ("ids", pa.binary())]
_TEXT = [("decoded", pa.string())]


def encode(docs: DataFrame, tokenizer: str, added: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text, as little-endian unsigned 32-bit integers."""
    work = lambda e, texts: [(len(x) // 4, x) for x in e.encode(texts)]
    task = _by_text(lambda: MergeEncoder.of(tokenizer, added), work, 1, lambda t: len(t or ""), pa.schema([("doc_id", pa.int64()), *_IDS]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, decoded) of rows as ``encode`` makes them; null ids decode to an empty text."""
    work = lambda e, ids: [(e.decode(x or b""),) for x in ids]
    task = _by_text(lambda: MergeEncoder.of(tokenizer), work, 2, lambda x: len(x or b""), pa.schema([("doc_id", pa.int64()), _IDS[0], *_TEXT]))
    return encoded.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), "ids").mapInArrow(task, "doc_id long, n_tokens long, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, added: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): both directions in one pass, the text decoded from the ids."""

    def work(e: MergeEncoder, texts: list[str | None]) -> list[tuple[int, bytes, str]]:
        return [(len(x) // 4, x, e.decode(x)) for x in e.encode(texts)]

    task = _by_text(lambda: MergeEncoder.of(tokenizer, added), work, 1, lambda t: len(t or ""), pa.schema([("doc_id", pa.int64()), *_IDS, *_TEXT]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids binary, decoded string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` encoded and decoded."""
    both = round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_bpe": op12_bpe}
