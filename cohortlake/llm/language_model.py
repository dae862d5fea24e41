"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Restaurants. Every context (the word before, or the start of a document) is a Chinese restaurant whose customers are the
words that follow it; each of its tables is a customer of the one unigram restaurant that all contexts share as parent,
whose own base is uniform over the known words and one unknown. Predictive probability:
P(w|u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u), and likewise for P(w) with the tables as its customers.

Sampling. Seats are sampled by Gibbs: a customer leaves its table and sits down again, at a table in proportion to its
size less the discount, or at a new one in proportion to (s + d t_u) P(w). A sweep moves customers of all dishes at once
in numpy; between sweeps the unigram restaurant is seated anew. Work is dealt by word, so that a word's dish in the
parent is local to its task; totals of a context over all tasks are those of the round before, summed by context in
tasks of their own and sent back to the word ranges that have the context. Means over the sampled
seatings after burn-in give the averaged predictive probabilities. Discounts follow from how many dishes have one and two
customers. Seeds follow from the word range, so a task that runs again draws the same seats.

Spark. (1) The most frequent words are found (at most ``HOT``). (2) Each task counts its documents' (word, context) pairs
in numpy and sends for each word range one row of packed arrays: the pairs, their contexts, and in which documents they
occur; a task merges those of its range, so that it holds each pair once. (3) Seating rounds run over the merged pairs;
what comes back to the driver is a vector of some numbers, and the contexts' totals go by shuffle. (4) The pairs are scored
where they occur; sums for each document meet by document group.
Frequent words: their pairs are spread over all tasks by (word, context); where they occur stays with the documents,
which get back one number for each pair. So no task's rows follow one word or pair, and of a very frequent context each
word range has one number.

Words are lower-cased (A-Z) runs of anything but ASCII white space, and one end for each document, by 64-bit hashes.

Nulls and edges: a null or empty text is its end alone; a null id is a training row (its id counts as empty text) and stays
null; repeated rows count and are scored each; extra columns are ignored; without training documents all words are unknown;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import forget_shuffles, materialise, table, tidy

#: bits of a context's number in the keys of a word range; one with more contexts takes more
CONTEXT_BITS = 15
CONTEXTS = 1 << CONTEXT_BITS
HOT, HOT_SHARE = 64, 1 / 256
GROUP_TOKENS, GROUP_DOCS = 2_000_000, 60_000
STRENGTH = 1.0
#: sweeps before the first sampled seating, sampled seatings, moves of each dish in a sweep
BURN, SAMPLES, MOVES = 3, 4, 2
_END, _START = np.uint64(0xC3A5C85C97CB3127), np.uint64(0xB492B66FBE98F273)
_NULL = -(2**63)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of their bytes, as many as the largest needs, compressed."""
    wide = int(values.max()).bit_length() + 7 >> 3 if len(values) else 0
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()
    return b"".join([len(values).to_bytes(8, "little"), wide.to_bytes(1, "little"), pa.compress(planes, "zstd", asbytes=True) if planes else b""])


def unpack(raw: bytes) -> np.ndarray:
    n, wide = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros((n, 8), np.uint8)
    if n * wide:
        out[:, :wide] = np.frombuffer(pa.decompress(raw[9:], n * wide, "zstd"), np.uint8).reshape(wide, n).T
    return out.view("<i8").ravel()


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Ascending hashes by their steps."""
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value of a sorted array starts, and how often it comes."""
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))


def hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes of at most HOT words that are a large share of all; they only choose routes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for w in W.of_column(batch.column(0), W.BY_SPACE):
                values, n = np.unique(w.hash, return_counts=True)
                values, n = np.append(values, _END), np.append(n, w.hi - w.lo)
                some = n * 2 >= HOT_SHARE * n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some]), pa.array(np.full(some.sum(), 0))], names=["word", "n", "total"])
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([int(n.sum())])], names=["word", "n", "total"])

    counts = docs.select("text").mapInArrow(run, "word long, n long, total long").groupBy("word").sum("n", "total").toDF("word", "n", "total").persist()
    total = counts.groupBy().sum("total").first()[0] or 0
    top = counts.where(f"n > 0 and n >= {HOT_SHARE * total}").orderBy("n", "word", ascending=False).limit(HOT).collect()
    counts.unpersist()
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


_ROW = "part int, grp long, ids binary, held binary, tokens binary, words binary, pairs binary, contexts binary, at binary, occurs binary, docs binary, times binary, hot binary, hot_at binary, hot_train binary"
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _ROW.split(", "))])


def _pairs(keys: np.ndarray, doc_bits: int) -> tuple[np.ndarray, ...]:
    """From keys (pair, document) of tokens: pairs, documents of each, and how often in each."""
    keys = np.sort(keys)
    start, times = _runs(keys)
    keys = keys[start]
    first, occurs = _runs(keys >> doc_bits)
    return keys[first] >> doc_bits, occurs, keys & ((1 << doc_bits) - 1), times


def _trained(occurs: np.ndarray, docs: np.ndarray, times: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Training counts of pairs."""
    return np.add.reduceat(times * ~held[docs], np.cumsum(occurs) - occurs) if len(occurs) else np.zeros(0, np.int64)


def _to(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash, of ``parts`` equal ones."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def grouped(docs: DataFrame, parts: int, hot: np.ndarray, modulus: int, remainder: int) -> DataFrame:
    """Packed rows for each group of documents: one of the documents themselves, one for each word range."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 20
        ids: list[int] = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, doc = (np.concatenate([t[k] for t in tokens]) for k in range(2))
            held_ = np.array(held)
            # words by number; the context of a token is the number of the one before
            vocabulary, number = np.unique(np.append(w, _START), return_inverse=True)
            context = np.where(np.diff(doc, prepend=-1) > 0, number[-1], np.roll(number[:-1], 1))
            number = number[:-1]
            bits, doc_bits = len(vocabulary).bit_length(), len(ids).bit_length()
            place = np.searchsorted(hot, vocabulary)
            place[place == len(hot)] = 0
            frequent = (hot[place] == vocabulary if len(hot) else np.zeros(len(vocabulary), bool))[number]
            # the frequent words' pairs, dealt by pair
            word, before = place[number[frequent]], context[frequent]
            to = W.mix(vocabulary[before] ^ W.mix(word.astype(np.uint64))) % np.uint64(parts)
            pairs, occurs, docs_, times = _pairs((((to.astype(np.int64) * HOT + word) << bits | before) << doc_bits) | doc[frequent], doc_bits)
            hot_word, hot_context = (pairs >> bits) % HOT, pairs & ((1 << bits) - 1)
            hot_train = _trained(occurs, docs_, times, held_)
            hot_size = np.bincount((pairs >> bits) // HOT, minlength=parts)
            hot_cut = np.concatenate([[0], np.cumsum(hot_size)])
            held_bytes = pack(held_)
            # the documents' row, with where those pairs occur
            at = int(W.mix(np.array([serial], np.uint64))[0] % np.uint64(parts))
            out = [(at, serial, np.array(ids, "<i8").tobytes(), held_bytes, pack(np.bincount(doc, minlength=len(ids))), None, pack(hot_size), None, None, pack(occurs), pack(docs_), pack(times), pack(hot_word), None, None)]
            # a row for each word range
            pairs, occurs, docs_, times = _pairs(((number[~frequent] << bits | context[~frequent]) << doc_bits) | doc[~frequent], doc_bits)
            per_word = np.bincount(pairs >> bits, minlength=len(vocabulary))
            word_cut = np.searchsorted(_to(vocabulary, parts), np.arange(parts + 1))
            pair_cut = np.concatenate([[0], np.cumsum(per_word)])[word_cut]
            doc_cut = np.concatenate([[0], np.cumsum(occurs)])[pair_cut]
            for p in range(parts):
                (a, b), (c, d), (e, f), (g, h) = (x[p : p + 2] for x in (word_cut, pair_cut, doc_cut, hot_cut))
                if d > c or h > g:
                    some = np.flatnonzero(per_word[a:b]) + a
                    contexts, at = np.unique(np.concatenate([pairs[c:d] & ((1 << bits) - 1), hot_context[g:h]]), return_inverse=True)
                    out.append((p, serial, None, held_bytes, None, pack_hashes(vocabulary[some]), pack(per_word[some]), pack_hashes(vocabulary[contexts]), pack(at[: d - c]), pack(occurs[c:d]), pack(docs_[e:f]), pack(times[e:f]), pack(hot_word[g:h]), pack(at[d - c :]), pack(hot_train[g:h])))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ARROW)], schema=_ARROW)

        for batch in rows:
            names = batch.column(0)
            for w in W.of_column(batch.column(1), W.BY_SPACE):
                n = w.hi - w.lo
                if ids and (size + len(w.hash) + n > GROUP_TOKENS or len(ids) + n > GROUP_DOCS):
                    yield flush()
                    serial, size = serial + 1, 0
                    ids.clear(), held.clear(), tokens.clear()
                for lo in range(0, n, GROUP_DOCS):  # a chunk of words holds more documents than a group only if they are tiny
                    hi = min(n, lo + GROUP_DOCS)
                    if lo:
                        yield flush()
                        serial, size = serial + 1, 0
                        ids.clear(), held.clear(), tokens.clear()
                    a, b = int(w.first[lo]), int(w.first[hi])
                    token = np.empty(b - a + hi - lo, np.uint64)
                    token[np.arange(b - a) + w.doc[a:b] - lo] = w.hash[a:b]
                    token[w.first[lo + 1 : hi + 1] - a + np.arange(hi - lo)] = _END
                    tokens.append((token, np.repeat(np.arange(hi - lo), np.diff(w.first[lo : hi + 1]) + 1) + len(ids)))
                    for x in names[w.lo + lo : w.lo + hi].to_pylist():
                        ids.append(_NULL if x is None else x)
                        held.append(zlib.crc32(b"" if x is None else str(x).encode()) % modulus == remainder)
                    size += len(token)
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _ROW)


# ---- seating ----------------------------------------------------------------


def first_tables(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish when its customers come in by doubling groups, each group at the odds before it."""
    tables, seated = np.minimum(customers, 1).astype(np.float64), np.ones(len(customers))
    while True:
        step = np.minimum(seated, customers - seated)
        if not (step > 0).any():
            return tables
        odds = mass / (mass + np.maximum(seated - discount * tables, 1e-9))
        tables += rng.binomial(np.maximum(step, 0).astype(np.int64), odds)
        seated += np.maximum(step, 0)


class Seating:
    """Customers of many dishes at tables; moves one customer of each dish at a time."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> None:
        self.customers, self.tables, self.rng = customers, tables.astype(np.int64), rng
        self._lay(np.minimum(customers, 2 * self.tables + 6))
        self.sizes[self.first[:-1]] = customers - self.tables + 1
        rest = np.repeat(self.first[:-1] + 1 - np.concatenate([[0], np.cumsum(self.tables - 1)[:-1]]), self.tables - 1) + np.arange((self.tables - 1).sum())
        self.sizes[rest] = 1

    def _lay(self, room: np.ndarray) -> None:
        self.first = np.concatenate([[0], np.cumsum(room)])
        self.sizes = np.zeros(self.first[-1], np.int64)

    def _grow(self) -> None:
        """Twice the room where a dish has no free place left."""
        old, sizes = self.first, self.sizes
        room = np.diff(old)
        self._lay(np.where((self.tables >= room) & (room < self.customers), np.minimum(self.customers, 2 * room), room))
        self.sizes[np.arange(len(sizes)) - np.repeat(old[:-1], room) + np.repeat(self.first[:-1], room)] = sizes

    def move(self, mass: np.ndarray, less: np.ndarray, discount: float) -> None:
        """``mass``: weight of a new table for each dish; ``less``: what it loses when the customer's table closes."""
        n = len(self.customers)
        if not n:
            return
        if ((self.tables >= np.diff(self.first)) & (np.diff(self.first) < self.customers)).any():
            self._grow()
        total = np.cumsum(self.sizes)
        before = total[self.first[1:] - 1] - self.customers
        at = np.searchsorted(total, before + np.floor(self.rng.random(n) * self.customers), "right")
        self.sizes[at] -= 1
        closed = self.sizes[at] == 0
        self.tables -= closed
        stay = self.customers - 1 - discount * self.tables
        fresh = mass - less * closed
        new = (self.tables == 0) | (self.rng.random(n) * (fresh + stay) < fresh)
        weight = np.cumsum(np.where(self.sizes > 0, self.sizes - discount, 0))
        edge = np.concatenate([[0], weight[self.first[1:] - 1]])
        old = np.flatnonzero(~new)
        to = np.searchsorted(weight, edge[old] + self.rng.random(len(old)) * (edge[old + 1] - edge[old]), "right")
        to = np.minimum(np.maximum(to, self.first[old]), self.first[old + 1] - 1)
        empty = self.sizes[to] == 0  # a rounding step past the last table in use
        to[empty] = at[old][empty]
        self.tables[old[empty]] += self.sizes[to[empty]] == 0
        self.sizes[to] += 1
        opened = np.flatnonzero(new)
        free = np.flatnonzero(self.sizes == 0)
        place = free[np.minimum(np.searchsorted(free, self.first[opened]), max(len(free) - 1, 0))] if len(free) else opened
        self.sizes[place] += 1
        self.tables[opened] += 1


@dataclass
class Totals:
    """What the tasks of a round add up to; the state of the model besides the dishes."""

    customers: np.ndarray  # by context, as the range numbers them
    tables: np.ndarray  # by context, as the range numbers them
    tokens: float = 0.0
    words: float = 0.0
    unigrams: float = 0.0  # customers of the unigram restaurant
    unigram_tables: float = 0.0
    ones: float = 0.0
    twos: float = 0.0
    unigram_ones: float = 0.0
    unigram_twos: float = 0.0
    hot_tokens: np.ndarray | None = None
    hot_customers: np.ndarray | None = None
    hot_seats: np.ndarray | None = None

    @classmethod
    def of(cls, v: np.ndarray) -> Totals:
        sums, contexts = np.split(v, [8 + 2 * HOT])
        return cls(*np.split(contexts, 2), *sums[:8].tolist(), *np.split(sums[8:], 2))

    def vector(self) -> np.ndarray:
        return np.concatenate([[self.tokens, self.words, self.unigrams, self.unigram_tables, self.ones, self.twos, self.unigram_ones, self.unigram_twos], self.hot_tokens, self.hot_customers, self.customers, self.tables])

    def with_hot(self) -> Totals:
        """Adds the frequent words, whose dishes lie in many tasks, to the unigram restaurant."""
        some = self.hot_tokens > 0
        self.tokens += self.hot_tokens.sum()
        self.words += some.sum()
        self.unigrams += self.hot_customers.sum()
        self.hot_seats = self.hot_tables()
        self.unigram_tables += self.hot_seats.sum()
        return self

    def hot_tables(self) -> np.ndarray:
        """Tables of the frequent words in the unigram restaurant; drawn once."""
        if self.hot_seats is not None:
            return self.hot_seats
        mass = np.full(HOT, STRENGTH / (self.words + 1))
        seats = first_tables(np.ceil(self.hot_customers), mass + self.unigram_discount * self.unigram_tables / (self.words + 1), self.unigram_discount, np.random.default_rng(1))
        return np.where(self.hot_customers > 0, np.minimum(self.hot_customers, seats), 0)

    @property
    def discount(self) -> float:
        return float(np.clip(self.ones / max(self.ones + 2 * self.twos, 1), 0.05, 0.95))

    @property
    def unigram_discount(self) -> float:
        return float(np.clip(self.unigram_ones / max(self.unigram_ones + 2 * self.unigram_twos, 1), 0.05, 0.95))

    def unigram(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w) of words with so many customers and tables in the unigram restaurant."""
        d = self.unigram_discount
        base = (STRENGTH + d * self.unigram_tables) / (self.words + 1)
        return (np.maximum(customers - d * tables, 0) + base) / (STRENGTH + self.unigrams)


class Range:
    """All rows of one word range: its dishes, and for scoring the documents of each."""

    def __init__(self, rows: list[dict]) -> None:
        joined = lambda parts, kind=np.int64: np.concatenate(parts) if parts else np.zeros(0, kind)
        words, own_contexts = ([unpack_hashes(r[c]) for r in rows] for c in ("words", "contexts"))
        self.words, number = np.unique(joined(words, np.uint64), return_inverse=True)
        self.contexts, context = np.unique(joined(own_contexts, np.uint64), return_inverse=True)
        self.bits = max(CONTEXT_BITS, len(self.contexts).bit_length())
        first = np.cumsum([0, *map(len, own_contexts)]).tolist()
        ats = [unpack(r["at"]) + n for r, n in zip(rows, first)]
        self.cuts = np.cumsum([0, *map(len, ats)])
        keys, self.of_row = np.unique((np.repeat(number, joined([unpack(r["pairs"]) for r in rows])) << self.bits) | context[joined(ats)], return_inverse=True)
        self.word, self.context = keys >> self.bits, keys & ((1 << self.bits) - 1)
        train = [_trained(*(unpack(r[c]) for c in ("occurs", "docs", "times")), unpack(r["held"]) > 0) for r in rows]
        self.count = np.bincount(self.of_row, joined(train), minlength=len(keys)).astype(np.int64)
        hots = [unpack(r["hot"]) << self.bits | context[unpack(r["hot_at"]) + n] for r, n in zip(rows, first)]
        self.hot_cuts = np.cumsum([0, *map(len, hots)])
        self.hot, self.of_hot_row = np.unique(joined(hots), return_inverse=True)
        self.hot_count = np.bincount(self.of_hot_row, joined([unpack(r["hot_train"]) for r in rows]), minlength=len(self.hot)).astype(np.int64)

    @classmethod
    def of(cls, row: dict) -> Range:
        """The dishes alone, as ``packed`` has them."""
        out = cls([])
        out.words, out.contexts = unpack_hashes(row["words"]), unpack_hashes(row["contexts"])
        out.bits = max(CONTEXT_BITS, len(out.contexts).bit_length())
        out.word, out.context, out.count = np.repeat(np.arange(len(out.words)), unpack(row["pairs"])), unpack(row["at"]), unpack(row["train"])
        out.hot, out.hot_count = unpack(row["hot"]) << out.bits | unpack(row["hot_at"]), unpack(row["hot_train"])
        return out

    def packed(self) -> dict:
        hot_word, hot_context = self.hot_pairs()
        pairs = np.bincount(self.word, minlength=len(self.words))
        return {"words": pack_hashes(self.words), "pairs": pack(pairs), "contexts": pack_hashes(self.contexts), "at": pack(self.context), "train": pack(self.count), "hot": pack(hot_word), "hot_at": pack(hot_context), "hot_train": pack(self.hot_count)}

    def hot_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent word and context of each pair in ``hot``."""
        return self.hot >> self.bits, self.hot & ((1 << self.bits) - 1)

    def by_context(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x, minlength=max(CONTEXTS, len(self.contexts)))

    def run(self, state: Totals | None, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean tables of each dish (the range's, then the frequent words'), and mean customers and tables of each word.

        Without ``state`` (the first round) the totals are guessed from this range, and the first seats are the result. A
        context that the range has once is taken to have no other dish.
        """
        rng = np.random.default_rng(seed)
        seen, hot_seen = self.count > 0, self.hot_count > 0
        word, context, n = self.word[seen], self.context[seen], self.count[seen]
        size = len(self.words)
        hot_word, hot_context = (x[hot_seen] for x in self.hot_pairs())
        contexts, counts = np.concatenate([context, hot_context]), np.concatenate([n, self.hot_count[hot_seen]])
        sat = len(word)
        if state is None:
            guess = self.by_context(contexts, np.ones(len(contexts)))
            guess += np.maximum(guess - 1, 0) * (parts - 1)
            state = Totals(guess, guess, words=size * parts, unigrams=max(1, len(contexts)) * parts, unigram_tables=size * parts, ones=1.0, twos=0.2, unigram_ones=1.0, unigram_twos=0.2, hot_tokens=np.zeros(HOT), hot_customers=np.bincount(hot_word, minlength=HOT) * float(parts))
            burn, samples = 0, 0
        else:
            burn, samples = BURN, SAMPLES
        d = state.discount
        opening = STRENGTH + d * state.tables[contexts]
        hot_p = state.unigram(state.hot_customers, state.hot_tables())[hot_word]

        def parent(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            customers = np.bincount(word, tables[:sat], minlength=size)
            base = (STRENGTH + state.unigram_discount * state.unigram_tables) / (state.words + 1)
            own = np.where(customers > 0, first_tables(customers, np.full(size, base), state.unigram_discount, rng), 0)
            return customers, own, np.concatenate([state.unigram(customers, own)[word], hot_p])

        customers, own, p = parent(np.ones(len(counts)))
        tables = first_tables(counts.astype(np.float64), opening * p, d, rng)
        customers, own, p = parent(tables)
        sums = [np.zeros(len(counts)), np.zeros(size), np.zeros(size)]
        several = np.flatnonzero(counts > 1)
        seating = Seating(counts[several], tables[several], rng)
        for sweep in range(burn + samples):
            for _ in range(MOVES):
                seating.move((opening * p)[several], d * p[several], d)
            tables[several] = seating.tables
            customers, own, p = parent(tables)
            if sweep >= burn:
                for total, x in zip(sums, (tables, customers, own)):
                    total += x / samples
        if not samples:
            sums = [tables, customers, own]
        means, hot_means = np.zeros(len(self.count)), np.zeros(len(self.hot))
        means[seen], hot_means[hot_seen] = sums[0][:sat], sums[0][sat:]
        return means, hot_means, sums[1], sums[2]

    def totals(self, tables: np.ndarray, hot_tables: np.ndarray, customers: np.ndarray, own: np.ndarray) -> Totals:
        by = lambda at, x, n: np.bincount(at, x, minlength=n)
        hot_word, hot_context = self.hot_pairs()
        return Totals(
            self.by_context(self.context, self.count) + self.by_context(hot_context, self.hot_count),
            self.by_context(self.context, tables) + self.by_context(hot_context, hot_tables),
            float(self.count.sum()), float((by(self.word, self.count, len(self.words)) > 0).sum()), float(customers.sum()), float(own.sum()),
            float((self.count == 1).sum() + (self.hot_count == 1).sum()), float((self.count == 2).sum() + (self.hot_count == 2).sum()),
            float((np.round(customers) == 1).sum()), float((np.round(customers) == 2).sum()),
            by(hot_word, self.hot_count, HOT), by(hot_word, hot_tables, HOT),
        )


def _rows(table: pa.Table | Iterable[pa.RecordBatch]) -> list[dict]:
    return [r for batch in (table.to_batches() if isinstance(table, pa.Table) else table) for r in batch.to_pylist()]


def _split(rows: list[dict]) -> tuple[int, list[dict], list[dict]]:
    """The word range of the rows, its own, and the documents' rows that lie there."""
    rows = sorted(rows, key=lambda r: r["grp"])
    return rows[0]["part"], [r for r in rows if r["ids"] is None], [r for r in rows if r["ids"] is not None]


_MERGED = _ROW + ", train binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of word ranges with each dish once: a row of them without a group, and for each group where they occur.

    Pairs of a group are the steps between their places among the dishes.
    """
    rows = _rows(batches)
    names = [x.split()[0] for x in _MERGED.split(", ")]
    for part in sorted({r["part"] for r in rows}):
        _, ranged, groups = _split([r for r in rows if r["part"] == part])
        own = Range(ranged)
        out = [{"part": part} | own.packed()]
        for r, a, b, c, d in zip(ranged, own.cuts[:-1], own.cuts[1:], own.hot_cuts[:-1], own.hot_cuts[1:]):
            places = {"at": pack(np.diff(own.of_row[a:b], prepend=0)), "hot_at": pack(np.diff(own.of_hot_row[c:d], prepend=0))}
            out.append({k: r[k] for k in ("part", "grp", "occurs", "docs", "times")} | places)
        yield from _arrow(_MERGED, [tuple(r.get(n) for n in names) for r in out + groups]).to_batches()


_ASKED = "target int, part int, contexts binary, customers binary, tables binary, sums array<double>"
_TOLD = "part int, source int, customers binary, tables binary, sums array<double>"


def _arrow(fields: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in fields.split(", "))])
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _asked(part: int, own: Range, totals: Totals, parts: int) -> pa.Table:
    """What a word range adds to the totals of its contexts, a row for each range of contexts; tables count in ``SAMPLES``-ths."""
    n = len(own.contexts)
    customers, tables = totals.customers[:n].astype(np.int64), np.rint(totals.tables[:n] * SAMPLES).astype(np.int64)
    cut = np.searchsorted(_to(own.contexts, parts), np.arange(parts + 1)).tolist()
    rows = [(q, part, pack_hashes(own.contexts[a:b]), pack(customers[a:b]), pack(tables[a:b]), None) for q, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    # the totals of no context
    return _arrow(_ASKED, [(part, -1, None, None, None, totals.vector()[: 8 + 2 * HOT]), *rows])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a range of contexts over all word ranges, for each of these in the order in which it asked."""
    rows = _rows(batches)
    for q in sorted({r["target"] for r in rows}):
        own = sorted((r for r in rows if r["target"] == q), key=lambda r: r["part"])
        out = [(-1, q, None, None, r["sums"]) for r in own if r["part"] < 0]
        own = own[len(out) :]
        if own:
            asked = [unpack_hashes(r["contexts"]) for r in own]
            contexts, at = np.unique(np.concatenate(asked), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([unpack(r[c]) for r in own]), minlength=len(contexts)).astype(np.int64)[at] for c in ("customers", "tables")]
            cut = np.cumsum([0, *map(len, asked)]).tolist()
            out += [(r["part"], q, *(pack(x[a:b]) for x in sums), None) for r, a, b in zip(own, cut[:-1], cut[1:])]
        yield from _arrow(_TOLD, out).to_batches()


def _met(totals: Totals, own: Range, told: list[dict]) -> Totals:
    """``totals`` with those of the range's contexts, as it was told them."""
    told = sorted(told, key=lambda r: r["source"])
    sums = [np.concatenate([np.zeros(0), *(unpack(r[c]) for r in told)]) for c in ("customers", "tables")]
    return replace(totals, customers=sums[0], tables=sums[1] / SAMPLES)


_PARTIAL = "grp long, part int, ids binary, held binary, tokens binary, hot_size binary, hot binary, occurs binary, docs binary, times binary, known binary, base binary, score binary, hot_score binary"


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, parts: int | None = None) -> DataFrame:
    """Per document: log10 probabilities under the model and under the add-one unigram base.

    Documents whose crc32(id as text) modulo ``modulus`` is ``remainder`` are held out, the others train. ``parts`` is the
    number of word ranges; a range is held by one task, so it is to grow with the corpus, as shuffle partitions do.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_words(docs)
    rows = grouped(docs, parts, hot, modulus, remainder)
    rows = materialise(rows.repartitionById(parts, rows["part"]).mapInArrow(tidy(_merged), _MERGED), "ranges")
    forget_shuffles(spark)
    dishes = rows.where("grp is null")

    def summed(asked: DataFrame) -> tuple[DataFrame, Totals]:
        """Contexts' totals for each word range, and the sums over all ranges of the rest (all are of whole numbers by ``SAMPLES``)."""
        told = materialise(asked.repartitionById(parts, asked["target"]).mapInArrow(tidy(_told), _TOLD), "told")
        sums = np.zeros(8 + 2 * HOT)
        for r in told.where("part < 0").select(F.posexplode("sums")).groupBy("pos").sum("col").collect():  # one for each number
            sums[r[0]] = r[1]
        forget_shuffles(spark)
        return told.where("part >= 0"), Totals.of(sums).with_hot()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _rows([batch])):
            own = Range.of(r)
            yield from _asked(r["part"], own, own.totals(*own.run(None, parts, r["part"])), parts).to_batches()

    begun_told, begun = summed(dishes.mapInArrow(tidy(first), _ASKED))
    begun_ = context.broadcast(begun)

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        part, own = left["part"][0].as_py(), Range.of(_rows(left)[0])
        return _asked(part, own, own.totals(*own.run(_met(begun_.value, own, _rows(right)), parts, part)), parts)

    def with_totals(rows: DataFrame, told: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run`` on the rows of each word range and on what it was told, in the range's task."""
        left, right = (df.repartitionById(parts, df["part"]).groupBy("part") for df in (rows, told))
        return left.cogroup(right).applyInArrow(run, schema)

    state_told, state = summed(with_totals(dishes, begun_told, sample, _ASKED))
    state_ = context.broadcast(state)

    def logs(s: Totals, dish: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.log10((np.maximum(dish, 0) + (STRENGTH + s.discount * s.tables[at]) * p) / (STRENGTH + s.customers[at]))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, told = _rows(left), _rows(right)
        part, own = rows[0]["part"], Range.of(next(r for r in rows if r["grp"] is None))
        tables, hot_tables, customers, unigram_tables = own.run(_met(begun_.value, own, [r for r in told if r["round"] == 0]), parts, part)
        s = _met(state_.value, own, [r for r in told if r["round"] == 1])
        n = np.bincount(own.word, own.count, minlength=len(own.words))
        p = s.unigram(customers, unigram_tables)
        log_pair = logs(s, own.count - s.discount * tables, own.context, p[own.word])
        log_base = np.log10((n + 1) / (s.tokens + s.words + 1))
        hot_p = s.unigram(s.hot_customers, s.hot_tables())
        hot_word, hot_context = own.hot_pairs()
        log_hot = logs(s, own.hot_count - s.discount * hot_tables, hot_context, hot_p[hot_word])
        out = []
        for r in (r for r in rows if r["grp"] is not None and r["ids"] is None):
            at = np.repeat(np.cumsum(unpack(r["at"])), unpack(r["occurs"]))
            doc, times = unpack(r["docs"]), unpack(r["times"])
            word = own.word[at]
            sums = [np.bincount(doc, x * times) for x in (n[word] > 0, log_base[word], log_pair[at])]
            some = np.flatnonzero(np.bincount(doc))
            sums = [x[some] for x in sums] if len(some) else [np.zeros(0)] * 3
            out.append((r["grp"], part, *[None] * 6, pack(some), None, pack(sums[0].astype(np.int64)), sums[1].tobytes(), sums[2].tobytes(), log_hot[np.cumsum(unpack(r["hot_at"]))].tobytes()))
        out += [(r["grp"], part, r["ids"], r["held"], r["tokens"], r["pairs"], r["hot"], r["occurs"], r["docs"], r["times"], *[None] * 4) for r in rows if r["ids"] is not None]
        return _arrow(_PARTIAL, out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, []

        def done() -> pa.RecordBatch:
            s = state_.value
            head = next(r for r in mine if r["ids"] is not None)
            held, ids, n = unpack(head["held"]) > 0, np.frombuffer(head["ids"], "<i8"), unpack(head["tokens"])
            ranged = sorted((r for r in mine if r["ids"] is None), key=lambda r: r["part"])
            # the frequent words' pairs: numbers come by range, in the order in which the group has them
            at = np.repeat(np.arange(len(word := unpack(head["hot"]))), unpack(head["occurs"]))
            doc, times, word = unpack(head["docs"]), unpack(head["times"]), word[at]
            log_hot = np.concatenate([np.zeros(0), *(np.frombuffer(r["hot_score"]) for r in ranged)])
            hot_base = np.log10((s.hot_tokens + 1) / (s.tokens + s.words + 1))
            sums = np.array([np.bincount(doc, x * times, minlength=len(held)) for x in (s.hot_tokens[word] > 0, hot_base[word], log_hot[at])], float)
            for r in ranged:
                at = unpack(r["docs"])
                for total, x in zip(sums, (unpack(r["known"]), np.frombuffer(r["base"]), np.frombuffer(r["score"]))):
                    total[at] += x
            trained = np.full(len(held), int(s.tokens))
            columns = [pa.array(ids, mask=ids == _NULL), pa.array(held), pa.array(n), pa.array(np.round(sums[0]).astype(np.int64)), pa.array(trained), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / n))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["grp"] != group and mine:
                    yield done()
                    mine = []
                group = r["grp"]
                mine.append(r)
        if mine:
            yield done()

    told = begun_told.withColumn("round", F.lit(0)).unionByName(state_told.withColumn("round", F.lit(1)))
    partials = with_totals(rows, told, scored, _PARTIAL).repartition(parts, "grp").sortWithinPartitions("grp")
    return partials.mapInArrow(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole ``documents`` under the model learned from six sevenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_model": op2_language_model}
