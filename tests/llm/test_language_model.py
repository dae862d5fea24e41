import collections
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from cohortlake.llm import language_model as L
from cohortlake.llm.common import ship

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return [*WORD.findall((text or "").encode().translate(LOW)), None]


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def check_base(rows, got):
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = sorted((str(d), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows)
    assert np.allclose([b for _, b in base], [b for _, b in sorted((str(r.doc_id), r.base_score) for r in got)])


def test_query_counts_equal_brute_force_and_model_beats_base(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = L.op2_language_model(spark, sf_dir).collect()
    check_base(list(zip(docs["doc_id"], docs["text"])), got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out) and all(r.score < 0 for r in got)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_probabilities_add_up_to_one(spark, sf_dir):
    """Over all known words and one unknown, in the unigram restaurant and in every context."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for hot in (np.zeros(0, np.uint64), L.hot_words(docs)):
        own = L.Range([r.asDict() for r in L.grouped(docs.coalesce(1), 1, hot, 7, 2).collect() if r.ids is None])
        begun = L.Totals.of(own.totals(*own.run(None, 1, 0)).vector()).with_hot()
        tables, hot_tables, customers, unigram_tables = own.run(begun, 1, 0)
        state = L.Totals.of(own.totals(tables, hot_tables, customers, unigram_tables).vector()).with_hot()
        p = state.unigram(customers, unigram_tables)
        known = np.bincount(own.word, own.count) > 0
        hot_p = state.unigram(state.hot_customers, np.minimum(state.hot_customers, state.hot_tables()))[state.hot_tokens > 0]
        unknown = state.unigram(np.zeros(1), np.zeros(1))[0]
        total = p[known].sum() + hot_p.sum() + unknown
        assert abs(total - 1) < 1e-9
        dishes = np.bincount(own.context, own.count - state.discount * tables, L.CONTEXTS) + np.bincount(own.hot & (L.CONTEXTS - 1), own.hot_count - state.discount * hot_tables, L.CONTEXTS)
        by_context = (dishes + (L.STRENGTH + state.discount * state.tables) * total) / (L.STRENGTH + state.customers)
        assert np.abs(by_context - 1).max() < 1e-9 and len(hot) == (state.hot_tokens > 0).sum()


def test_moves_keep_the_distribution_of_tables():
    """For one dish of c customers the sampled tables follow P(t) ~ S(c, t) * prod (mass + d * i * p)."""
    rng = np.random.default_rng(8)
    c, discount, mass, n = 4, 0.5, 1.3, 40_000
    # weight of a seating with t tables, with the mass of a new table held: mass^t * prod over tables of (1-d)(2-d)...
    rise = lambda k: math.prod(j - discount for j in range(1, k))
    weights = {}

    def partitions(items):
        if not items:
            yield []
            return
        head, *rest = items
        for p in partitions(rest):
            yield [[head], *p]
            for i in range(len(p)):
                yield [*p[:i], [head, *p[i]], *p[i + 1 :]]

    for p in partitions(list(range(c))):
        weights[len(p)] = weights.get(len(p), 0) + mass ** len(p) * math.prod(rise(len(t)) for t in p)
    want = np.array([weights[t] for t in range(1, c + 1)]) / sum(weights.values())
    counts = np.full(n, c)
    seats = L.Seating(counts, L.first_tables(counts.astype(float), np.full(n, mass), discount, rng), rng)
    for _ in range(25):
        seats.move(np.full(n, mass), np.zeros(n), discount)
    assert (np.add.reduceat(seats.sizes, seats.first[:-1]) == c).all()
    assert (np.add.reduceat(seats.sizes > 0, seats.first[:-1]) == seats.tables).all()
    got = np.bincount(seats.tables, minlength=c + 1)[1:] / n
    assert np.abs(got - want).max() < 0.01


def test_many_tables_find_room():
    rng = np.random.default_rng(1)
    counts = np.array([2, 500, 3, 1000])
    seats = L.Seating(counts, np.ones(4, np.int64), rng)
    for _ in range(3000):
        seats.move(np.array([1.0, 1e6, 1.0, 50.0]), np.zeros(4), 0.5)
    assert np.add.reduceat(seats.sizes, seats.first[:-1]).tolist() == counts.tolist()
    assert seats.tables[1] > 400 and (np.add.reduceat(seats.sizes > 0, seats.first[:-1]) == seats.tables).all()


def test_packed_counts():
    for x in ([], [0, 1, 254, 255, 256, 10**12], [255]):
        assert L.unpack(L.pack(np.array(x, np.int64))).tolist() == x


def test_odd_rows(spark, odd, empty):
    ship(spark)
    for parts in (1, 4):
        check_base([(r.doc_id, r.text) for r in odd.collect()], L.score_documents(odd, parts=parts).collect())
    assert L.score_documents(empty).count() == 0
    only_held = odd.where("doc_id = 8")
    assert not held(8) or [r.base_score for r in L.score_documents(only_held).collect()] == [0.0]


def test_every_word_has_its_own_context(spark):
    """Also words whose hashes begin alike: what follows one of them says nothing of what follows the other."""
    ship(spark)
    names = [f"w{i}" for i in range(3000)]
    hashes = next(L.W.of_column(L.pa.array(names), L.W.BY_SPACE)).hash >> np.uint64(49)
    seen = {}
    one, two = next((names[seen[h]], names[i]) for i, h in enumerate(hashes.tolist()) if seen.setdefault(h, i) != i)
    rows = [(i, f"{one} left" if i % 2 else f"{two} right") for i in range(400) if not held(i)]
    free = [i for i in range(400, 600) if held(i)]
    rows += [(free[0], f"{one} left"), (free[1], f"{one} right"), (free[2], f"{two} left"), (free[3], f"{two} right")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in L.score_documents(docs, parts=parts).collect()}
        assert len(got) == len(rows)
        assert got[free[0]] > got[free[1]] + 1 and got[free[3]] > got[free[2]] + 1


def test_totals_of_contexts_meet(spark, sf_dir):
    """What all word ranges together have of a context comes back to each that has it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = 3
    packed = [r.asDict() for r in L.grouped(docs.repartition(2), parts, L.hot_words(docs), 7, 2).collect()]
    ranges = [L.Range([r for r in packed if r["part"] == p and r["ids"] is None]) for p in range(parts)]
    totals = [own.totals(*own.run(None, parts, 0)) for own in ranges]
    asked = [b for p in range(parts) for b in L._asked(p, ranges[p], totals[p], parts).to_batches()]
    told = [r for b in L._told(iter(asked)) for r in b.to_pylist()]
    want = collections.Counter()
    for r in docs.collect():
        if not held(r.doc_id):
            want.update([L._START, *(tokens(r.text)[:-1])])
    tables = sum(t.tables.sum() for t in totals)
    known = {}
    for p, own in enumerate(ranges):
        met = L._met(totals[p], own, [r for r in told if r["part"] == p])
        assert len(met.customers) == len(met.tables) == len(own.contexts)
        for c, n, t in zip(own.contexts.tolist(), met.customers.tolist(), met.tables.tolist()):
            assert known.setdefault(c, (n, t)) == (n, t)
    assert sorted(n for n, _ in known.values() if n) == sorted(want.values())
    assert abs(sum(t for _, t in known.values()) - tables) < 1e-6
