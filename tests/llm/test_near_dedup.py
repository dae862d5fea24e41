import random

import pyarrow.parquet as pq

from cohortlake.llm import near_dedup as N
from cohortlake.llm.common import ship

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = [x for x in (text or "").translate(LOWER).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, share=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, ids = {}, sorted(sets)
    for i in ids:
        near = {j for s in sets[i] for j in index.get(s, ())}
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    want = brute(zip(docs["doc_id"], docs["text"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.op9_near_dedup(spark, sf_dir).collect()}
    assert got == want and any(i != c for i, (_, c) in want.items())


def test_chain_of_copies_links_beyond_the_first(spark):
    """Each neighbour is a link, the ends are not, and all share bands with the first."""
    ship(spark)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(12):
        rows.append((100 + d, " ".join(base[2 * d :] + [f"new{i}" for i in range(2 * d)])))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} == {i: 100 for i, _ in rows}


def edited_copies(n, seed):
    """Copies of one text, from hardly to heavily edited, some cut, some sharing edits, without the text itself."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(160)]
    shared = {i: rng.choice("abc") for i in rng.sample(range(160), 12)}
    out = []
    for d in range(n):
        w = list(base)
        for i in rng.sample(range(160), rng.choice([0, 1, 2, 3, 4, 5, 8])):
            w[i] = rng.choice(["the", "of", "and", f"own{d}x{i}"])
        if d % 3 == 0:
            for i in rng.sample(sorted(shared), 4):
                w[i] = shared[i]
        if d % 5 == 0:
            w = w[rng.randrange(30) : 160 - rng.randrange(30)]
        out.append((d, " ".join(w)))
    return out


def test_edited_copies_equal_brute_force(spark):
    """Of a large group the differences from its pivot find the links that the pivot has not, without all pairs."""
    ship(spark)
    rows = edited_copies(400, 3)
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert 5 < len(set(want.values())) < 400
    assert {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_names_that_the_stage_adds(spark):
    ship(spark)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 1, "a"), (2, text, 2, "b"), (3, "else", 3, "c")], "doc_id long, text string, touched_by int, Touched_Id string")
    got = sorted(N.keep_one(docs).collect())
    assert got == [(1, text, 1, "a"), (3, "else", 3, "c")] and got[0].asDict().keys() == {"doc_id", "text", "touched_by", "Touched_Id"}


def test_odd_rows(spark, odd, empty):
    ship(spark)
    got = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(odd).collect()}, key=str)
    rows = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = {(i, n, c) for i, (n, c) in brute(rows.items()).items()} | {(None, 1, None)}
    assert got == sorted(want, key=str)
    assert N.near_duplicates(odd).count() == odd.count() and N.near_duplicates(empty).count() == 0


def test_kept_texts_stay_out_of_workers_and_shuffle_files_go(spark, monkeypatch):
    ship(spark)
    docs = spark.createDataFrame(edited_copies(12, 3), "doc_id long, text string").repartition(3)
    real, times = N.forget_shuffles, []
    monkeypatch.setattr(N, "forget_shuffles", lambda s: times.append(1) or real(s))
    assert "InArrow" not in N.keep_one(docs)._jdf.queryExecution().optimizedPlan().toString() and len(times) >= 6
