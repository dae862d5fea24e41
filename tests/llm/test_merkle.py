import zlib
from hashlib import sha256

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.llm import merkle as M
from cohortlake.llm.common import ship
from cohortlake.llm.running import running

from oracle import connection, problem


def hashed(*values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha256("".join(out[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(out[-1]), 2)])
    return out


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i >>= 1
    return out


def expected(rows):
    """Straight from the definition: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    trees = {}
    for doc, source, lang, n, text in rows:
        leaf = hashed(doc, source, lang, n, text)
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        trees.setdefault(lang, []).append((doc is not None, doc or 0, leaf, hashed(doc, source, lang, n + 1, text) if tampered else leaf, doc))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: plain_levels([r[2] for r in sorted(trees[x])]) for x in names}
    top = plain_levels([levels[x][-1][0] for x in names])
    out = []
    for t, lang in enumerate(names):
        for i, (_, _, leaf, claim, doc) in enumerate(sorted(trees[lang])):
            proof = plain_proof(levels[lang], i) + plain_proof(top, t)
            for sibling, left in proof:
                claim = sha256(((sibling or "") + claim if left else claim + (sibling or "")).encode()).hexdigest()
            out.append((doc, leaf, levels[lang][-1][0], top[-1][0], sha256("".join(s or "" for s, _ in proof).encode()).hexdigest(), claim, claim == top[-1][0]))
    return sorted(out, key=str)


def ours(log, over):
    return sorted((tuple(r) for r in M.audit(log, over).collect()), key=str)


@given(st.integers(1, 400), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_positions_are_those_of_a_postorder_walk(n, level):
    at, seen, nodes = 0, {}, [list(range(-(-n >> up))) for up in range((n - 1).bit_length() + 1)]

    def walk(up, i):
        nonlocal at
        for child in (2 * i, 2 * i + 1):
            if up and child < len(nodes[up - 1]):
                walk(up - 1, child)
        seen[up, i] = at
        at += 1

    walk(len(nodes) - 1, 0)
    for (up, i), place in seen.items():
        assert M.position(up, M.np.array([i]), M.np.array([min(1 << up, n - (i << up))]))[0] == place


def test_query_and_sql(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = list(zip(*(docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))))
    got = M.op11_merkle(spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    assert sum(not r[-1] for r in expected(rows)) > 10
    assert problem(got, connection(sf_dir), M.ORACLES["op11_merkle"]) is None


@pytest.mark.parametrize("levels", [2, 3])
def test_many_layers_ties_and_nulls(spark, levels):
    ship(spark)
    rows = [(i % 37 if i % 11 else None, "s" if i % 5 else None, [None, "a", "b", "é", "b"][i % 5] if i < 90 else "b", i if i % 3 else None, f"text {i % 50}") for i in range(150)]
    rows += [(99, "s", "lone", 5, None), (7, "s", "b", 5, ""), (7, "s", "b", 5, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, place int").repartition(5)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    log, over = M.manifest_of_documents(docs, tampered, levels)
    assert ours(log, over) == expected(rows)
    nodes = log.runs.agg(F.sum(F.octet_length("digests") / 32)).first()[0] + log.upper.where(F.col("level") > levels).count()
    assert nodes == sum(len(x) for lang in {r[2] for r in rows} for x in plain_levels([""] * sum(r[2] == lang for r in rows)))
    for r in M.proofs(log).collect():
        steps = M.steps_of(r.place, r.n, iter(r.siblings))
        assert M.climb(r.leaf, steps) == r.subroot


def test_empty_and_single(spark, empty):
    ship(spark)
    log, over = M.manifest_of_documents(empty)
    assert ours(log, over) == [] and log.trees.count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], empty.schema)
    log, over = M.manifest_of_documents(one)
    leaf = hashed(None, None, None, None, None)
    assert ours(log, over) == [(None, leaf, leaf, leaf, sha256(b"").hexdigest(), leaf, True)]


def test_running_totals_of_groups_over_many_tasks(spark):
    ship(spark)
    rows = [(None if i % 9 == 0 else i % 2, i, i * i % 7) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g long, i long, x long").repartition(7)
        got = {(r.g, r.i): (r.place, r.number, r.upto_x) for r in running(df, ["g"], ["i"], ["x"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = 0
    for g in (None, 0, 1):
        own, total = [r for r in rows if r[0] == g], 0
        for place, (_, i, x) in enumerate(own):
            total += x
            assert got[g, i] == (place, number, total)
            number += 1
    assert number == len(got) == 500
    assert running(df.where("i < 0"), ["g"], ["i"], ["x"]).count() == 0
    assert sorted(r.number for r in running(df, [], ["g", "i"]).collect()) == list(range(500))
