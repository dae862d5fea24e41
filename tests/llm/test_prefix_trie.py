import hashlib
import random
import zlib

import pytest
from oracle import connection, problem
from pyspark.sql import functions as F

from cohortlake.llm import prefix_trie as T
from cohortlake.llm.common import ship


def plain(rows, rebuild=True):
    """Straight from the definition."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = (convs.get(c - c % 100, [])[:h] if rebuild else []) + own[h:]
    members, ends = {}, {}
    for c, x in whole.items():
        ends.setdefault(tuple(x), []).append(c)
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(own), len(path), min(members[path[:-1]]) if path else -1, len(own), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, own in members.items()
    )


def ours(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_query_and_sql(spark, sf_dir):
    got = T.op13_prefix_trie(spark, sf_dir).cache()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(got) == plain(rows)
    assert problem(got, connection(sf_dir), T.ORACLES["op13_prefix_trie"]) is None


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)


def test_hot_groups_in_small_chunks(spark, small):
    """Many equal conversations, a long one, children and ids beyond a chunk, many rounds of the ranking."""
    ship(spark)
    r = random.Random(3)
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(4)]
    rows += [(100 + c, t, r.choice("ab"), r.choice(["x", "yé", "", None])) for c in range(150) for t in range(r.randrange(1, 7))]
    rows += [(500, t, "u", f"long {t % 5}") for t in range(60)] + [(600 + c, 0, "u", f"one {c}") for c in range(50)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    conv = F.col("conv_id")
    assert ours(T.conversation_trie(df, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, last=300)) == plain(rows)
    assert ours(T.conversation_trie(df)) == plain(rows, rebuild=False)


def test_odd_rows(spark):
    ship(spark)
    rows = [(None, 0, "u", "no id"), (1, None, None, None), (1, None, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "A"), (2, None, "", ""), (2, 7, "u", "b"), (-5, 1, "u", "x"), (305, 0, "u", "no base"), (306, 0, "u", "no base"), (3, 0, "u", "z" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, place int, node string")
    assert ours(T.conversation_trie(df)) == plain(rows, rebuild=False)
    assert T.conversation_trie(df.where("conv_id is null")).count() == 0
    turnless = spark.createDataFrame([(c, 0, "u", "x") for c in range(1001, 1020)], "conv_id long, turn long, role string, text string")
    conv = F.col("conv_id")
    assert ours(T.conversation_trie(turnless, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)) == plain([tuple(r) for r in turnless.collect()])


@pytest.mark.parametrize("n", [1, 300])
def test_list_rank(spark, n):
    ship(spark)
    order = random.Random(n).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None])), "id long, next long")
    got = {r.id: r.position for r in T.list_rank(links, last=40).collect()}
    assert got == {x: i for i, x in enumerate(order)}
