"""Merkle manifest of a data set: a postorder append log, written by aligned builders, and proofs read from it.

The rows of each tree are its leaves, in order. While a level has more than one node, every two consecutive ones become the
hash of both (an odd last one becomes the hash of itself). Nodes are written in the order of their completion, which is
postorder: a node over ``m`` leaves has ``size(level, m)`` nodes in its subtree, ``2 a - bits(a)`` nodes are complete before
leaf ``a``, and so the position of any node follows from its level and index alone. A builder takes ``2 ** LEVELS``
consecutive leaves, aligned to that number, so that its nodes are one run of the log and no builder needs another; the
roots of those runs are the leaves of the next layer of builders, and so on. A proof is read from the run of the leaf and,
above it, from the log at the closed-form positions of the siblings.

What goes where: texts are hashed where they are read; rows of some hundred bytes are ranged by tree and key (a tree of any
size over many tasks), counted, and grouped by run; the driver gets one row for each task. The subroots are the leaves
of one more tree, built in the same way, however many there are.

Nulls and edges: a null tree comes first, null keys come first within a tree; rows that repeat a key are leaves each,
ordered by their hash; a null column hashes as ``-``; columns not named are ignored; an empty table has no nodes.
A null id has no decimal form and is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, table, tidy
from .running import running

#: a builder takes 2 ** LEVELS leaves
LEVELS = 8
NODES = "tree string, level int, index long, leaves long, position long, digest binary"
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("leaves", pa.int64()), ("position", pa.int64()), ("digest", pa.binary())])


def record_hash(*columns: Column) -> Column:
    """Hash of a record: each value by its UTF-8 length and itself, ``-`` if it is null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def subtree_size(level: int | np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Nodes of a subtree whose top is at ``level``, over its leaves: ``2 (m - 1) - bits(m - 1) + level + 1``."""
    return 2 * (leaves - 1) - np.bitwise_count(leaves - 1).astype(np.int64) + level + 1


def position(level: int | np.ndarray, index: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Place of a node in its tree's log, from its level, its index there, and the leaves under it."""
    first = index << level
    return 2 * first - np.bitwise_count(first).astype(np.int64) + subtree_size(level, leaves) - 1


_POSITION = "2 * shiftleft(index, level) - bit_count(shiftleft(index, level)) + 2 * (leaves - 1) - bit_count(leaves - 1) + level"


def height_of(first: int, n: int, levels: int) -> int:
    """Levels above ``n`` nodes that a builder adds: all of its own, but no more than a whole tree needs."""
    return (n - 1).bit_length() if first == 0 and n < 1 << levels else levels


def raised(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def built(nodes: list[str], height: int) -> list[list[str]]:
    """All levels from ``nodes`` up."""
    out = [nodes]
    for _ in range(height):
        out.append(raised(out[-1]))
    return out


def packed(digests: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(-1, 32)


def places_in_run(n: int, height: int) -> list[np.ndarray]:
    """For each level of a run over ``n`` leaves, the places of its nodes within the run."""
    out = []
    for level in range(height + 1):
        index = np.arange(-(-n >> level))
        out.append(position(level, index, np.minimum(1 << level, n - (index << level))))
    return out


class Step(NamedTuple):
    """One level of a proof: the sibling, empty where there is none, and whether it stands on the left."""

    sibling: str
    left: bool


def climb(leaf: str, steps: list[Step]) -> str:
    """The root that a leaf and its siblings give."""
    for sibling, left in steps:
        leaf = sha256((sibling + leaf if left else leaf + sibling).encode()).hexdigest()
    return leaf


def steps_of(place: int, n: int, siblings: Iterator[str], level: int = 0) -> list[Step]:
    """Steps from the node ``place`` at ``level`` of a tree of ``n`` leaves, with the siblings that exist, bottom up."""
    out, width = [], -(-n >> level)
    while width > 1:
        out.append(Step(next(siblings) if place ^ 1 < width else "", bool(place & 1)))
        place, width = place >> 1, -(-width // 2)
    return out


@dataclass
class Log:
    """``runs``: (tree, run, first, leaves, keys, claims, digests), a row for each builder of leaves, its nodes in postorder.
    ``upper``: (tree, level, index, leaves, position, digest) of the nodes above, and of the top of each run.
    ``trees``: (tree, n, subroot, depth)."""

    runs: DataFrame
    upper: DataFrame
    trees: DataFrame
    levels: int
    key_type: str


def append_log(leaves: DataFrame, levels: int = LEVELS) -> Log:
    """The log of ``leaves``: (tree, key, leaf, claim), hashes as hex text; a claim is what a later reader says the leaf is."""
    leaves = materialise(leaves.select("tree", "key", F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim")), "merkle_leaves")
    placed = running(leaves.withColumn("row", F.monotonically_increasing_id()), ["tree"], ["key", "leaf", "claim", "row"], name="merkle_placed")
    key = leaves.schema["key"].dataType
    kind = key.simpleString()
    schema = pa.schema([("tree", pa.string()), ("run", pa.int64()), ("first", pa.int64()), ("leaves", pa.int64()), ("keys", pa.list_(to_arrow_type(key))), ("claims", pa.binary()), ("digests", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        run, n = rows["run"][0].as_py(), len(rows)
        height = height_of(run, n, levels)
        nodes = built([x.hex() for x in rows["leaf"].to_pylist()], height)
        log = np.empty((sum(map(len, nodes)), 32), np.uint8)
        for places, level in zip(places_in_run(n, height), nodes):
            log[places] = packed(level)
        first = 2 * (run << levels) - (run << levels).bit_count()
        made = [[rows["tree"][0].as_py()], [run], [first], [n], [rows["key"].to_pylist()], [b"".join(rows["claim"].to_pylist())], [log.tobytes()]]
        return pa.Table.from_arrays([pa.array(m, f.type) for m, f in zip(made, schema)], schema=schema)

    runs = placed.withColumn("run", F.shiftright("place", levels)).select("tree", "run", "place", "key", "leaf", "claim")
    runs = materialise(runs.groupBy("tree", "run").applyInArrow(build, f"tree string, run long, first long, leaves long, keys array<{kind}>, claims binary, digests binary"), "merkle_runs")

    def build_upper(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        under, level, index = np.array(rows["leaves"]), rows["level"][0].as_py(), rows["index"][0].as_py()
        nodes = built([x.hex() for x in rows["digest"].to_pylist()], height_of(index, len(rows), levels))
        parts = [pa.Table.from_pylist([], _NODE)]
        for up in range(1, len(nodes)):
            starts = np.arange(0, len(under), 1 << up)
            total, at = np.add.reduceat(under, starts), (index >> up) + np.arange(len(starts))
            k = len(starts)
            arrays = [pa.array([rows["tree"][0].as_py()] * k, pa.string()), pa.array(np.full(k, level + up, np.int32)), pa.array(at), pa.array(total), pa.array(position(level + up, at, total)), pa.array([bytes.fromhex(x) for x in nodes[up]], pa.binary())]
            parts.append(pa.Table.from_arrays(arrays, schema=_NODE))
        return pa.concat_tables(parts)

    tops = runs.select("tree", F.lit(levels).alias("level"), F.col("run").alias("index"), "leaves", (F.col("first") + F.octet_length("digests") / 32 - 1).cast("long").alias("position"), F.expr("substring(digests, -32)").alias("digest"))
    upper, widest, at = materialise(tops, "merkle_upper"), runs.agg(F.max("run")).first()[0] or 0, levels
    layer = upper
    while widest:
        layer = materialise(layer.withColumn("part", F.shiftright("index", levels)).groupBy("tree", "part").applyInArrow(build_upper, NODES), "merkle_upper")
        upper, at = upper.unionByName(layer), at + levels
        layer, widest = layer.where(F.col("level") == at), widest >> levels
    top = upper.where("index = 0").groupBy("tree").agg(F.max_by(F.struct("leaves", "digest"), "level").alias("top"))
    trees = top.select("tree", F.col("top.leaves").alias("n"), F.lower(F.hex("top.digest")).alias("subroot"))
    trees = trees.withColumn("depth", F.expr("if(n <= 1, 0, length(bin(n - 1)))"))
    return Log(runs, upper, materialise(trees, "merkle_trees"), levels, kind)


def with_paths(log: Log) -> DataFrame:
    """The runs, each with n of its tree, the subroot, and ``above``: the siblings over the run's top, bottom up."""
    levels = log.levels
    spots = log.runs.select("tree", "run").join(log.trees.where(F.col("depth") > levels), "tree")
    spots = spots.withColumn("level", F.explode(F.sequence(F.lit(levels), F.col("depth") - 1)))
    spots = spots.withColumn("index", F.expr(f"shiftright(run, level - {levels}) ^ 1")).where("shiftleft(index, level) < n")
    spots = spots.withColumn("leaves", F.expr("least(shiftleft(1L, level), n - shiftleft(index, level))"))
    spots = spots.select("tree", "run", "level", F.expr(_POSITION).cast("long").alias("position"))
    found = spots.join(log.upper.select("tree", "position", "digest"), ["tree", "position"])
    above = found.groupBy("tree", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "digest"))), lambda x: x["digest"]).alias("above"))  # a sibling for each level
    return log.runs.join(above, ["tree", "run"], "left").join(log.trees, "tree")


def _leaves_of(row: dict, levels: int) -> Iterator[tuple[int, object, str, str, list[Step]]]:
    """(place, key, leaf, claim, steps) of each leaf of a run."""
    n, height = row["leaves"], height_of(row["run"], row["leaves"], levels)
    log = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    nodes = [[bytes(x).hex() for x in log[places]] for places in places_in_run(n, height)]
    above = steps_of(row["run"], row["n"], (x.hex() for x in row["above"] or []), levels)
    claims = row["claims"]
    for i, key in enumerate(row["keys"]):
        steps = [Step(level[j ^ 1] if (j := i >> up) ^ 1 < len(level) else "", bool(j & 1)) for up, level in enumerate(nodes[:-1])]
        yield (row["run"] << levels) + i, key, nodes[0][i], claims[32 * i : 32 * i + 32].hex(), steps + above


def _answer(runs: DataFrame, log: Log, one, names: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``one(row, place, key, leaf, claim, steps)`` for each leaf; ``names``: column, Arrow type, SQL type."""
    schema = pa.schema([(c, t) for c, t, _ in names])
    levels = log.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [one(row, *x) for x in _leaves_of(row, levels)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return runs.mapInArrow(tidy(run), ", ".join(f"{c} {t}" for c, _, t in names))


def proofs(log: Log) -> DataFrame:
    """(tree, key, place, n, leaf, siblings, subroot): the siblings that exist from each leaf to its subroot, as hex text."""
    key = to_arrow_type(log.runs.schema["keys"].dataType.elementType)
    one = lambda row, place, key, leaf, claim, steps: (row["tree"], key, place, row["n"], leaf, [s.sibling for s in steps if s.sibling], row["subroot"])
    names = [("tree", pa.string(), "string"), ("key", key, log.key_type), ("place", pa.int64(), "long"), ("n", pa.int64(), "long"), ("leaf", pa.string(), "string"), ("siblings", pa.list_(pa.string()), "array<string>"), ("subroot", pa.string(), "string")]
    return _answer(with_paths(log), log, one, names)


def audit(log: Log, over: Log) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf: its claim folded with its proof, through
    its tree and through ``over``, the tree whose keys are the trees."""
    top = proofs(over).select(F.col("key").alias("tree"), F.col("place").alias("top_place"), F.col("n").alias("top_n"), F.col("siblings").alias("top_siblings"), F.col("subroot").alias("root"))

    def one(row: dict, place: int, key: object, leaf: str, claim: str, steps: list[Step]) -> tuple:
        steps = steps + steps_of(row["top_place"], row["top_n"], iter(row["top_siblings"]))
        folded = climb(claim, steps)
        return key, leaf, row["subroot"], row["root"], sha256("".join(s.sibling for s in steps).encode()).hexdigest(), folded, folded == row["root"]

    key = to_arrow_type(log.runs.schema["keys"].dataType.elementType)
    text = (pa.string(), "string")
    names = [("key", key, log.key_type), ("leaf", *text), ("subroot", *text), ("root", *text), ("proof_sha256", *text), ("folded_root", *text), ("verified", pa.bool_(), "boolean")]
    return _answer(with_paths(log).join(top, "tree"), log, one, names)


def subroots_log(log: Log, levels: int = LEVELS) -> Log:
    """The tree over the subroots."""
    return append_log(log.trees.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("leaf"), F.col("subroot").alias("claim")), levels)


def manifest_of_documents(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> tuple[Log, Log]:
    """Logs of the documents by language and of the languages. ``tampered``: rows that later claim one more in ``n_chars``."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = record_hash(*fields)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # a null before all others
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf.alias("leaf"), (leaf if tampered is None else F.when(tampered, record_hash(*changed)).otherwise(leaf)).alias("claim"))
    log = append_log(leaves, levels)
    return log, subroots_log(log, levels)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of whole ``documents``, every proof extracted, and folded from leaves of which a seventh is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    log, over = manifest_of_documents(table(spark, sf_dir, "documents"), F.coalesce(tampered, F.lit(False)))
    return audit(log, over).withColumnRenamed("key", "doc_id")


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "{n}::varchar", "text")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""
ORACLES = {
    "op11_merkle": f"""
with recursive d as (
    select doc_id, lang, {_LEAF.replace("{n}", "n_chars")} as leaf, case when {_CRC} % 7 = 0 then {_LEAF.replace("{n}", "(n_chars + 1)")} else {_LEAF.replace("{n}", "n_chars")} end as claim from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
tree(lang, level, i, n, h) as (
    select lang, 0, i, n, leaf from placed
    union all
    select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by lang, level, n, i // 2),
sub as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
top(level, i, n, h) as (
    select 0, i, n, subroot from sub
    union all
    select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, n, i // 2),
step as (
    select p.doc_id, p.leaf, t.level, case when s.h is null then 'N' when p.i >> t.level & 1 = 1 then 'L' || s.h else 'R' || s.h end as x
    from placed p join (select distinct lang, level from tree where n > 1) t on p.lang is not distinct from t.lang
    left join tree s on s.lang is not distinct from p.lang and s.level = t.level and s.i = xor(p.i >> t.level, 1)
    union all
    select p.doc_id, p.leaf, 1000 + t.level, case when s.h is null then 'N' when b.i >> t.level & 1 = 1 then 'L' || s.h else 'R' || s.h end
    from placed p join sub b on p.lang is not distinct from b.lang cross join (select distinct level from top where n > 1) t
    left join top s on s.level = t.level and s.i = xor(b.i >> t.level, 1)),
path as (select doc_id, leaf, list(x order by level) as xs, sha256(coalesce(string_agg(x[2:], '' order by level), '')) as proof_sha256 from step group by doc_id, leaf),
folded as (
    select p.doc_id, p.leaf, coalesce(q.proof_sha256, sha256('')) as proof_sha256, list_reduce(list_prepend(p.claim, coalesce(q.xs, [])), lambda a, x: case x[1] when 'N' then sha256(a) when 'L' then sha256(x[2:] || a) else sha256(a || x[2:]) end) as folded_root, b.subroot
    from placed p left join path q on p.doc_id is not distinct from q.doc_id and p.leaf = q.leaf join sub b on p.lang is not distinct from b.lang)
select doc_id, leaf, subroot, h as root, proof_sha256, folded_root, folded_root = h as verified from folded cross join (select h from top where n = 1) r"""
}
QUERIES = {"op11_merkle": op11_merkle}
