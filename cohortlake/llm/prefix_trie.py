"""Prefix trie of conversations, measured by the Euler-tour technique.

A node is a distinct sequence of the first d turns (role and text). What lies under a node (childless nodes, code points that
would not be stored again) comes from a tour of the trie: every node has an arc that enters it and one that leaves it; the
arc after each follows from the node, its place among its siblings and its parent; the list of arcs is ranked, and what
a subtree holds is the difference of two prefix sums, at the arcs that enter and leave its top.

* Ranking. In a round each arc of the list draws a coin; one that drew 1 behind one that drew 0 is spliced out and
  remembered with its distance. A quarter goes, so the work of all rounds is that of a few, and after some thirty rounds even a
  list of billions has at most ``LAST`` arcs, which one task walks. Then the rounds are undone, the last first.
* Prefixes. A turn is a digest of its role and text. The identity of a prefix is the sum of digests of (depth, turn), so that
  it is a running total: conversations of any length lie over several tasks. Equality of prefixes is that of 128-bit digests.
* Hot groups. A node that a third of all conversations share, or a parent of as many children, is never one task's group:
  counts are summed before they are shuffled, children are placed by range, and a parent meets them in chunks.

Nulls and edges: a null role or text is empty; rows without a conversation id belong to none; a null turn comes first; turns of
equal number are ordered by role and the digest of their text; equal rows are turns each; other columns are ignored; an
empty table has no nodes, not even a root. Texts are read once, to be hashed, and not shuffled. The driver gets one row for each task and
counts; the ids of a node's conversations are hashed from pieces of ``CHUNK``, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .running import running

#: a list of so many arcs is walked by one task
LAST = 2_000
#: children of a parent, turns of a conversation, and ids of a node that are handled together
CHUNK = 1_024
#: original turns that a conversation can take from another at most
MOST_HEADS = 5
_LIMBS = ["limb_0", "limb_1", "limb_2", "limb_3"]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).substr(1, 16)


def _prefix(depth: Column, sums: list[Column]) -> Column:
    return _digest(F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums)))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, chars, place): every turn, by its place in its conversation from 0 on."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    return running(materialise(rows, "turns"), ["conv_id"], ["turn", "role", "digest", "row"], name="turn_places").select("conv_id", "digest", "chars", "place")


def rebuilt(placed: DataFrame, base: Column | None = None, heads: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of others: (conv_id, depth, digest, chars) of their turns, and all conv_ids.

    Conversation c gets the first ``heads`` (0 to MOST_HEADS, of ``conv_id``) turns of conversation ``base``, as far as it has
    them, in place of as many of its own. Without the two, conversations stay as they are.
    """
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    if base is None:
        return placed.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars"), convs.select("conv_id")
    wants = convs.select("conv_id", "n", base.alias("base"), heads.alias("heads"))
    has = wants.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = wants.join(has, "base", "left").withColumn("taken", F.least("heads", F.coalesce("base_n", F.lit(0))))
    first = placed.where(F.col("place") < MOST_HEADS).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = info.where("taken > 0").join(first, "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    own = placed.withColumn("heads", heads).where("place >= heads").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    short = info.where("taken < heads and n > heads").select("conv_id", (F.col("heads") - F.col("taken")).alias("lacks"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    own = own.join(short, ["conv_id", "chunk"], "left").select("conv_id", (F.col("place") + 1 - F.coalesce("lacks", F.lit(0))).alias("depth"), "digest", "chars")
    return own.unionByName(taken), convs.select("conv_id")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, node, parent): the digests of the prefix that ends with each turn and of the one before."""
    name = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.hex("digest")), 256)
    limbs = [F.conv(F.substring(name, 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(_LIMBS)]
    summed = running(materialise(rows.select("conv_id", "depth", "chars", *limbs), "rebuilt"), ["conv_id"], ["depth"], _LIMBS, "prefixes")
    upto = [F.col(f"upto_{c}") for c in _LIMBS]
    return summed.select("conv_id", "depth", "chars", _prefix(F.col("depth"), upto).alias("node"), _prefix(F.col("depth") - 1, [u - F.col(c) for u, c in zip(upto, _LIMBS)]).alias("parent"))


def list_rank(links: DataFrame, last: int = LAST) -> DataFrame:
    """(id, position) of the one list that ``links`` (id, next; next null at its end) form: how many come before each."""
    spark = links.sparkSession
    live = materialise(links.select("id", "next", F.lit(1).cast("long").alias("length")), "ranking")
    n, spliced = live.count(), []
    while n > last:
        coin = lambda c: F.xxhash64(F.col(c), F.lit(len(spliced))).bitwiseAND(1)
        keeps = (coin("id") == 0) & F.col("next").isNotNull() & (coin("next") == 1)
        heads = live.where(keeps).select(F.col("next").alias("id"), F.col("id").alias("head"), F.col("length").alias("before"))
        met = live.where(coin("id") == 1).join(heads, "id", "left")
        rest = live.where((coin("id") == 0) & ~keeps).withColumns({"head": F.lit(None).cast("long"), "before": F.lit(None).cast("long")})
        now = materialise(met.unionByName(rest), "ranking")
        spliced.append(now.where("head is not null").select("id", "head", "before"))
        live = now.select(F.coalesce("head", "id").alias("id"), "next", (F.col("length") + F.coalesce("before", F.lit(0))).alias("length"))
        n = now.count()

    def walk(rows: pa.Table) -> pa.Table:
        after = dict(zip(rows["id"].to_pylist(), zip(rows["next"].to_pylist(), rows["length"].to_pylist())))
        at, position, out = next(iter(after.keys() - {x for x, _ in after.values()})), 0, []
        while at is not None:
            out.append((at, position))
            at, length = after[at]
            position += length
        return pa.table({"id": pa.array([i for i, _ in out], pa.int64()), "position": pa.array([p for _, p in out], pa.int64())})

    found = materialise(live.groupBy(F.lit(0).alias("list")).applyInArrow(walk, "id long, position long"), "ranked")
    for gone in reversed(spliced):
        back = gone.join(found.withColumnRenamed("id", "head"), "head").select("id", (F.col("position") + F.col("before")).alias("position"))
        found = found.unionByName(materialise(back, "ranked"))
    return found


def ids_hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of the conversations that end at each node, ascending, comma-joined."""
    placed = running(ends, ["node"], ["conv_id"], name="ends")
    texts = placed.groupBy("node", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)

    ordered = texts.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return ordered.mapInArrow(fold, "node binary, ends_sha256 string")


def trie(steps: DataFrame, convs: DataFrame, last: int = LAST) -> DataFrame:
    """The nodes of ``prefixes``, the root of all ``convs`` included, with what lies under each (columns as in op13_prefix_trie)."""
    root = _prefix(F.lit(0), [F.lit(0)] * len(_LIMBS))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = steps.groupBy("depth", "node").agg(F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    placed = running(materialise(nodes.unionByName(top), "nodes"), ["depth", "parent"], ["conv_id"], name="siblings")
    families = placed.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min("number").alias("first_child"))
    full = materialise(placed.join(families, "node", "left").fillna(0, ["n_children"]), "families")
    parents = full.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("number").alias("parent_number"), F.col("n_children").alias("n_siblings"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_children") - 1) / CHUNK))).alias("chunk")
    )
    linked = materialise(full.withColumn("chunk", F.floor(F.col("place") / CHUNK)).join(parents, ["parent", "chunk"], "left"), "linked")

    enter = F.struct((2 * F.col("number")).alias("id"), F.expr("if(n_children > 0, 2 * first_child, 2 * number + 1)").alias("next"), F.expr("int(n_children = 0)").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    leave = F.struct((2 * F.col("number") + 1).alias("id"), F.expr("if(place + 1 < n_siblings, 2 * number + 2, 2 * parent_number + 1)").alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    arcs = linked.select(F.inline(F.array(enter, leave)))
    tour = materialise(list_rank(arcs.select("id", "next"), last).join(arcs.drop("next"), "id"), "tour")
    sums = running(tour, [], ["position"], ["leaves", "saved"], "tour_sums")
    sign = F.when(F.col("id") % 2 == 0, -1).otherwise(1)  # the sum at the arc that leaves, less the one before the arc that enters
    under = sums.groupBy(F.floor(F.col("id") / 2).alias("number")).agg(F.sum(sign * F.col("upto_leaves") + F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("upto_saved") + F.col("saved")).alias("saved_tokens"))

    ending = steps.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ending = convs.join(ending, "conv_id", "left").select("conv_id", F.coalesce("node", root).alias("node"))
    out = linked.join(under, "number").join(ids_hashed(materialise(ending, "ending")), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, last: int = LAST) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), rebuilt first if ``base`` and ``heads`` are given."""
    rows, convs = rebuilt(turns(conversations), base, heads)
    return trie(prefixes(rows), materialise(convs, "conv_ids"), last)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` that share the first turns of every hundredth one."""
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % (MOST_HEADS + 1)
    return conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, heads)


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, (i + 1)::int, 1))::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""
ORACLES = {
    "op13_prefix_trie": f"""
with o as (select conv_id, length(t) as chars, d, row_number() over (partition by conv_id order by turn nulls first, r, d) - 1 as place
    from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d from conversations where conv_id is not null)),
k as (select conv_id, conv_id - conv_id % 100 as base, n, {_CRC} % 6 as h from (select conv_id, count(*) as n from o group by conv_id)),
i as (select k.conv_id, k.base, k.n, k.h, least(k.h, coalesce(b.n, 0)) as taken from k left join k b on b.conv_id = k.base),
r as (select i.conv_id, place + 1 as depth, d, chars from i join o on o.conv_id = i.base and place < taken
    union all select o.conv_id, taken + place - h + 1, d, chars from o join i on i.conv_id = o.conv_id where place >= h),
p as (select conv_id, depth, chars, list(d) over (partition by conv_id order by depth) as path from r union all select conv_id, 0, 0, []::varchar[] from k),
node as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from p group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1),
whole as (select n.*, coalesce(n_children, 0) as n_children from node n left join kids using (path)),
under as (select path[1:a] as path, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * chars) as saved from (select *, unnest(range(depth + 1)) as a from whole) group by 1),
ends as (select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max_by(path, depth) as path from p group by conv_id) group by path)
select w.conv_id, w.depth, f.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from whole w join under using (path) left join ends using (path) left join whole f on w.depth > 0 and f.path = w.path[1:w.depth - 1]"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
