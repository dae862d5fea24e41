"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct runs of five words. Its sketch has m registers 1 - log_b(min h_i) of exponentially
distributed hashes h_i: truncated minima at exponentially spaced levels, so sketches of parts merge by the maximum. The
collision probability of two registers rises with the Jaccard similarity J. Bands of registers give candidates; the
similarity of a candidate is estimated by maximum likelihood from how many registers are larger, smaller and equal; what
comes near the threshold is confirmed on the full sets.

With 32 bands of 6 registers a pair at J = 0.85 shares no band with probability 3e-7, and the estimate has a standard
deviation of 0.026, six of which are allowed below the threshold.

Groups of copies: documents whose sets have equal keys are one node once the sets themselves are found equal. In a band
each node is first compared with one only, that with the fewest runs of its own; joins by that document are split by
Spark where it has very many partners. What is left in other components meets by how it differs from this document, the
pivot of the group: two documents link only if they share enough of these differences, so an index over the rarest of
them (a prefix filter) finds the pairs, and what all copies have in common makes none.

Nulls and edges: a text without words has an empty set and is linked with nothing; fewer than five words are one run; a
row with a null id is its own component (null) and kept; rows that repeat an id are one node and a row each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import forget_shuffles, materialise, table, tidy, unused
from .graph import components
from .sieve import among, sieve_of, sift

BANDS, ROWS = 32, 6
M = BANDS * ROWS
#: fixed values of the sketch: base, rate, largest register
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 2**31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, M, dtype=np.uint32)
_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values from the minima (unsigned 32-bit) of uniform hashes."""
    h = -np.log1p(-(minima + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def sketch_row(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set, in blocks, so that memory does not follow the text."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(M, 2**32 - 1, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[lo : lo + 1024] * _A + _B).min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct runs of ``k`` words of each text."""
    for w in W.of_column(column, W.BY_SPACE):
        full = W.windows(w.hash, k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            yield np.unique(full[a : b - k + 1] if b - a >= k else W.row_shingles(w.hash[a:b], k))


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, registers, bands): one pass, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0)
            sizes, keys, minima = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                keys.append((int(s.sum(dtype=np.uint64)), int(W.mix(s).sum(dtype=np.uint64))))
                minima.append(sketch_row(s))
            if not sizes:
                continue
            some = np.array(sizes) > 0
            regs = registers(np.array(minima, np.float64).reshape(-1, M))
            mixed = W.mix((regs.astype(np.uint64).reshape(-1, BANDS, ROWS) * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            bands = [x if ok else [] for x, ok in zip(mixed.view(np.int64).tolist(), some)]
            key = np.array(keys, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>")


def similarity(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, on a grid of 1/200."""
    more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    same = x.shape[1] - more - less
    u = (n_x / (n_x + n_y))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda z: -np.log1p(-z * (BASE - 1) / BASE) / np.log(BASE)
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = p(np.maximum(u - v * grid, 0)), p(np.maximum(v - u * grid, 0))
        score = sum(np.where(d > 0, d * np.log(np.maximum(q, 1e-300)), 0) for d, q in ((more, up), (less, down), (same, 1 - up - down)))
    return np.take_along_axis(grid, np.argmax(score, axis=1)[:, None], 1)[:, 0]


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, M) for c in ("regs_a", "regs_b"))
            got = np.concatenate([similarity(x[i : i + 500], y[i : i + 500], np.array(batch["n_a"])[i : i + 500].astype(float), np.array(batch["n_b"])[i : i + 500].astype(float)) for i in range(0, len(x), 500)])
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(got >= least))

    end = lambda c: nodes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"regs_{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(tidy(run), "a long, b long, n_a long, n_b long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents ``ids`` (id, key; a written table), a few of all: a bitmap keeps the other texts out of the shuffle.

    ``key`` is the first key of the set: of rows that repeat an id it tells which one is meant.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = list(shingle_sets(batch.column(1), k))
            meant = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) == np.array(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"]).filter(pa.array(meant))

    some = among(docs.select("doc_id", "text"), "doc_id", ids.select("id"))
    chosen = some.join(ids.withColumnRenamed("id", "doc_id"), "doc_id")
    return chosen.mapInArrow(tidy(run), "id long, shingles array<long>").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs with 100 * intersection >= share * union, on full sets."""
    end = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    pairs = materialise(pairs, "pairs")
    forget_shuffles(sets.sparkSession)
    return pairs.join(end("b"), "b").join(end("a"), "a").where(100 * common >= share * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _can_link(x: str, y: str, share: int) -> Column:
    """False where the shingles that one document alone has rule a link out, whatever the others are."""
    shared_x, shared_y = F.col(f"n_{x}") - F.col(f"u_{x}"), F.col(f"n_{y}") - F.col(f"u_{y}")
    return 100 * F.least(shared_x, shared_y) >= share * (F.greatest(shared_x, shared_y) + F.col(f"u_{x}") + F.col(f"u_{y}"))


def _classes(docs: DataFrame, full: DataFrame, k: int) -> DataFrame:
    """(doc_id, rep): the smallest document with the same set, confirmed on the sets where keys agree."""
    reps = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    reps = materialise(reps.where("rep < last").drop("last"), "reps")
    shared = materialise(full.join(reps, ["set_a", "set_b"]).select("doc_id", "rep", F.col("set_a").alias("key")), "shared")
    ids = materialise(shared.groupBy(F.col("doc_id").alias("id")).agg(F.min("key").alias("key")), "ids")
    same = _confirmed(shared.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), _sets(docs, ids, k), 100)
    return materialise(same.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("rep")), "classes")


def _met_by_differences(groups: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (x, y) of one group that may link, from how their sets differ from their group's pivot.

    ``groups``: (pivot, rep, own, head, u), own and head the components of the document and of its pivot. With d runs of
    the pivot f missing and a others added, a link needs

        (100 + share) * (common differences)  >=  v_x + v_y - (100 - share) * n_f,    v = 100 d + share * a,

    as what both keep of the pivot is common anyway. A document outside the pivot's component has v > (100 - share) * n_f,
    so the right side is over zero: its pairs share a difference, and by the prefix rule (with the differences of a group
    in one order, rarest first) one among the first (all - needed + 1) of both. Differences that one document alone has
    are counted and not emitted.
    """
    per = 100 + share
    end = lambda c, s: sets.select(F.col("id").alias(c), F.col("shingles").alias(s))
    rows = groups.where("rep <> pivot").join(end("rep", "x"), "rep").join(end("pivot", "f"), "pivot")
    rows = rows.withColumn("more", F.array_except("x", "f")).withColumn("less", F.array_except("f", "x"))
    rows = rows.withColumn("v", 100 * F.size("less") + share * F.size("more")).withColumn("spare", (100 - share) * F.size("f"))
    # at least so many common differences in any pair, with an outside document or as one
    needed = F.when(F.col("own") != F.col("head"), F.ceil((F.col("v") - F.col("spare")) / 100)).otherwise(F.ceil((F.col("v") + 1) / per))
    rows = rows.withColumn("all", F.size("less") + F.size("more")).withColumn("needed", F.greatest(needed, F.lit(1)))
    rows = materialise(rows.where("all - u >= needed").select("pivot", "rep", "own", "head", "v", "spare", "all", "needed", F.concat("more", "less").alias("diff")), "diff")
    each = rows.select("pivot", "rep", F.explode("diff").alias("s"))
    several = each.groupBy("pivot", "s").agg(F.count("*").alias("n")).where("n > 1")
    ordered = each.join(several, ["pivot", "s"]).groupBy("pivot", "rep").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("diff"))
    ordered = rows.drop("diff").join(ordered, ["pivot", "rep"]).withColumn("shared", F.size("diff").cast("long")).where("shared >= needed")
    first = ordered.select("pivot", "rep", "own", "head", "v", "spare", "all", "shared", F.posexplode(F.slice("diff", F.lit(1), (F.col("shared") - F.col("needed") + 1).cast("int"))).alias("i", "d"))
    first = first.select("pivot", F.col("d.s").alias("s"), "rep", "own", "head", "v", "spare", "all", "shared", (F.col("all") - F.col("shared") + F.col("i") + 1).alias("place"))
    first = materialise(first, "first")
    forget_shuffles(sets.sparkSession)
    named = lambda c: first.select("pivot", "s", *(F.col(n).alias(a) for n, a in (("rep", c), ("own", f"{c}_own"), ("v", f"v_{c}"), ("all", f"all_{c}"), ("shared", f"shared_{c}"), ("place", f"place_{c}"))), *([] if c == "y" else ["head", "spare"]))
    need = f"ceil((v_x + v_y - spare) / {per})"
    meet = F.expr(f"x_own <> y_own and (y_own = head or x < y) and {need} <= least(shared_x, shared_y) and place_x <= all_x - {need} + 1 and place_y <= all_y - {need} + 1")
    pairs = named("x").where("x_own <> head").join(named("y"), ["pivot", "s"]).where(meet)
    return pairs.select("x", "y", "v_y").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    if not 0 < share <= 100:
        raise ValueError("share is a percentage")
    least = share / 100 - 6 * (share / 100 * (1 - share / 100) / M) ** 0.5
    rows = materialise(sketch(docs, k), "sketch")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = _classes(docs, full, k)
    nodes = full.withColumnRenamed("doc_id", "rep").join(classes.select(F.col("doc_id").alias("rep")), "rep", "left_anti")
    nodes = nodes.groupBy("rep").agg(F.min_by(F.struct("n_shingles", "registers", "bands", "set_a"), F.struct("set_a", "set_b")).alias("row"))
    nodes = materialise(nodes.select("rep", "row.*"), "nodes")
    forget_shuffles(docs.sparkSession)

    banded = nodes.select("rep", F.explode("bands").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    found_in = materialise(sift(banded, "band", sieve_of(shared, shared.count())).join(shared, "band"), "found_in")
    ids = materialise(nodes.select(F.col("rep").alias("id"), F.col("set_a").alias("key")).join(found_in.select(F.col("rep").alias("id")).distinct(), "id"), "ids")
    sets = materialise(_sets(docs, ids, k), "sets")
    forget_shuffles(docs.sparkSession)
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("u"))
    sizes = sets.select("id", F.size("shingles").cast("long").alias("n")).join(alone, "id", "left").select(F.col("id").alias("rep"), "n", F.coalesce("u", F.lit(0)).alias("u"))
    sizes = materialise(sizes, "sizes")
    forget_shuffles(docs.sparkSession)
    # the first of a band is the document with the least of its own: the original of a group of edited copies
    central = found_in.join(sizes, "rep").groupBy("band").agg(F.min_by("rep", F.struct("u", "rep")).alias("first"))
    members = materialise(found_in.join(central, "band").select("first", "rep").distinct(), "members")
    of = lambda c: sizes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("u").alias(f"u_{c}"))

    stars = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    stars = materialise(stars.join(of("a"), "a").join(of("b"), "b").where(_can_link("a", "b", share)).select("a", "b"), "stars")
    forget_shuffles(docs.sparkSession)
    links = materialise(_confirmed(_likely(stars, nodes, least), sets, share), "links")
    found = components(links)
    forget_shuffles(docs.sparkSession)

    # bands whose firsts are in one component are one group; its pivot is the most central of these firsts
    label = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    own = members.join(label("rep", "own"), "rep", "left").join(label("first", "head"), "first", "left").withColumn("own", F.coalesce("own", "rep")).withColumn("head", F.coalesce("head", "first"))
    pivots = own.select("head", F.col("first").alias("rep")).distinct().join(sizes, "rep").groupBy("head").agg(F.min_by("rep", F.struct("u", "rep")).alias("pivot"))
    # a document of which too much is its own links with nothing
    groups = own.select("head", "rep", "own").distinct().join(sizes, "rep").where(f"100 * (n - u) >= {share} * n")
    groups = materialise(groups.join(pivots, "head").where("rep <> pivot").select("pivot", "head", "rep", "own", "u"), "groups")
    forget_shuffles(docs.sparkSession)
    several = groups.groupBy("pivot").agg(F.count("*").alias("n"), F.max(F.expr("own <> head")).alias("outside")).where("outside and n > 1").select("pivot")
    pairs = materialise(_met_by_differences(groups.join(several, "pivot"), sets, share), "cross")
    forget_shuffles(docs.sparkSession)

    # first one member of each other component for each document, which joins most of what belongs together; then the rest
    tested = stars
    for last in (False, True):
        some = pairs.join(label("x", "c"), "x", "left").join(label("y", "d"), "y", "left").select("x", "y", "v_y", F.coalesce("c", "x").alias("c"), F.coalesce("d", "y").alias("d")).where("c <> d")
        if not last:
            some = some.groupBy("x", "d").agg(F.min_by("y", F.struct("v_y", "y")).alias("y"))
        some = some.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        some = materialise(some, "some")
        if some.isEmpty():
            continue
        tested = tested.union(some)
        more = materialise(_confirmed(_likely(some, nodes, least), sets, share), "links")
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
    of_node = nodes.select("rep").join(label("rep", "component_id"), "rep", "left").select("rep", F.coalesce("component_id", "rep").alias("component_id"))
    out = full.select("doc_id", "n_shingles").join(classes, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(of_node, "rep").select("doc_id", "n_shingles", "component_id")
    rest = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, k: int = 5, share: int = 85) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one document of each group: the one of the smallest id.

    Of rows that repeat an id the one with the smallest text stays. Rows with a null id stay. Only documents that are in a
    group, or repeat an id, are shuffled.
    """
    node, by = unused(docs.columns, "touched_id"), unused(docs.columns, "touched_by")
    found = near_duplicates(docs, k, share).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    touched = materialise(found.where("rows > 1 or component_id <> doc_id").select(F.col("doc_id").alias(node), F.col("component_id").alias(by)), "touched")
    some = among(docs, "doc_id", touched.select(node))
    some = some.join(touched, F.col("doc_id") == F.col(node), "left").where(F.col(node).isNull() | (F.col(by) == F.col("doc_id")))
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    some = some.withColumn(by, F.row_number().over(first)).where(F.col(by) == 1).select(*docs.columns)
    return among(docs, "doc_id", touched.select(node), inside=False).unionByName(some)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in whole ``documents``, a row for each document."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
