import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortlake.llm import quality as Q
from cohortlake.llm import toxicity as T
from cohortlake.llm.common import ship


def auc(scores, truth):
    rank = np.argsort(np.argsort(scores)) + 1
    truth = np.array(truth)
    ones = truth.sum()
    return (rank[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def held_out(rows, sf_dir, label):
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pandas().set_index("doc_id")[label].to_dict()
    got = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return auc(*zip(*got))


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = Q.op5_quality(spark, sf_dir).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert held_out(rows, sf_dir, "quality") > 0.97


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = T.op6_toxicity(spark, sf_dir).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert held_out(rows, sf_dir, "toxic") > 0.9


def test_ftrl_equals_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 40, 12))) for _ in range(120)]
    rows += [(1, np.array([3, 50])), (0, np.array([], np.int64))]  # 50 is in fewer documents than MIN_DOCUMENTS
    at, w, bias = T.ftrl(rows, epochs=2, seed=3)
    z, n, count = {}, {}, {}
    for _, x in rows:
        for i in x.tolist():
            count[i] = count.get(i, 0) + 1

    def weight(i):
        l1 = 0 if i == "bias" else T.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for k in order.permutation(len(rows)).tolist():
            y, x = rows[k]
            used = [i for i in x.tolist() if count[i] >= T.MIN_DOCUMENTS] + ["bias"]
            own = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(own.values()))) - y
            for i in used:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / T.ALPHA * own[i]
                n[i] = before + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert want and sorted(want) == at.tolist() and 50 not in want
    assert np.allclose(w, [want[i] for i in sorted(want)]) and np.isclose(bias, weight("bias"))


def test_context_vectors_equal_plain_sums(spark):
    ship(spark)
    texts = ["a b c a", None, "", "b b , c"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2)
    from cohortlake.llm import words as W

    got = Q.context_vectors(docs)
    sums = np.zeros((Q.BUCKETS, Q.SIZE))
    for text in texts:
        b = Q._bucket(W.of_bytes(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]), W.WITH_MARKS))
        for i in range(len(b)):
            for j in range(max(0, i - Q.REACH), min(len(b), i + Q.REACH + 1)):
                if i != j:
                    np.add.at(sums[b[i]], Q._PLACE[b[j]], Q._SIGN[b[j]])
    seen = sums.any(axis=1)
    sums[seen] /= np.linalg.norm(sums[seen], axis=1, keepdims=True)
    sums[seen] -= sums[seen].mean(axis=0)
    want = sums[seen] / np.maximum(np.linalg.norm(sums[seen], axis=1, keepdims=True), 1e-9)
    assert np.allclose(got[seen], want, atol=1e-6) and not got[~seen].any()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, Q.FEATURES)).astype(np.float32)
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = Q.train(x[:3000], y[:3000]).probability(x[3000:])
    for lo in np.arange(0, 1, 0.2):
        own = (p >= lo) & (p < lo + 0.2)
        assert abs(p[own].mean() - y[3000:][own].mean()) < 0.12


def test_odd_rows(spark, odd, empty):
    ship(spark)
    n = odd.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (4, 0, 0)], none.schema)
    for labels in (none, some):
        got = Q.score_quality(odd, labels).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
        got = T.score(odd, T.train(odd, labels, F.lit(True))).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
        assert Q.score_quality(empty, labels).count() == 0
        assert T.score(empty, T.train(empty, labels, F.lit(True))).count() == 0
    assert {r.score for r in Q.score_quality(odd, none).collect()} == {0.5}
    kept = Q.keep_quality(odd, none)
    assert kept.columns == odd.columns and kept.count() == n
