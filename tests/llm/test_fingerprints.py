import hashlib

import numpy as np
import pyarrow.parquet as pq

from cohortlake.llm import fingerprints as P
from cohortlake.llm.common import ship


def plain(text):
    """The definition, pair by pair."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    pairs = P.numbered(P.kmer_hashes(points))
    if not len(pairs):
        return [0] * P.HASHES
    out = []
    for i in range(P.HASHES):
        h = pairs * P._A[i] + P._B[i]
        chosen = sorted(sorted(range(len(pairs)), key=lambda j: (h[j], j))[: P.PAIR])
        got = sum(int(pairs[j]) * int(c) for j, c in zip(chosen, P._C)) % 2**64
        out.append(int(P.mix(np.array([(got + i) % 2**64], np.uint64))[0] >> np.uint64(32)))
    return out


def test_fingerprint_equals_definition(sf_dir):
    for text in ["", "a", "abc", "a" * 500, "abcdefgh" * 40, *pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:15]]:
        assert P.fingerprint(text).tolist() == plain(text)


def test_order_matters_and_likeness_falls_with_edits():
    words = [f"word{i}" for i in range(600)]
    text = " ".join(words)
    small = " ".join(words[:300] + ["inserted"] + words[300:])
    moved = " ".join(words[::-1])
    like = lambda x: P.likeness(P.fingerprint(text), P.fingerprint(x))
    assert like(text) == 1 and like(small) > 0.8 and like(moved) < 0.2
    assert len(set(P.numbered(P.kmer_hashes(np.full(50, 65, np.uint32))).tolist())) == 43


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text)
        new = text[: n - n // 3] + following[: n // 3]
        a, b, c = map(P.fingerprint, (text, new, following))
        out.append((doc, n, hashlib.sha256(new.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), P.likeness(a, b), P.likeness(a, c)))
    return sorted(out, key=str)


def test_query_equals_definition(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = P.op4_fingerprints(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == expected(list(zip(docs["doc_id"], docs["text"])))
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2


def test_odd_rows(spark, odd, empty):
    ship(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for ranges in (1, 4, 50):
        assert sorted(map(tuple, P.edited_pairs(odd, ranges).collect()), key=str) == expected(rows)
    one = odd.where("doc_id = 6")
    assert sorted(map(tuple, P.edited_pairs(one).collect()), key=str) == expected([(6, "word")])
    assert P.edited_pairs(empty).count() == 0
    assert P.fingerprints(odd).count() == len(rows)
