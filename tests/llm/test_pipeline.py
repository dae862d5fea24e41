import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from test_decontamination import brute as brute_hits
from test_near_dedup import brute as brute_groups
from test_substring import exact_repeats, words

from cohortlake.llm.common import materialise, ship
from cohortlake.llm.encoding import Encoder, default_tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf_dir), name)
        steps[name] = (before, docs.collect())
        assert docs.columns == columns or name == "packing"

    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pandas().set_index("doc_id")["quality"]
    before, after = steps["quality_classifier"]
    kept = {r.doc_id for r in after}
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in kept) == labels[i] for i in held) / len(held) > 0.93 and all(before[r.doc_id] == r.text for r in after)

    before, after = steps["minhash_near_dedup"]
    assert {r.doc_id: r.text for r in after} == {i: before[i] for i, (_, c) in brute_groups(before.items()).items() if i == c}

    before, after = steps["substring_dedup"]
    repeats, texts = exact_repeats(before.items()), {r.doc_id: r.text for r in after}
    for i, text in before.items():
        lost = len(words(text)) - len(words(texts.get(i, "")))
        assert lost >= len(repeats.get(i, ())) and (i in texts or len(words(text)) == lost)
    assert {i for i in before if texts.get(i) != before[i]} >= set(repeats)
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = steps["benchmark_decontamination"]
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    hits = {x[0]: x for x in brute_hits(before.items(), zip(items["item_id"], items["text"]))}
    texts = {r.doc_id: r.text for r in after}
    for i, text in before.items():
        if hits[i][2] > 0.5 * hits[i][1]:
            assert i not in texts
        else:
            assert (texts[i] == text) == (hits[i][2] == 0)
    assert not any(x[2] for x in brute_hits([(i, t) for i, t in texts.items() if hits[i][2] == 0], zip(items["item_id"], items["text"])))

    before, after = steps["packing"]
    encoder = Encoder(default_tokenizer())
    pieces = {}
    for r in after:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in before.items():
        ids, at = encoder.encode([text])[0] + bytes(4), 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and zlib.crc32(ids[4 * start : 4 * (start + n)]) == crc
            at += n
        assert 4 * at == len(ids)


def test_run_equals_stages_on_the_smallest_tables(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "start"]


def test_stages_leave_the_tables_of_others(spark, sf_dir):
    """Only what the stages wrote is removed, and not what the next stage reads."""
    from cohortlake.llm.common import owned, release

    mine = materialise(spark.range(5), "mine")
    with owned(spark, corpus_pipeline.OWNER):
        theirs, docs = materialise(spark.range(6), "theirs"), materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), "docs")
    again = materialise(spark.range(7), "again")
    path = theirs.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert Path(path).exists()
    kept = corpus_pipeline.drop_benchmark(spark, docs, sf_dir)
    assert not Path(path).exists() and mine.count() == 5 and again.count() == 7 and 0 < kept.count() <= docs.count()
    release(spark, corpus_pipeline.OWNER)
    assert mine.count() == 5


def test_odd_rows(spark, odd, empty):
    ship(spark)
    from cohortlake.llm import near_dedup as N

    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "None", "7", "9"])
    assert N.keep_one(empty).count() == 0
