import hashlib
import re

import pyarrow.parquet as pq

from cohortlake.llm import decontamination as D
from cohortlake.llm.common import ship

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower() if text is None else bytes(text, "utf8").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def brute(docs, items, n=10):
    known = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in known}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (got := known.get(tuple(w[i : i + s]))) is not None:
                    hit |= set(range(i, i + s))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    want = brute(zip(docs["doc_id"], docs["text"]), zip(items["item_id"], items["text"]))
    got = sorted((tuple(r) for r in D.op3_decontamination(spark, sf_dir).collect()), key=str)
    assert got == want and any(r[5] for r in got)


def test_odd_rows_blocks_and_short_items(spark, odd, empty):
    ship(spark)
    items = [(1, "TWO three, four"), (2, None), (3, "..."), (4, "one two three four five six seven eight nine ten eleven"), (5, "two three four"), (None, "word")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows, [x for x in items if x[0] is not None])
    for bound in (1_000, 2):
        got = D.mark(odd, frame, max_windows=bound).collect()
        assert sorted((r.doc_id, r[D.WORDS], r[D.HITS], len(r[D.ITEMS])) for r in got if r.doc_id) == sorted(x[:4] for x in want if x[0])
        assert {r.registers for r in got} == {"clash"}
    assert D.mark(empty, frame).count() == 0
    none = D.mark(odd, frame.limit(0))
    assert none.where(f"{D.HITS} > 0").count() == 0 and none.count() == len(rows)


def test_spans_and_documents_go(spark):
    ship(spark)
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Start here, {item}; and so it ends with many words after the passage is over."), (2, item), (3, "clean"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "Start here, ; and so it ends with many words after the passage is over.", 3: "clean", 4: None}


def test_names_that_the_operator_adds(spark):
    ship(spark)
    words = [f"w{i}" for i in range(10)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after all of that is said, and more of it than was in the item itself", 5, "a")], f"doc_id long, text string, {D.HITS} int, {D.ITEMS.upper()} string")
    (got,) = D.decontaminate(docs, items).collect()
    assert got.asDict().keys() == {"doc_id", "text", D.HITS, D.ITEMS.upper()} and got[2:] == (5, "a") and got.text.startswith("before  after")
    assert D.mark(docs, items).select(D.HITS).first()[0] == 10
