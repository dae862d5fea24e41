import array
import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlake.llm import bpe as B
from cohortlake.llm.common import ship
from cohortlake.llm.encoding import default_tokenizer

LIBRARY = Tokenizer.from_file(default_tokenizer())
ENCODER = B.MergeEncoder(default_tokenizer(), cache_size=50)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ours(texts):
    return [array.array("I", x).tolist() for x in ENCODER.encode(texts)]


@given(st.lists(st.text(alphabet=st.sampled_from("ab1 \n\t.,'sé  😀<|>\x00\x1c\x85"), max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_texts_encode_as_in_the_library(texts):
    assert ours(texts) == [plain(t) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_characters(text):
    ids = ours([text])[0]
    assert ids == plain(text)
    assert ENCODER.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_special_long_and_repeated():
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("etaoinsh"), 3000))
    texts = [
        "<|endoftext|> in a text  <|endoftext|>  x<|endoftext|>", "  <|endoftext|>", None, "", " ", "a" * 1023, "a" * 1025, "b" * 30_001, letters, letters[:1000], "\n" * 3000 + "x", "日本語の文章" * 600, "é" * 900,
        *(f"w{i} w{i + 1}" for i in range(100)),
    ]
    assert ours(texts) == [plain(t) for t in texts]
    assert 50256 in plain(texts[0])
    text = B.MergeEncoder(default_tokenizer(), added=False)
    LIBRARY.encode_special_tokens = True
    try:
        assert array.array("I", text.encode([texts[0]])[0]).tolist() == plain(texts[0])
    finally:
        LIBRARY.encode_special_tokens = False


@given(st.lists(st.integers(0, 50_300), max_size=12))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_as_in_the_library(ids):
    assert ENCODER.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def expected(rows):
    out = []
    for doc, text in rows:
        ids = plain(text)
        out.append((doc, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = [tuple(r) for r in B.op12_bpe(spark, sf_dir).collect()]
    assert sorted(got, key=str) == expected(list(zip(docs["doc_id"], docs["text"])))


def test_odd_rows(spark, odd, empty):
    ship(spark)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    both = B.decode(B.encode(odd, default_tokenizer()), default_tokenizer())
    assert sorted(((r.doc_id, r.decoded) for r in both.collect()), key=str) == sorted(rows, key=str)
    once = [(r.doc_id, r.n_tokens, r.decoded) for r in B.round_trip(odd, default_tokenizer()).collect()]
    assert sorted(once, key=str) == sorted(((r.doc_id, r.n_tokens, r.decoded) for r in both.collect()), key=str)
    assert B.round_trip(empty, default_tokenizer()).count() == 0


def test_files_of_another_kind_are_refused(tmp_path):
    (tmp_path / "x.json").write_text('{"normalizer": null, "pre_tokenizer": {"type": "Whitespace", "add_prefix_space": false}, "model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError):
        B.Merges(str(tmp_path / "x.json"))
