import array
import json
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import packing as P
from cohortlake.llm import token_output as O
from cohortlake.llm.common import fresh_path, ship
from cohortlake.llm.encoding import Encoder, default_tokenizer

ENCODER = Encoder(default_tokenizer(), cache_size=50)


def plain(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab1 \n\t.,'sé  😀<|>\x00"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_whole(text):
    assert array.array("I", ENCODER.encode([text])[0]).tolist() == plain(text)


def test_special_strings_are_text_and_caches_empty():
    texts = ["<|endoftext|> in a text", None, "", " ", "  lead", "x" * 5000, *(f"w{i} w{i + 1}" for i in range(100))]
    assert [array.array("I", x).tolist() for x in ENCODER.encode(texts)] == [plain(x) for x in texts]
    assert 50256 not in plain(texts[0])


@given(st.lists(st.text(alphabet=st.sampled_from("abÉ1²'s$_.-~\n\u0301中ɐ"), max_size=8), max_size=12))
@settings(max_examples=300, deadline=None)
def test_stems_and_marks_encode_as_the_whole(parts):
    text = " ".join(parts)
    assert array.array("I", ENCODER.encode([text])[0]).tolist() == plain(text)


def test_words_are_encoded_once_whatever_marks_follow(monkeypatch):
    """One word before many marks goes through the tokenizer once."""
    encoder, seen = Encoder(default_tokenizer()), []
    tokenizer = encoder.tokenizer

    class Counted:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            seen.append(text)
            return tokenizer.encode(text, **options)

    encoder.tokenizer = Counted()
    text = "first " + " ".join(f"nonesuch{'$' * n}" for n in range(1, 40)) + " nonesuch"
    assert array.array("I", encoder.encode([text])[0]).tolist() == plain(text)
    assert sum(x.count("nonesuch") for x in seen) == 1


def expected(rows):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(text) + [0]
        out.append((doc, at, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_query_round_trip(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = sorted(map(tuple, O.op1_token_output(spark, sf_dir).collect()))
    assert got == expected(list(zip(docs["doc_id"], docs["text"])))


@pytest.mark.parametrize("type_", ["u2", "u4"])
def test_files(spark, odd, type_):
    ship(spark)
    uri = fresh_path(spark, "tokens")
    manifest = O.write_tokens(odd, uri, default_tokenizer(), type_=type_)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, O.read_documents(spark, uri).collect()), key=lambda r: r[1]) == expected(rows)
    with open(f"{uri.removeprefix('file://')}/manifest.json") as f:
        assert json.load(f) == manifest and manifest["type"] == type_
    bases = np.cumsum([0] + [s["tokens"] for s in manifest["shards"]])
    assert [s["base"] for s in manifest["shards"]] == bases[:-1].tolist() and bases[-1] == manifest["tokens"]
    for s in manifest["shards"]:
        offsets = O.mapped(uri, f"offsets-{s['shard']:05d}.bin", "u8")
        assert offsets[-1] == s["tokens"] == len(O.mapped(uri, f"tokens-{s['shard']:05d}.bin", type_)) and len(offsets) == s["documents"] + 1


def check_packing(rows, got, capacity=1024):
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(plain(text) + [0])
    covered = {}
    for r in got:
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array.array("I", ids[r.start : r.start + r.length]).tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, pieces in covered.items():
        times = len(texts[doc])
        assert sorted(i for s, n in pieces for i in range(s, s + n)) == sorted(list(range(len(texts[doc][0]))) * times)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0  # a power of two: nothing is padded


def test_packing_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    check_packing(list(zip(docs["doc_id"], docs["text"])), P.op7_packing(spark, sf_dir).collect())


def test_packing_odd_rows(spark, odd, empty):
    ship(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity in (1, 16, 1024):
        check_packing(rows, P.pack(odd, default_tokenizer(), capacity).collect(), capacity)
    assert P.pack(empty, default_tokenizer()).count() == 0
    uri = fresh_path(spark, "tokens")
    O.write_tokens(empty, uri, default_tokenizer())
    assert O.read_documents(spark, uri).count() == 0
    with pytest.raises(ValueError):
        P.pack(odd, default_tokenizer(), 1000)


def packed_lengths(lengths, capacity):
    """The rows of one worker's bins, after checks that hold for all lengths: every token once, nothing padded."""
    bins = P.Bins(capacity, 0)
    for doc, n in enumerate(lengths):
        bins.add(doc, np.arange(n, dtype="<u4").tobytes())
        assert len(bins.waiting) <= P.WAITING and bins.in_long <= P.STOCK * capacity and bins.in_short <= (P.STOCK + 1) * capacity
    bins.finish()
    assert not (bins.open or bins.waiting or bins.short or bins.long)
    size, parts = {}, {}
    for doc, start, n, crc, tokens, sequence, offset in bins.rows:
        assert tokens == lengths[doc] and crc == zlib.crc32(np.arange(start, start + n, dtype="<u4").tobytes())
        size[sequence] = size.get(sequence, 0) + n
        parts.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(parts[doc]):
            assert start == at
            at += m
        assert at == n
    assert all(n == capacity or n & (n - 1) == 0 for n in size.values())
    assert sum(n < capacity for n in size.values()) <= capacity.bit_length()
    return bins.rows


def test_reciprocal_classes():
    """A class has the lengths of which k fit and k + 1 don't; k whole documents fill its bins."""
    for capacity in (16, 1024):
        for n in range(1, capacity + 1):
            k = P.reciprocal_class(n, capacity)
            assert (n * k <= capacity < n * (k + 1) and 1 <= k <= P.CLASSES) if k else n * (P.CLASSES + 1) <= capacity
    # three of a third each, and what their bin lacks from a long document
    rows = packed_lengths([2048, 300, 300, 300], 1024)
    bin_ = next(r[5] for r in rows if r[0] == 1)
    assert [(r[0], r[2]) for r in rows if r[5] == bin_] == [(1, 300), (2, 300), (3, 300), (0, 124)]


def test_packing_keeps_documents_whole():
    """Documents that fit a sequence are rarely cut where there are long or short ones, and no length pattern breaks the bins."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 1025, 700), rng.integers(1025, 6000, 300)])
    rows = packed_lengths(rng.permutation(lengths).tolist(), 1024)
    pieces = np.bincount([r[0] for r in rows if r[4] <= 1024])
    assert (pieces > 1).sum() < 70 and pieces.sum() < 1.2 * 700
    for same in (1, 7, 113, 114, 341, 342, 512, 513, 600, 1023, 1024, 1025, 5000):
        packed_lengths([same] * 400, 1024)
    packed_lengths(rng.integers(513, 1025, 500).tolist(), 1024)
    packed_lengths(rng.integers(1, 40, 3000).tolist(), 16)
    packed_lengths([], 1024)


def test_packing_without_a_kept_encoder_has_a_small_cache(spark, sf_dir):
    """Not a cache of the size that workers with memory of their own have; the pieces are the same."""
    from cohortlake.llm import encoding, packing
    from cohortlake.llm.common import table

    assert packing.SMALL_CACHE * 5 < encoding.Encoder.__init__.__defaults__[0]
    docs = table(spark, sf_dir, "documents").coalesce(1)
    pieces = lambda keep: sorted(tuple(r) for r in packing.pack(docs, encoding.default_tokenizer(), keep_encoder=keep).collect())
    assert pieces(False) == pieces(True)
