import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakline.llm import common, simple8b
from cloakline.llm.bpe import word_bpe_file


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(2**64 - 1), st.just(15 << 60)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, np.uint64)
    words, places = simple8b.pack(ids)
    assert (simple8b.unpack(words) == ids).all() and len(simple8b.unpack(words)) == len(ids)
    for b in range(len(places)):
        assert (simple8b.unpack_block(words, places, b) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_ranges_and_the_block_table():
    ids = np.array([i * i if i % 7 else 1 << 62 for i in range(1000)], np.uint64)
    words, places = simple8b.pack(ids)
    for a, b in ((0, 1000), (0, 0), (5, 6), (127, 129), (128, 256), (990, 1000), (300, 300)):
        assert (simple8b.unpack_range(words, places, a, b) == ids[a:b]).all()
    assert (simple8b.unpack(words, places) == ids).all()
    with pytest.raises(ValueError):
        simple8b.unpack(words, places + np.arange(len(places)) % 2)


def test_words_are_as_full_as_greedy_packing():
    ids = np.array([1] * 60 + [1 << 14] * 4 + [1 << 59], np.uint64)
    words, _ = simple8b.pack(ids, block=1000)
    assert len(words) == 1 + 1 + 1
    assert len(simple8b.pack(np.array([1 << 63], np.uint64))[0]) == 2


def test_damaged_image():
    data = simple8b.image([4], [np.arange(5, dtype="<u4").tobytes()])
    with pytest.raises(ValueError):
        simple8b.read_image(data[:-8])


def test_files_round_trip(spark):
    texts = {3: "a b\nc", 1: None, 2: "", 9: "Ünï  code 12 " * 4000, 7: "same", 8: "same"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, start int")
    path = common.fresh_path(spark, "ids")
    simple8b.write(docs, word_bpe_file(), 2, path)
    library = Tokenizer.from_file(word_bpe_file())
    some = {r.doc_id: r.ids for r in simple8b.read_some(spark, path, [9, 2, 77]).collect()}
    assert some == {k: [*library.encode(texts[k], add_special_tokens=False).ids, 2] for k in (9, 2)}
    start = 0
    rows = {r.doc_id: r for r in simple8b.read(spark, path).collect()}
    whole = {r.doc_id: r.ids for r in simple8b.read(spark, path, digest_only=False).collect()}
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        got = rows[doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[doc_id] == ids
        start += len(ids)


def test_empty_table_and_ties(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = common.fresh_path(spark, "none")
    simple8b.write(empty, word_bpe_file(), 2, path)
    assert simple8b.read(spark, path).count() == 0
    path = common.fresh_path(spark, "ties")
    simple8b.write(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string"), word_bpe_file(), 2, path)
    rows = sorted((r.start, r.doc_id) for r in simple8b.read(spark, path).collect())
    assert [r[1] for r in rows] == [None, 1, 1, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["The", "the,", "Ende.", "İx", "\u0958a", "don't", "it's.", "Σ!", "a" * 90, "x1."]), max_size=30))
def test_pieces_equal_the_whole_text(parts):
    source = open(word_bpe_file(), encoding="utf-8").read()
    text = " ".join(parts)
    want = Tokenizer.from_str(source).encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(simple8b.encoder(source).encode([text, None])[0], "<u4").tolist() == want
