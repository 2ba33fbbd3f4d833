import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakline.llm import bpe

SOURCE = open(bpe.word_bpe_file(), encoding="utf-8").read()
CODEC, LIBRARY = bpe.Codec(SOURCE), Tokenizer.from_str(SOURCE)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_words_and_marks():
    for text in ["", " ", "a" * 3000, "ab" * 500, "it's they'll", "<|endoftext|>x <|startoftext|>", "İΣ ḱ\ń", "　x\x85y\x1cz", "1234 5.6!!??"]:
        same(text)


def test_small_automaton_against_merging_by_priority():
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "a"), ("aa", "a" + bpe.END)]
    symbols = ["a", "b", "a" + bpe.END, "b" + bpe.END]
    vocab = {t: i for i, t in enumerate([*symbols, *(x + y for x, y in merges)])}
    automaton = bpe.Automaton(vocab, merges)
    rng = random.Random(5)
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        parts = [*word[:-1], word[-1] + bpe.END]
        for x, y in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        assert automaton.path(word) == [vocab[p] for p in parts], word


def test_query_rows(spark):
    texts = [None, "", "Hello, hello", "Hello, hello", "x" * 50_000]
    docs = spark.createDataFrame([(i // 2, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(docs, bpe.word_bpe_file()).collect()
    assert len(rows) == 5
    for row, text in zip(rows, texts, strict=True):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), bpe.word_bpe_file()).count() == 0
    encoded = bpe.encode_ids(docs, bpe.word_bpe_file())
    assert bpe.decode_ids(encoded, bpe.word_bpe_file()).count() == 5
