"""What Python workers hold: one stage's tables at a time, and a part of a batch at once."""

import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cloakline.llm import bpe, common, pieces, simple8b
from cloakline.llm import quality as q

SOURCE = q.source_of(None)
TEXTS = [None, "", "The cat sat, the cat ran!", "a " * 300, "Éa 12 - x 漢字", "the the cow", "word" * 200, None, "A dog; a cat"] * 3


@pytest.fixture(scope="module")
def automaton():
    return bpe.compiled(SOURCE)


def test_a_worker_keeps_one_stage_at_a_time(automaton):
    first = weakref.ref(simple8b.encoder(SOURCE))
    assert simple8b.encoder(SOURCE) is first()
    second = weakref.ref(bpe.codec(("key", SOURCE, automaton)))
    assert first() is None and second() is not None
    list(common.tidy(iter, keeps=True)(iter([])))
    assert bpe.codec(("key", SOURCE, automaton)) is second()
    list(common.tidy(iter)(iter([])))
    assert second() is None


@pytest.mark.parametrize("texts", [[], [None], [""], TEXTS])
def test_parts_are_all_texts_in_order(monkeypatch, texts):
    monkeypatch.setattr(pieces, "PART_BYTES", 40)
    parts = list(pieces.parts(pa.array(["x", *texts], pa.string()).slice(1)))
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert all(sum(len((t or "").encode()) for t in p.to_pylist()[:-1]) <= 40 for p in parts)


def test_parts_give_what_each_text_gives(monkeypatch, automaton):
    texts = pa.array(TEXTS, pa.string())
    whole = bpe.Codec(SOURCE, automaton).digests(texts)
    monkeypatch.setattr(pieces, "PART_BYTES", 40)
    codec, symbols = bpe.Codec(SOURCE, automaton), q.Symbols(SOURCE)
    parts = codec.digests(texts)
    assert parts[0].tolist() == whole[0].tolist() and parts[1:] == whole[1:]
    assert symbols.encoder.encode(texts) == [symbols.encoder.encode([t])[0] for t in TEXTS]
    found = list(symbols.pairs(texts))
    assert len(found) > 3
    alone = [next(symbols.pairs(pa.array([t], pa.string()))) for t in TEXTS]
    assert [g.tolist() for own, _ in found for g in own] == [own[0].tolist() for own, _ in alone]
    assert [n for _, c in found for n in c.tolist()] == [c[0] for _, c in alone]


def test_counts_add_up():
    rng = np.random.default_rng(3)
    several = [np.unique(rng.integers(0, 50, n), return_counts=True) for n in (0, 1, 40, 300)]
    want = Counter()
    for keys, n in several:
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    keys, n = q.summed(several)
    assert keys.tolist() == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    assert [len(x) for x in q.summed([])] == [0, 0]
