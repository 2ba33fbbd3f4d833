import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakline.llm import quality as q
from cloakline.llm.bpe import word_bpe_file

LIBRARY = Tokenizer.from_file(word_bpe_file())
START = max(LIBRARY.get_vocab(with_added_tokens=True).values()) + 1


def symbols(text):
    words = (text or "").split()
    words = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
    return [START, *LIBRARY.encode(" ".join(words), add_special_tokens=False).ids]


def plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: p(previous, symbol, own count that is left out)."""
    two = Counter(x for s in map(symbols, texts) for x in zip(s, s[1:], strict=False))
    one = Counter(w for _, w in two)

    def discounts(c):
        n = Counter(c.values())
        n1, n2, n3, n4 = (n[k] for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.5], strict=True)]

    d2, d1 = discounts(two), discounts(one)
    off = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    total, rest = Counter(), Counter()
    for (v, _), n in two.items():
        total[v] += n
        rest[v] += off(n, d2)
    every = sum(one.values())
    held = sum(off(n, d1) for n in one.values())

    def p(v, w, less=0):
        below = (max(one[w] - off(one[w], d1), 0) + held / (START + 1)) / every
        if not total[v]:
            return below
        n = max(two[v, w] - less, 0)
        return max(n - off(n, d2), 0) / total[v] + rest[v] / total[v] * below

    return p


@pytest.mark.parametrize("salt_docs", [q.SALT_DOCS, 2])
def test_scores_against_plain_counts(spark, monkeypatch, salt_docs):
    monkeypatch.setattr(q, "SALT_DOCS", salt_docs)
    monkeypatch.setattr(q, "SALT_GRAMS", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(q.common, "bounded_batches", lambda s: s)
    texts = ["The cat sat. The cat ran!", "A dog, a cat; a cow", "the the the cow", "\u00c9a 12 - x \u6f22\u5b57"] * 2 + ["The cow sat on the cat"]
    others = [None, "", "zebra zebra zebra", "the cat the cat ran and \u6f22\u5b57 sat", "a " * 500]
    counts, lower = q.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    p = plain_model(texts)
    rows = [*enumerate(texts), *enumerate(others, 100)]
    docs = spark.createDataFrame([(i, "xx", t) for i, t in rows], "doc_id long, lang string, text string").repartition(4)
    source = spark.sparkContext.broadcast(q.source_of(None))
    got = {r.doc_id: r for r in q.scores(docs, counts, lower, source).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        s = symbols(t)
        own = Counter(zip(s, s[1:], strict=False))
        assert math.isclose(got[i].nll, -sum(n * math.log(p(v, w)) for (v, w), n in own.items()), rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(got[i].nll_held_out, -sum(n * math.log(p(v, w, n)) for (v, w), n in own.items()), rel_tol=1e-4, abs_tol=1e-4)
        assert got[i].n_chars_scored == sum(len(w) + 1 for w in (t or "").split())
    assert math.isclose(sum(p(START, w) for w in range(START + 1)), 1, rel_tol=1e-9)
    assert math.isclose(np.exp(lower.log_lower).sum(), 1, rel_tol=1e-9)


def test_blocks_round_trip():
    grams, docs, times = np.array([3, 3, 9, 1 << 40]), np.array([0, 7, 2, 65_000]), np.array([1, 300, 2, 70_000])
    keys, sizes, d, n = q.unpacked(q.packed(grams, docs, times))
    assert keys.tolist() == [3, 9, 1 << 40] and sizes.tolist() == [2, 1, 1] and d.tolist() == docs.tolist() and n.tolist() == times.tolist()


def corpus():
    rng = random.Random(8)
    syllables = [a + b for a in "tkmnslrpgdb" for b in ("a", "e", "i", "o", "un", "er")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.choice([5, 40, 200]))]
        bad = i % 8 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 16 else [words[k - k % 15] for k in range(len(words))] * 3
        rows.append((i, " ".join(words) + ".", rng.choice(["aa", "bb"])))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, rejected int")
    got = {r.doc_id: r.rejected for r in q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, _ in rows if i % 2 and i % 3]
    assert not any(got[i] for i in held)
    caught = [got[i] for i, t, _ in rows if i % 8 == 0 and len(t) > 100]
    assert sum(caught) / len(caught) > 0.95
    kept = q.keep(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.count() == sum(not x for x in got.values())


def test_rows_of_one_id_go_by_their_own_texts(spark):
    rows, labels = corpus()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    junk = " ".join(["XQZ%d!!##" % i for i in range(80)])
    extra = [(None, rows[1][1], "aa"), (None, junk, "aa"), (1, junk, "aa")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    kept = q.keep(docs, labels).filter("doc_id is null or doc_id = 1").collect()
    assert sorted(r.text for r in kept) == [rows[1][1]] * 2


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "", "aa"), (None, "word " * 20_000, "zz"), (2, "a b", "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 4 and not any(r.rejected for r in got if not r.n_chars_scored)
    assert not any(r.rejected for r in q.classify(docs, labels.limit(0)).collect())
    assert q.classify(docs.limit(0), labels).count() == 0
    assert docs.select(F.count("*")).first()[0] == 4
