import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cloakline.llm import exact_dedup as ed


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_hashes_compose(a, b):
    assert ed.combine(ed.text_hash(a), ed.text_hash(b), len(b)) == ed.text_hash(a + b)


def test_long_text_equals_plain_evaluation():
    data = bytes(range(256)) * 600
    for r, h in zip(ed.POINTS, ed.text_hash(data), strict=True):
        total = 0
        for byte in data:
            total = (total * r + byte + 1) % ed.P
        assert h == total


def brute(rows):
    norm = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return sorted((i, max(by[norm(t)]), len(by[norm(t)]), i == max(by[norm(t)]), norm(t)) for i, t in rows)


ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 150_000), (8, "X" * 150_000), (9, "x" * 149_999 + "y"), (10, "alone"), (10, "alone"), (11, "abd"), (12, "acc")]


def test_groups(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, kept int")
    for huge in (ed.HUGE, 40_000):
        got = sorted(tuple(r) for r in ed.groups(docs, huge=huge).collect())
        assert got == brute(ROWS)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ed, "SALT_ROWS", 1)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(tuple(r) for r in ed.groups(docs, points=(1,)).collect())  # sums of bytes: abd and acc collide
    assert got == brute(ROWS)


def test_kept_rows_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = sorted(r.doc_id for r in ed.deduplicate(docs).collect())
    assert kept == [2, 4, 5, 6, 8, 9, 10, 11, 12]
    assert ed.groups(docs.limit(0)).count() == 0
