import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakline.llm import common


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(out.count())
        if name == "exact_dedup":
            assert out.select(F.countDistinct(F.sha2(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))).first()[0] == counts[-1]
        docs = out
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert counts[4] == counts[5]
    assert corpus_pipeline.run(spark, sf).count() == counts[5]


EXTRA = "copies int, class string, _digest string, _kept_id boolean"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
STAY = dict(corpus_pipeline.STAGES[:-1])


def prose(n, words=40):
    return " ".join(f"{x}{(n * 7 + i) % 97}" for i, x in enumerate(["alpha", "beta", "gamma", "delta"] * (words // 4)))


def rows_of():
    extra = (1, "c", "d", False)
    texts = [(None, None), (None, ""), (1, ""), (2, None), (3, prose(1)), (4, prose(1).upper()), (4, prose(1)), (4, prose(1)), (5, prose(2) + " tail"), (6, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (8, prose(9, 120_000)), (9, "a" * 300_000), (10, "x")]
    return [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t or ""), *extra) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name", STAY)
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns: rows come back whole, with all their columns."""
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    out = STAY[name](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    got, given = [tuple(r) for r in out.collect()], rows_of()
    assert got and set(got) <= set(given)
    texts = {(t or "").lower() for _, t, *_ in got}
    if name == "exact_dedup":
        assert sorted(texts) == sorted((t or "").lower() for _, t, *_ in got) and texts == {(t or "").lower() for _, t, *_ in given}
    if name == "near_dedup":
        assert {prose(9, 120_000), "a" * 300_000, "x", prose(3), prose(4)} <= texts and len([t for t in texts if t.startswith(prose(2))]) == 1
        assert sum(not t for _, t, *_ in got) == sum(not t for _, t, *_ in given)
    if name == "mixture":
        assert all(got.count(r) <= 2 * given.count(r) for r in got)


def test_the_last_stage_on_odd_rows(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert len(out) == len(rows_of()) and sorted(r.doc_id or 0 for r in out) == sorted(r[0] or 0 for r in rows_of())
    assert sum(r.n_tokens == 0 for r in out) == 4


@pytest.mark.parametrize("name", dict(corpus_pipeline.STAGES))
def test_stages_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_run_leaves_one_folder(spark):
    before = common.written()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert common.written() - before == 1
