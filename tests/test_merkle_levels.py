"""The height of a Merkle tree follows from its leaves."""

from pyspark.sql import functions as F

from cloakline.operators import audit


def test_levels_follow_from_the_leaves(spark):
    want = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 1 << 24: 24, (1 << 24) + 1: 25, (1 << 31) - 1: 31}
    rows = spark.createDataFrame([(n,) for n in want], "n int").select("n", audit.merkle_levels(F.col("n")).alias("levels"))
    assert dict(map(tuple, rows.collect())) == want


def test_empty_batch_has_no_root(spark):
    rows = spark.createDataFrame([([],), (None,)], "h array<string>").select(audit.merkle_root(F.col("h")).alias("root"))
    assert [r.root for r in rows.collect()] == [None, None]


def test_subtrees_give_the_same_root(spark, monkeypatch):
    monkeypatch.setattr(audit, "SUBTREE", 4)
    heads = {b: [f"{b * 1000 + i:064x}" for i in range(n)] for b, n in enumerate((1, 3, 4, 5, 16, 17, 63))}
    rows = spark.createDataFrame([(b, i, h) for b, x in heads.items() for i, h in enumerate(x)], "batch int, pos int, head string").repartition(5)
    got = {r.batch: r for r in audit.merkle_roots(rows, "batch", "pos").collect()}
    for b, x in heads.items():
        assert (got[b].n_heads, got[b].first_head, got[b].last_head, got[b].merkle_root) == (len(x), x[0], x[-1], audit.merkle_root_of(x))
