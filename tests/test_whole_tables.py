"""Queries over made-up rows take all rows of their tables, at sizes above the smallest too."""

import math

import pytest
from pyspark.sql import functions as F

import oracle
from cloakline.plans import catalogue, planted

SF = "/root/testdata/sf0.01"


def test_audit_set_is_all_orders(spark):
    assert planted.load(spark, SF, "audit").count() == spark.read.parquet(f"{SF}/orders.parquet").count()


@pytest.mark.parametrize("name", ["chain_build", "chain_tamper", "receipt_verify"])
def test_audit_queries_on_all_orders(spark, name):
    con = oracle.connect(SF)
    assert oracle.compare(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) is None


def test_log2_bucket_of_any_event_id(spark, tmp_path):
    """Products beyond 64 and 128 bits, and ids beside those where a bucket begins."""
    ids = [0, 1, -1, 2, 3037000, 3037001, 5_999_999, 10**12, 10**16, -(10**18), 2**63 - 1, -(2**63), None]
    for k in range(2, 62):
        edge = math.isqrt(((1 << (2 * k + 19)) + 5) // 1000003)
        ids += [e for e in range(edge - 1, edge + 3)] + [2**k]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.queries()["log2_bucket"](spark, str(tmp_path)).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert r.bucket == max((r.event_id or 0) ** 2 * 1000003 - 5, 1).bit_length() - 1, r


def test_log2_bucket_of_sixty_copies(spark, tmp_path):
    """Ids shifted 60 times over, as in the driver's large tables; the SQL's arithmetic is done in 128 bits here."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id").filter("event_id % 50 = 0")
    events.crossJoin(spark.range(60)).select((F.col("event_id") + F.col("id") * 100_000).alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.queries()["log2_bucket"](spark, str(tmp_path)).collect()
    assert len(rows) == 120_000 and all(r.bucket == max(r.event_id**2 * 1000003 - 5, 1).bit_length() - 1 for r in rows)
