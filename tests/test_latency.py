"""The upper median against sorting."""

import random

import pytest

from cloakline.operators import evaluate


@pytest.mark.parametrize("cells", [2, evaluate.CELLS])
def test_median(spark, monkeypatch, cells):
    monkeypatch.setattr(evaluate, "CELLS", cells)
    rng = random.Random(1)
    groups = {"a": [rng.choice([0.5, 1.0, 7.25]) for _ in range(50)], "b": [3.0] * 7, None: [rng.random() ** 9 for _ in range(101)], "c": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [("a", None)], "g string, latency double")
    got = {r.g: r for r in evaluate.latency_summary(rows, by=("g",)).collect()}
    for g, x in groups.items():
        assert (got[g].n, got[g].least, got[g].most, got[g].median) == (len(x), min(x), max(x), sorted(x)[len(x) // 2])
    every = sorted(v for x in groups.values() for v in x)
    whole = evaluate.latency_summary(rows).collect()
    assert len(whole) == 1 and whole[0].median == every[len(every) // 2] and "_all" not in whole[0].asDict()
