import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakline.llm import mixture


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            return target
        full |= over


def rows_of(seed, n=900):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "𝒳", "￮"]
    out = []
    for i in range(n):
        s = "a" if rng.random() < 0.35 else rng.choice(names[1:])
        if s == "tiny" and i > 60:
            s = "b"
        out.append((i, s, None if rng.random() < 0.02 else " \t".join(["w"] * int(rng.paretovariate(1.2) * 3 % 400))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")
    got = mixture.plan(docs).collect()
    assert len(got) == len(rows)
    size, largest = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        n = len((t or "").split())
        size[s] += n
        largest[s] = max(largest[s], n)
    target = brute_targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s], s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.plan(docs).collect()), key=str)


def test_order_is_pareto(spark):
    """Within a source the extra copies are those with the smallest odds ratio, and heavier rows are likelier."""
    docs = spark.createDataFrame([(i, "s", "w " * 10, 3.0 if i % 2 else 1.0) for i in range(4000)] + [(i, "t", "w " * 10, 1.0) for i in range(4000, 8000)], "doc_id long, source string, text string, w double")
    got = mixture.plan(docs, weights=(1, 7), share=1.0, weight="w").filter("source = 's'").collect()
    heavy, light = sum(r.copies for r in got if r.doc_id % 2), sum(r.copies for r in got if not r.doc_id % 2)
    assert 2.4 < heavy / light < 3.7
    assert abs(sum(r.copies * r.size for r in got) - got[0].target) <= 10


def test_mix_repeats_rows(spark):
    rows = rows_of(3, 200)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, copies string")
    plan = {r.doc_id: r.copies for r in mixture.plan(docs).collect()}
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r.doc_id] += 1
    assert counts == {k: v for k, v in plan.items() if v}


def test_odd_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixture.plan(spark.createDataFrame([], schema)).count() == 0
    assert [r.copies for r in mixture.plan(spark.createDataFrame([(1, None, None), (2, None, "")], schema)).collect()] == [0, 0]
    ties = mixture.plan(spark.createDataFrame([(None, "s", "a b")] * 4, schema)).collect()
    assert sorted(r.copies for r in ties) == [1, 1, 2, 2] and ties[0].target == 12


def brute_plan(rows, seed=mixture.SEED):
    """Which documents a source takes: rates by bisection, ranks in order, the cut by adding up."""
    out = {}
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    target = brute_targets({s: sum(r["size"] for r in x) for s, x in sources.items()})
    for s, x in sources.items():
        weight = [1 + len(f"{r['size']:b}") / 8 for r in x]
        low, high = 0.0, 1e6
        for _ in range(200):
            rate = (low + high) / 2
            low, high = (rate, high) if sum(r["size"] * min(2, rate * w) for r, w in zip(x, weight, strict=True)) < target[s] else (low, rate)
        expected = [min(2.0, high * w) if target[s] else 0.0 for w in weight]
        certain = [math.floor(e + 1e-9) for e in expected]
        ranked = []
        for r, e, c in zip(x, expected, certain, strict=True):
            out[r["doc_id"]] = c
            if e - c > 1e-9:
                odds = r["u"] / (1 - r["u"]) / ((e - c) / (1 - e + c))
                ranked.append((odds, r))
        wanted, taken = target[s] - sum(r["size"] * c for r, c in zip(x, certain, strict=True)), 0
        for _, r in sorted(ranked, key=lambda y: y[0]):
            if taken >= wanted or abs(taken + r["size"] - wanted) > abs(taken - wanted):
                break
            taken += r["size"]
            out[r["doc_id"]] += 1
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_plan_against_brute_force(spark, seed):
    docs = spark.createDataFrame(rows_of(seed, 500), "doc_id long, source string, text string")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), "source", F.lit(0).cast("long"), F.lit(mixture.SEED)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = [{"doc_id": r.doc_id, "source": r.source, "size": len((r.text or "").split()), "u": r.u} for r in docs.withColumn("u", u).collect()]
    got = {r.doc_id: r.copies for r in mixture.plan(docs).collect()}
    want = brute_plan(rows)
    sized = {r["doc_id"] for r in rows if r["size"]}
    assert {k: got[k] for k in sized} == {k: want[k] for k in sized}


def test_null_ids_meet_the_target_in_any_layout(spark):
    rows = [(None, "s", "w " * (1 + i % 9)) for i in range(300)] + [(7, "s", "same text")] * 50 + [(i, "t", "w " * 40) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plans = []
    for layout in (docs, docs.repartition(7), docs.coalesce(1)):
        got = mixture.plan(layout).collect()
        taken = defaultdict(int)
        for r in got:
            assert 0 <= r.copies <= 2
            taken[r.source] += r.copies * r.size
        for r in got:
            assert abs(taken[r.source] - r.target) <= 40
        plans.append(sorted(map(str, got)))
        mixed = defaultdict(int)
        for r in mixture.mix(layout).collect():
            mixed[r.source] += len(r.text.split())
        assert mixed == taken
    assert plans[0] == plans[1] == plans[2]


def test_a_source_of_one_saturated_class(spark):
    """All documents are taken as often as may be where the target is the limit."""
    docs = spark.createDataFrame([(i, "s", "w " * (i % 50 + 1)) for i in range(100)] + [(1000, "t", "w " * 100_000)], "doc_id long, source string, text string")
    got = [r for r in mixture.plan(docs).collect() if r.source == "s"]
    assert all(r.copies == 2 for r in got)
