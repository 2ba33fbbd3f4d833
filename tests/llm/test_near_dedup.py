import random

import pytest

from cloakline.llm import near_dedup as nd


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    rows, base = [], [[word() for _ in range(n)] for n in (40, 90, 200, 400)]
    for b in base:  # chains of edits: neighbours are linked, ends are not
        text = list(b)
        for _ in range(25):
            rows.append(" ".join(text))
            for _ in range(rng.choice([1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.choice([5, 15, 60]))) for _ in range(60)]
    rows += [rows[3]] * 5 + [rows[3].upper(), None, "", " \n", "a b", "A  b", "a b c", "x " * 300, "x x x x x", "é" * 9000]
    rng.shuffle(rows)
    return [(i * 3 - 20, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [85, 80])
def test_groups_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = corpus(percent)
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, class string")
    got = sorted(tuple(r) for r in nd.groups(docs, percent).collect())
    assert got == brute(rows, percent)


def test_bands():
    for t in (0.85, 0.8):
        bands, rows = nd.bands_for(t)
        assert bands * rows <= nd.HASHES and (1 - t**rows) ** bands <= nd.MISS


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    assert dict(map(tuple, nd.components(links).collect())) == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_ties_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert nd.groups(spark.createDataFrame([], schema)).count() == 0
    rows = nd.groups(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text"), (None, "a b c d e f")], schema)).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {1}
    kept = nd.deduplicate(spark.createDataFrame([(5, "q w e r t y"), (4, "Q w e r t y"), (6, None)], schema)).collect()
    assert sorted(r.doc_id for r in kept) == [4, 6]


def test_thousands_of_near_copies_that_are_not_linked(spark):
    """One text with two or three changed words in each copy: buckets hold very many members, links are few."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(1600):
        text = list(base)
        for _ in range(rng.choice([2, 3])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nd.groups(docs, 85).collect())
    assert got == brute(rows, 85)
    assert sum(r[3] for r in got) > 100
