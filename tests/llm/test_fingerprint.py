import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from cloakline.llm import fingerprint as fp


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_edit(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + nxt[:half], t, nxt)
    return out


def test_edited_texts_and_estimates(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(3000)]
    rows = [(i * i * 7 - 5000, " ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 700])))) for i in range(60)]
    rows += [(10**15, None), (10**15 + 1, ""), (-(10**16), "é😀x"), (77, rows[5][1]), (78, rows[5][1].upper()), (79, rows[5][1].replace("w1", "q", 1))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r for r in fp.edited_pairs(docs).collect()}
    want = brute_edit(rows)
    assert got.keys() == want.keys()
    for i, (n, edited, text, nxt) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(text, edited)) < 0.2 and abs(r.near_next - jaccard(text, nxt)) < 0.2
        assert len(r.fingerprint) == (fp.BINS * 2 if text.split() else 0)
    assert got[77].fingerprint == got[78].fingerprint == got[rows[5][0]].fingerprint
    errors = [got[i].near_edited - jaccard(w[2], w[1]) for i, w in want.items() if w[0] > 200]
    assert abs(sum(errors) / len(errors)) < 0.03  # no bias left


def test_bins_against_plain_python(spark):
    hashes = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(90)]
    row = spark.createDataFrame([(hashes,)], "h array<bigint>").select(fp.filled_bins(F.col("h")).alias("m")).first().m
    want = {}
    for h in hashes:
        u = (h % (1 << 64)) >> 1
        want[u >> 56] = min(want.get(u >> 56, u), u)
    assert row == want


def hash_of(*numbers):
    """Spark's xxhash64 of 32-bit integers."""
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", n), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_dense(filled):
    out = []
    for j in range(fp.BINS if filled else 0):
        tried = [j, *(hash_of(j, t) % fp.BINS for t in range(fp.TRIES))]
        source = next((k for k in tried if k in filled), None)
        if source is None:
            source = min(filled, key=lambda k: (hash_of(j, k), k))
        out.append(filled[source] & ((1 << fp.BITS) - 1))
    return out


def test_densification_packing_and_likeness_against_plain_python(spark):
    rng = random.Random(7)
    maps = [{rng.randrange(fp.BINS): rng.getrandbits(63) for _ in range(n)} for n in (1, 2, 5, 40, 128, 400)] + [{}]
    frame = spark.createDataFrame(list(enumerate(maps)), "k int, m map<int,bigint>")
    dense = fp.dense_bins(F.col("m"))
    got = {r.k: r for r in frame.select("k", dense.alias("bins"), fp.packed(dense).alias("print")).collect()}
    for k, m in enumerate(maps):
        assert list(got[k].bins) == brute_dense(m)
        assert got[k].print == "".join(f"{v:02x}" for v in brute_dense(m))
    prints = [got[k].print for k in range(len(maps))]
    pairs = [(a, b) for a in prints for b in prints]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for a, b, x in rows:
        share = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
        want = max(0.0, (share - 1 / 256) / (1 - 1 / 256)) if a and b else float(a == b)
        assert abs(x - want) < 1e-12


def test_next_of_wide_and_negative_ids(spark):
    ids = [-(1 << 63), -5, -1, 0, 3, 1 << 40, (1 << 63) - 1]
    got = dict(map(tuple, fp.next_lower(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()))
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fp.edited_pairs(spark.createDataFrame([], schema)).count() == 0
    rows = fp.edited_pairs(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "c" * 70_000)], schema)).collect()
    assert len(rows) == 4
    one = fp.edited_pairs(spark.createDataFrame([(1, "ab cd")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0
