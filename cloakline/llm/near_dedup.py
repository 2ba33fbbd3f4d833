"""MinHash near-dedup: universal hash minima, banding, signature verification, full-set confirmation, components.

Documents are sets of distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle). Documents with
equal sets are one class, so copies never meet each other again: only a class's document of smallest doc_id goes on.
A class is known by its node, a 64-bit hash of its digest; doc_ids, which may be null or repeated, only name results.

Signatures are minima of many multiply-add hashes. Bands of them are bucket keys; band and row counts follow from
the similarity so that a pair at the threshold is missed with a probability below MISS. In each bucket every member
is held against one centre: the smallest node in one half of the buckets, the smallest of a hash in the other, so
that a member of a large group of near copies meets many different centres and no bucket makes all its pairs.
Components of the links found so far then show which buckets still hold members of different components. Each such
bucket is looked at by itself (buckets that share members are never joined, as chains of them would reach ever
further): its members meet in blocks, first by signature, which leaves those that may be linked with a member of
another component, then, only those, by full sets. Meetings give out members or links, never pairs, so work inside a
bucket of many unlinked near copies doesn't become rows.

Two documents are linked only if their full shingle sets say so. Components come from alternating large-star and
small-star steps, each written to the shared folder, so executors may be lost at any time.

Nulls and texts without words have no shingles and are linked with nothing. Repeated doc_ids are taken as documents
of their own with equal doc_id: all rows get a row back. A null doc_id counts as the largest number. Where linked
classes share the smallest doc_id, that of the smallest digest is kept; rows equal in doc_id and set stay together.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import common

WORDS, HASHES = 5, 192
#: The probability that no band holds a pair whose similarity is the threshold.
MISS = 1e-6
#: Signature agreement below the threshold that still gets a confirmation: over five standard deviations.
SLACK = 0.16
SEED = 77
GREATEST = (1 << 63) - 1
#: Members that one block holds when members of different components meet.
BLOCK = 256


def bands_for(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows: the most rows that keep the miss probability."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            best = (hashes // rows, rows)
    return best


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of all hash functions, high 32 bits."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    x = found & np.uint64(0xFFFFFFFF)
    for k in range(0, len(x), 256):
        best = np.minimum(best, (x[k : k + 256, None] * a + b).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def digest(found: np.ndarray) -> str:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the low bytes of two signatures."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def linked(common_size: int, a: int, b: int, percent: int) -> bool:
    return 100 * common_size >= percent * (a + b - common_size)


SIGNED = "doc_id long, n_shingles long, class string, sig binary, bands array<long>"


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set), signature bytes, band keys of each row."""
    common.bounded_batches(docs.sparkSession)
    a, b = multipliers()

    def run(batches):
        for batch in batches:
            n, classes, sigs, keys = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                n.append(len(found))
                if len(found):
                    sig = signature(found, a, b)
                    classes.append(digest(found))
                    sigs.append(sig.astype(np.uint8).tobytes())
                    keys.append(mixed_bands(sig, bands, rows))
                else:
                    classes.append(None), sigs.append(None), keys.append(None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.string()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "sig", "bands"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(GREATEST)).alias("doc_id"), "text").mapInArrow(common.tidy(run), SIGNED)


def mixed_bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + sig[i : bands * rows : rows].astype(np.uint64))
    return out.view(np.int64)


def live_members(reps: DataFrame) -> DataFrame:
    """key, node, centre of each member of a bucket with several members.

    Buckets of one, nearly all, end here. The same plan is asked for at every size, so growth can be foreseen.
    """
    members = reps.select("node", F.posexplode("bands").alias("band", "key"))
    # Whether the centre is the smallest node or the smallest hash follows from the key itself.
    least, hashed = F.min("node"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"]
    centres = members.groupBy("key").agg(least.alias("least"), hashed.alias("hashed"), F.count("*").alias("size")).filter("size > 1")
    centres = common.staged(centres.select(F.col("key").alias("_key"), F.when(F.col("key") % 2 == 0, F.col("least")).otherwise(F.col("hashed")).alias("centre")), "centres")
    return common.staged(members.join(centres.hint("merge"), F.col("key") == F.col("_key")).select("key", "node", "centre"), "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """a < b for each member of a bucket and its centre."""
    pairs = members.filter("node != centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, then the full sets of those that may be.

    signatures: node, n_shingles, sig. sets: node, shingles.
    """
    least = percent / 100 - SLACK
    of = lambda df, at, **names: df.select(F.col("node").alias(at), *[F.col(c).alias(n) for c, n in names.items()])
    both = pairs.join(of(signatures, "a", n_shingles="na", sig="sa").hint("merge"), "a").join(of(signatures, "b", n_shingles="nb", sig="sb").hint("merge"), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(agreement(sa, sb) >= least))

    maybe = common.staged(both.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long"), "maybe")
    full = maybe.join(of(sets, "b", shingles="tb").hint("merge"), "b").join(of(sets, "a", shingles="ta").hint("merge"), "a")

    def whole(batches):
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (ta, tb))
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.staged(full.select("a", "b", "ta", "tb").mapInArrow(whole, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest reachable node) of every linked node: alternating large-star and small-star.

    A star step hands each neighbour to the smallest id around a node; neighbour lists are never collected, only
    their minimum is, and the rest is a join.
    """
    edges = common.staged(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo != hi").distinct(), "edges")
    before = None
    while True:
        # Large-star: a node's larger neighbours go to the smallest id among it and all its neighbours.
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo != hi").distinct()
        large = common.staged(large, "large_star")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        least = common.staged(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "_hi"), "least")
        moved = large.join(least, F.col("hi") == F.col("_hi"))
        small = moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(moved.select(F.col("m").alias("lo"), "hi")).filter("lo != hi").distinct()
        edges = common.staged(small, "small_star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    # Stable edges are stars around the smallest id.
    return edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")


def shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of them empty."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((x[at] == every).astype(np.int64), starts)


def may_link(x: int, others: np.ndarray, parts: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Those of others in another part than x whose sizes and signatures don't rule a link out."""
    others = others[(parts[others] != parts[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
    return others[agreement(sig[others], sig[x]) >= percent / 100 - SLACK] if len(others) else others


def meeting(ids: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different parts, each confirmed on full sets; none for what is joined already."""
    parts, out, n = parts.copy(), [], np.array([len(x) for x in sets])
    for x in left:
        others = may_link(x, right, parts, n, sig, percent)
        if not len(others):
            continue
        common_sizes = shared(sets[x], [sets[y] for y in others])
        for y in others[100 * common_sizes >= percent * (n[others] + n[x] - common_sizes)]:
            if parts[y] != parts[x]:
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                parts[parts == parts[y]] = parts[x]
    return out


def meetings(rows: DataFrame) -> DataFrame:
    """Rows of buckets (key, node, ...) as often as they meet: key, i, j (numbers of two blocks), block, and the rest.

    A bucket's members are dealt to blocks of about BLOCK by a hash, and every two blocks meet once, in a group of
    their own.
    """
    sizes = rows.groupBy("key").agg(F.floor((F.count("*") - 1) / BLOCK).cast("int").alias("last")).withColumnRenamed("key", "_key")
    rows = rows.join(sizes, F.col("key") == F.col("_key")).drop("_key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("last") + 1).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "last")
    # Else rows that a join has dealt by key would stay so, and a bucket's meetings would all be one task's.
    return rows.repartition("key", "i", "j")


def across(members: DataFrame, of: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that lie in different components."""
    placed = members.join(of.select(F.col("node").alias("_d"), "component"), F.col("node") == F.col("_d"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = common.staged(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select(F.col("key").alias("_key"))
    rows = common.staged(placed.join(open_, F.col("key") == F.col("_key")).select("key", "node", "component"), "open")

    def arrays(group):
        where, sig = np.array(group.column("block")), np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        return np.array(group.column("node")), np.array(group.column("component")), where, sig

    def by_signature(key, group):
        ids, parts, where, sig = arrays(group)
        n, found = np.array(group.column("n_shingles")), np.zeros(len(ids), bool)
        right = np.flatnonzero(where == key[2].as_py())
        for x in np.flatnonzero(where == key[1].as_py()):
            near = may_link(x, right, parts, n, sig, percent)
            found[near] = True
            found[x] |= len(near) > 0
        return pa.table({"key": pa.array(np.full(int(found.sum()), key[0].as_py()), pa.int64()), "node": pa.array(ids[found], pa.int64()), "component": pa.array(parts[found], pa.int64())})

    signed_rows = rows.join(signatures.select(F.col("node").alias("_r"), "n_shingles", "sig").hint("merge"), F.col("node") == F.col("_r"))
    near = meetings(signed_rows.select("key", "node", "component", "n_shingles", "sig")).groupBy("key", "i", "j").applyInArrow(by_signature, "key long, node long, component long")
    near = common.staged(near.distinct(), "near")
    # Several bands often hold the very same members: one of those buckets is enough.
    alike = near.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n"))
    once = alike.groupBy("sum", "n").agg(F.min("key").alias("_key")).select("_key")
    near = common.staged(near.join(once, F.col("key") == F.col("_key")).select("key", "node", "component"), "near_once")
    whole = near.join(signatures.select(F.col("node").alias("_r"), "sig").hint("merge"), F.col("node") == F.col("_r"))
    whole = whole.join(sets.withColumnRenamed("node", "_s").hint("merge"), F.col("node") == F.col("_s")).select("key", "node", "component", "sig", "shingles")

    def by_sets(key, group):
        ids, parts, where, sig = arrays(group)
        found = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        links = meeting(ids, parts, np.flatnonzero(where == key[1].as_py()), np.flatnonzero(where == key[2].as_py()), sig, found, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return common.staged(meetings(whole).groupBy("key", "i", "j").applyInArrow(by_sets, "a long, b long"), "cross_links")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles (sorted 64-bit hashes) of the wanted representatives (doc_id, class).

    Texts aren't shuffled: a bitmap of the wanted ids lets tasks pass over nearly all others, and what its chance hits
    let through goes in the join. With very many ids the bitmap lets more through and the join does more.
    """
    spark = common.bounded_batches(docs.sparkSession)
    bits = spark.sparkContext.broadcast(common.bitmap(wanted.select("doc_id")))

    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(common.marked(bits.value, batch.column(2).to_numpy()))
            for k in range(0, len(hit), 64):
                some = batch.take(pa.array(hit[k : k + 64]))
                data = [shingles(t.as_py()).tobytes() for t in some.column(1)]
                digests = [hashlib.blake2b(x, digest_size=16).hexdigest() for x in data]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digests, pa.string()), pa.array(data, pa.binary())], names=["doc_id", "class", "shingles"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(GREATEST)).alias("doc_id"), "text").withColumn("h", common.bit_of("doc_id"))
    found = texts.mapInArrow(common.tidy(run), "doc_id long, class string, shingles binary")
    # A repeated doc_id may have several texts, and a text several rows: one of each set is enough.
    mine = found.join(wanted.select("doc_id", "class").hint("merge"), ["doc_id", "class"], "left_semi").dropDuplicates(["class"])
    return common.staged(mine.select(F.xxhash64("class").alias("node"), "shingles"), "sets")


def classed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id (GREATEST for null), n_shingles, class, component_id (likewise), kept of every row."""
    bands, per_band = bands_for(percent / 100)
    rows = common.staged(signed(docs, bands, per_band), "signed")
    classes = common.staged(rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    reps = rows.filter("n_shingles > 0").join(classes.withColumnRenamed("class", "_class"), (F.col("doc_id") == F.col("rep")) & (F.col("class") == F.col("_class"))).dropDuplicates(["class"])
    reps = common.staged(reps.select(F.xxhash64("class").alias("node"), "doc_id", "n_shingles", "class", "sig", "bands"), "representatives")
    members = live_members(reps)
    # From here on only documents that share a bucket with another are looked at.
    live = members.select(F.col("node").alias("_live")).distinct()
    signatures = common.staged(reps.join(live.hint("merge"), F.col("node") == F.col("_live")).select("node", "doc_id", "n_shingles", "class", "sig"), "live")
    sets = whole_sets(docs, signatures)
    ids = signatures.select("node", "doc_id", "class")
    signatures = signatures.drop("doc_id", "class")
    links = confirmed(star_pairs(members), signatures, sets, percent)
    links = links.unionByName(across(members, components(links), signatures, sets, percent))
    # Links hold all nodes but each component's smallest by their component; that one stands for itself.
    of = components(links)
    of = common.staged(of.unionByName(of.select(F.col("component").alias("node"), "component").distinct()), "components")
    linked = common.staged(of.join(ids.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("component", "doc_id", "class"), "linked")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("first")).withColumnRenamed("component", "_c")
    placed = linked.join(first, F.col("component") == F.col("_c"))
    placed = common.staged(placed.select(F.col("class").alias("_class"), F.col("first.doc_id").alias("component"), F.col("first.class").alias("stays")), "placed")
    reps = classes.withColumnRenamed("class", "_own").join(placed, F.col("_own") == F.col("_class"), "left").select("_own", F.coalesce("component", "rep").alias("component"), F.coalesce("stays", "_own").alias("stays"))
    out = rows.select("doc_id", "n_shingles", "class").join(common.staged(reps, "places"), F.col("class") == F.col("_own"), "left")
    component = F.coalesce("component", "doc_id")
    kept = (F.col("doc_id") == component) & F.coalesce(F.col("class") == F.col("stays"), F.lit(True))
    return out.select("doc_id", "n_shingles", "class", component.alias("component_id"), kept.alias("kept"))


def groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. percent: the least similarity of a link."""
    null_id = lambda c: F.when(F.col(c) != GREATEST, F.col(c)).alias(c)
    return classed(docs, percent).select(null_id("doc_id"), "n_shingles", null_id("component_id"), "kept")


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows whose document stays, with all their columns: one document of each group."""
    found = common.staged(classed(docs, percent).select("doc_id", "class", "kept"), "found")
    ids = common.staged(found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).filter("some"), "kept_ids")
    own = common.prefix(docs)
    number = F.coalesce(docs["doc_id"].cast("long"), F.lit(GREATEST))
    whole = docs.join(ids.filter("every").select(F.col("doc_id").alias(own + "id")), number == F.col(own + "id"), "left_semi")
    partly = ids.filter("not every").select(F.col("doc_id").alias(own + "id"))
    if partly.isEmpty():
        return whole
    # Of an id with rows that stay and rows that go, those stay whose set does.
    class_of = F.udf(lambda text: digest(x) if len(x := shingles(text)) else None, "string")
    stay = found.filter("kept").join(partly, F.col("doc_id") == F.col(own + "id"), "left_semi").select(F.col("doc_id").alias(own + "id"), F.col("class").alias(own + "class")).distinct()
    some = docs.join(partly, number == F.col(own + "id"), "left_semi").withColumn(own + "own", class_of("text"))
    some = some.join(stay, (F.coalesce(some["doc_id"].cast("long"), F.lit(GREATEST)) == F.col(own + "id")) & F.col(own + "own").eqNullSafe(F.col(own + "class")), "left_semi")
    return whole.unionByName(some.drop(own + "own"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), percent=85)
