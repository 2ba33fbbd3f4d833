"""Exact dedup by composable polynomial fingerprints, confirmed by comparing texts chunk by chunk.

A text's bytes, with A-Z lower-cased, are the coefficients of a polynomial evaluated at fixed points modulo the
Mersenne prime 2**31 - 1. Fingerprints compose: H(a + b) = H(a) * r**len(b) + H(b). So the chunks of a huge text
are hashed in parallel, in rows of their own, and joined by length shifts; other texts are hashed where they lie.

Rows with equal fingerprints are only candidates. Each is compared, a chunk at a time, with the row of the largest
doc_id in its group. Rows that differ form groups anew in a further round, until none are left, so a collision
costs a round and never a wrong result. Large groups are salted: the kept row's chunks go to as many places as the
group needs, so no task meets a whole group.

Null texts count as empty, so all empty texts are one group. Of rows with equal text and equal doc_id one stays.
A null doc_id counts as smaller than any other. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import common

P = (1 << 31) - 1
#: The points at which polynomials are evaluated.
POINTS = (1_103_515_245, 1_735_930_001, 742_938_285)
CHUNK = 1 << 16
#: Code points from which a text is hashed in chunk rows of its own.
HUGE = 1 << 15
#: Rows of a group that one salt takes.
SALT_ROWS = 400
HASH_SCHEMA = "doc_id long, n_bytes long, fingerprint string, text_sha256 string"
LOWEST = -(1 << 63)

_powers: dict[int, np.ndarray] = {}


def powers(point: int) -> np.ndarray:
    """point**(CHUNK - 1), ..., point**0 modulo P."""
    if point not in _powers:
        out = np.ones(1, np.uint64)
        while len(out) < CHUNK:
            out = np.concatenate([out, out * np.uint64(pow(point, len(out), P)) % np.uint64(P)])
        _powers[point] = out[::-1].copy()
    return _powers[point]


def chunk_hash(data: bytes, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """Hashes of at most CHUNK bytes. A byte counts as itself plus one, so leading zeros count."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((values * powers(r)[CHUNK - len(values) :]).sum() % np.uint64(P)) for r in points)


def combine(a: tuple[int, ...], b: tuple[int, ...], b_length: int, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """The hashes of two texts joined."""
    return tuple((x * pow(r, b_length, P) + y) % P for x, y, r in zip(a, b, points, strict=True))


def text_hash(data: bytes, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    out = (0,) * len(points)
    for k in range(0, len(data), CHUNK):
        part = data[k : k + CHUNK]
        out = combine(out, chunk_hash(part, points), len(part), points) if k else chunk_hash(part, points)
    return out


def render(n_bytes: int, hashes: tuple[int, ...]) -> str:
    return f"{n_bytes:x}-" + "".join(f"{h:08x}" for h in hashes)


def fingerprints(docs: DataFrame, points: tuple[int, ...] = POINTS, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, fingerprint, text_sha256 of each row."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                data = text.as_py().encode().lower()
                out.append((len(data), render(len(data), text_hash(data, points)), hashlib.sha256(data).hexdigest()))
            n, prints, digests = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.string()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "fingerprint", "text_sha256"])

    def parts(batches):
        for batch in batches:
            out = []
            for text in batch.column(3):
                data = text.as_py().encode().lower()
                out.append((len(data), list(text_hash(data, points))))
            n, hashes = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_sha256", "k", "n", "h"])

    small = rows.filter(F.length("text") <= huge).mapInArrow(common.tidy(whole), HASH_SCHEMA)
    # A repeated huge row would fold its chunks twice; its digest is the same, so it is counted and put back.
    large = rows.filter(F.length("text") > huge).withColumn("text_sha256", F.sha2(common.ascii_lower(F.col("text")), 256))
    times = large.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    chunks = large.dropDuplicates(["doc_id", "text_sha256"]).select("doc_id", "text_sha256", F.explode(F.expr(f"sequence(0L, (length(text) - 1) div {huge})")).alias("k"), "text")
    chunks = chunks.select("doc_id", "text_sha256", "k", F.expr(f"substring(text, cast(k * {huge} + 1 as int), {huge})").alias("part"))
    hashed = chunks.repartition("doc_id", "k").mapInArrow(common.tidy(parts), "doc_id long, text_sha256 string, k long, n long, h array<long>")
    folded = hashed.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("k", "n", "h"))).alias("parts"), F.sum("n").alias("n_bytes"))

    def join_parts(batches):
        for batch in batches:
            out = []
            for found, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                total = tuple(found[0]["h"])
                for part in found[1:]:
                    total = combine(total, tuple(part["h"]), part["n"], points)
                out.append(render(n, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.string()), batch.column(1)], names=["doc_id", "n_bytes", "fingerprint", "text_sha256"])

    joined = folded.mapInArrow(join_parts, HASH_SCHEMA).join(times, ["doc_id", "text_sha256"]).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    return small.unionByName(joined.select(*small.columns))


def unequal(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (doc_id, text_sha256, fingerprint, keep_id, keep_sha, salts) whose text differs from the kept row's."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), common.ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    cut = F.explode(F.expr(f"transform(sequence(0L, greatest(length(text) - 1, 0) div {CHUNK}), k -> struct(k, substring(text, cast(k * {CHUNK} + 1 as int), {CHUNK}) as part))"))
    keepers = candidates.select("fingerprint", F.col("keep_id").alias("doc_id"), F.col("keep_sha").alias("text_sha256"), "salts").distinct()
    kept = texts.join(keepers, "doc_id").filter(F.sha2("text", 256) == F.col("text_sha256")).dropDuplicates(["fingerprint"])
    kept = kept.select("fingerprint", F.length("text").alias("kept_length"), cut.alias("c"), "salts").select("fingerprint", "kept_length", F.col("c.k").alias("k"), F.col("c.part").alias("kept_part"), F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    members = candidates.select("doc_id", "text_sha256", "fingerprint", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("salts")).alias("salt"))
    rows = texts.join(members, "doc_id").filter(F.sha2("text", 256) == F.col("text_sha256"))
    rows = rows.select("doc_id", "text_sha256", "fingerprint", "salt", F.length("text").alias("length"), cut.alias("c")).select("doc_id", "text_sha256", "fingerprint", "salt", "length", F.col("c.k").alias("k"), F.col("c.part").alias("part"))
    pairs = rows.join(kept, ["fingerprint", "salt", "k"], "left")
    differs = F.col("kept_part").isNull() | (F.col("length") != F.col("kept_length")) | (F.col("part") != F.col("kept_part"))
    return pairs.filter(differs).select("doc_id", "text_sha256", "fingerprint").distinct()


def groups(docs: DataFrame, points: tuple[int, ...] = POINTS, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = common.staged(fingerprints(docs, points, huge), "fingerprints")
    done = None
    while True:
        found = hashed.groupBy("fingerprint").agg(F.max(F.struct("doc_id", "text_sha256")).alias("keep"), F.count("*").alias("rows"))
        many = common.staged(
            found.filter("rows > 1").select("fingerprint", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_sha256").alias("keep_sha"), F.expr(f"(rows - 1) div {SALT_ROWS} + 1").alias("salts")),
            "groups",
        )
        # Distinct (doc_id, digest) rows; the kept row itself needs no comparison.
        members = hashed.join(many, "fingerprint").filter("doc_id != keep_id or text_sha256 != keep_sha").select("doc_id", "text_sha256", "fingerprint", "keep_id", "keep_sha", "salts").dropDuplicates(["doc_id", "text_sha256"])
        members = common.staged(members, "candidates")
        wrong = common.staged(unequal(docs, members), "unequal")
        again = not wrong.isEmpty()
        right = hashed.join(wrong.select("doc_id", "text_sha256"), ["doc_id", "text_sha256"], "left_anti") if again else hashed
        sized = common.staged(right.groupBy("fingerprint").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "sizes")
        part = right.join(sized, "fingerprint", "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
        done = part if done is None else done.unionByName(part)
        if not again:
            break
        hashed = common.staged(hashed.join(wrong.select("doc_id", "text_sha256"), ["doc_id", "text_sha256"], "left_semi"), "fingerprints")
    null_id = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return done.select(null_id("doc_id").alias("doc_id"), null_id("keep_id").alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of rows equal in text and doc_id one stays."""
    own = common.prefix(docs)
    kept = groups(docs).filter("kept").select(F.col("doc_id").alias(own + "id"), F.col("text_sha256").alias(own + "sha")).distinct()
    digest = F.sha2(common.ascii_lower(F.coalesce("text", F.lit(""))), 256)
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(own + "id")) & (digest == F.col(own + "sha")), "left_semi")
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return rows if unique else rows.withColumn(own + "digest", digest).dropDuplicates(["doc_id", own + "digest"]).drop(own + "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
