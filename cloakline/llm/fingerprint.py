"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Each distinct shingle of five words (A-Z lower-cased) is hashed once. The hash's top bits choose one of the bins,
which keeps its smallest hash. An empty bin borrows from a filled one that its own universal hash sequence finds
first (optimal densification: two sets that both lack a bin borrow from the same place if they can). The low-order
bits of each bin are packed into one hex string. Likeness is the share of equal bins, corrected for bins that are
equal by chance: (share - 2**-b) / (1 - 2**-b), at least 0.

A text of one to four words is one shingle. A text without words has an empty fingerprint, which is like another
empty one (1.0) and unlike any other (0.0). Null texts count as empty. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm import common

BINS, BITS, WORDS = 128, 8, 5
#: Tries of an empty bin's hash sequence before the exact search over all filled bins.
TRIES = 6
#: Ids of one cell in the search for the next document, as a power of two.
CELL_BITS = 9


def words_of(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(text), f"[{common.WORD_SPACE}]+"), lambda w: w != "")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A 64-bit hash of each run of five words, repeated runs included."""

    def runs(hashes: Column) -> Column:
        n = F.size(hashes)
        each = F.transform(F.slice(hashes, F.lit(1), n - (words - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, words)]))
        return F.when(n >= words, each).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return common.let(F.transform(words_of(text), lambda w: F.xxhash64(w)), runs)


def filled_bins(hashes: Column, bins: int = BINS) -> Column:
    """Map from bin to its smallest hash. Sorted as unsigned numbers, a bin's hashes lie together, smallest first."""
    shift = 63 - int(math.log2(bins))

    def firsts(ordered: Column) -> Column:
        lead = F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(ordered, i - 1), shift)))
        return F.map_from_entries(F.transform(lead, lambda h: F.struct(F.shiftright(h, shift).cast("int"), h)))

    return common.let(F.sort_array(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))), firsts)


def dense_bins(filled: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Low-order bits of every bin; an empty array if no bin is filled."""

    def borrow(m: Column, j: Column) -> Column:
        tries = [m[F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int")] for t in range(TRIES)]
        # After the tries the sequence goes on as a random order of all bins: the first filled one has the least hash.
        rest = F.array_min(F.transform(F.map_keys(m), lambda k: F.struct(F.xxhash64(j, k).alias("h"), k.alias("k"))))["k"]
        return F.coalesce(m[j], *tries, m[rest])

    every = F.sequence(F.lit(0), F.lit(bins - 1))
    return common.let(filled, lambda m: F.when(F.size(m) > 0, F.transform(every, lambda j: borrow(m, j).bitwiseAND((1 << bits) - 1).cast("short"))).otherwise(F.expr("cast(array() as array<smallint>)")))


def packed(values: Column, bits: int = BITS) -> Column:
    """Hex string of the bins' low-order bits, in bin order."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), -(-bits // 4), "0")), ""))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    return packed(dense_bins(filled_bins(shingle_hashes(F.coalesce(text, F.lit("")))), bins, bits), bits)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints."""
    width = -(-bits // 4)
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width)), 1).otherwise(0))
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(estimate)


def next_lower(ids: DataFrame) -> DataFrame:
    """doc_id and next_id, the next smaller distinct id (after the smallest: the largest).

    Ids meet in cells of a few hundred consecutive numbers. Cells in turn meet in cells of cells, so no task orders
    more than one cell, however many documents there are; the number of levels follows the range of ids.
    """
    lowest, highest = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lowest is None:
        return ids.select("doc_id", F.col("doc_id").alias("next_id"))
    level = ids.select("doc_id").distinct().select(F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))
    shift, out = 0, None
    while True:
        shift += CELL_BITS
        # The mask keeps shifts of negative ids in order; ids below zero have cells of their own.
        cell = F.shiftright("low", min(shift, 63))
        by = Window.partitionBy("cell").orderBy(F.desc("low"))
        level = level.withColumn("cell", cell).withColumn("next_id", F.lead("high").over(by)).withColumn("n", F.row_number().over(by))
        found = level.filter("next_id is not null").select(F.col("low").alias("doc_id"), "next_id")
        out = found if out is None else out.unionByName(found)
        level = level.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("low", "high")
        if lowest >> min(shift, 63) == highest >> min(shift, 63) or shift > 63:
            break
    ends = ids.sparkSession.createDataFrame([(lowest, highest)], "doc_id long, next_id long")
    if (lowest < 0) != (highest < 0) and shift > 63:
        border = ids.agg(F.min(F.when(F.col("doc_id") >= 0, F.col("doc_id"))), F.max(F.when(F.col("doc_id") < 0, F.col("doc_id")))).first()
        ends = ends.unionByName(ids.sparkSession.createDataFrame([tuple(border)], "doc_id long, next_id long"))
    return out.unionByName(ends)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    Texts are shuffled once, by id, and half texts once more, to their predecessors; fingerprints are made where text
    and head meet, and only they go on. Repeated doc_ids each get a row; the next document of all of them is the row of
    the next smaller id whose text has the smallest digest. A null doc_id counts as the smallest number.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    links = common.staged(next_lower(rows.select("doc_id")), "links")
    # Each next document's head is only as long as the longest text that takes it.
    need = rows.groupBy("doc_id").agg(F.max(F.expr("length(text) div 2")).alias("need"), F.count("*").alias("rows"))
    need = common.staged(need, "need")
    repeated = not need.filter("rows > 1").isEmpty()
    wanted = links.join(need.select("doc_id", "need"), "doc_id").select(F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), "need")
    heads = wanted.join(rows, "doc_id").select("of", F.expr("left(text, cast(need as int))").alias("head"), *([F.sha2("text", 256).alias("digest")] if repeated else []))
    if repeated:
        heads = heads.groupBy("of").agg(F.min_by("head", "digest").alias("head"))
    n = F.length("text")
    edited = rows.join(heads, F.col("doc_id") == F.col("of")).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(head, length(text) div 2)")).alias("edited"),
    )
    slim = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        *([F.sha2("text", 256).alias("digest")] if repeated else []),
    )
    slim = common.staged(slim, "fingerprints")
    one = slim.groupBy("doc_id").agg(F.min_by("fingerprint", "digest").alias("f")) if repeated else slim.select("doc_id", F.col("fingerprint").alias("f"))
    following = links.join(one.withColumnRenamed("doc_id", "next_id"), "next_id").select(F.col("doc_id").alias("of"), F.col("f").alias("next_fingerprint"))
    return slim.join(following, F.col("doc_id") == F.col("of")).select(
        F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(common.table(spark, sf_dir, "documents"))
