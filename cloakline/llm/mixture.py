"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target: its weight's share of the mix, but never more than a limit times its own size; what
it can't take is shared again by weight until no target is above its limit. A source's documents expect
target / size copies each. The whole part is certain: every document gets it. The fraction is the probability of
one more copy. Documents are ranked by random odds over inclusion odds, U/(1-U) : p/(1-p), and the lowest ranks are
taken until the source's remaining words are met; the last one is taken if that comes nearer to the target.

Probabilities within a source are unequal: in proportion to a document's weight, but with MOST copies at most; what
that cuts off goes to the others. The weight is a given column's, to a sixteenth of an octave, or by default grows with
the document: 1 and an eighth for each binary digit of its words, so that longer documents are likelier.

Ranks come from a hash of doc_id, text, source and seed, so reruns agree; rows equal in all of these are counted, so
each has a rank of its own. The cut in each source is found by histograms of ranks, refined level by level, so no task
ever sorts a source; only rows of the last, narrow cell are ordered. Sources are ordered by ranges.

Null texts have size 0 and null sources are one source, after all others. Null and repeated doc_ids are rows like any
other; mix() repeats one of the rows that are equal in doc_id, text and source as often as all of them are taken.
Sources without words have target 0. A null weight is 1, one below LEAST_WEIGHT is that. Extra columns are kept by
mix() and not read by plan().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm import common

#: Fixed values of the default mix: weights by source order, the mix over all sizes, the most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
CELLS, LEVELS = 1 << 12, 3
SEED = 20_240_117
LEAST_WEIGHT = 2.0**-20
#: Parts that rows equal in doc_id, text and source are dealt to while they are counted.
SALTS = 64
SAME = ("doc_id", "source", "digest")


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    """Equality of a's columns with b's, which begin with an underscore; nulls are equal."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b["_" + c]) for c in columns])


def sizes(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, digest, w, row: the slim table that all later passes read."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{common.WORD_SPACE}]+")), F.lit(0)).cast("long")
    given = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(LEAST_WEIGHT)) if weight else None
    w = F.pow(F.lit(2.0), F.round(F.log2(given) * 16) / 16) if weight else 1 + F.length(F.bin("size")) / F.lit(8.0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), digest(F.col("text")).alias("digest"), *([weight] if weight else []))
    return rows.select("doc_id", "source", "size", "digest", w.alias("w"), F.monotonically_increasing_id().alias("row"))


def numbered(slim: DataFrame) -> DataFrame:
    """Adds nth: 0, or the number of a row among those equal to it. slim: written, so that row stays what it is."""
    many = slim.groupBy(*SAME).agg(F.count("*").alias("n")).filter("n > 1")
    many = common.staged(many.select(*[F.col(c).alias("_" + c) for c in SAME]), "repeated")
    if many.isEmpty():
        return slim.withColumn("nth", F.lit(0).cast("long"))
    salted = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = slim.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, same(rows, salted, SAME) & (rows["salt"] == salted["_salt"]), "left")
    joined = common.staged(joined.select("doc_id", "source", "size", "digest", "w", "row", F.col("_salt").isNotNull().alias("many"), F.shiftright("row", 20).alias("part")), "marked")
    repeated = joined.filter("many")
    counts = repeated.groupBy(*SAME, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*SAME).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias("_" + c) for c in SAME], F.col("part").alias("_part"), before.alias("before"))
    within = repeated.withColumn("k", F.row_number().over(Window.partitionBy(*SAME, "part").orderBy("row")))
    within = within.join(counts, same(within, counts, (*SAME, "part"))).withColumn("nth", F.col("before") + F.col("k"))
    columns = ["doc_id", "source", "size", "digest", "w"]
    return within.select(*columns, "nth").unionByName(joined.filter("not many").select(*columns, F.lit(0).cast("long").alias("nth")))


def placed(sources: DataFrame) -> DataFrame:
    """Adds place: the number of a source in order, null last. Ranges are ordered apart, then their sizes are added up."""
    by = [F.col("source").isNull().alias("none"), F.col("source")]
    ranges = sources.repartitionByRange(*by).withColumn("range", F.spark_partition_id())
    ranges = common.staged(ranges, "source_ranges")
    local = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")) - 1
    sizes_ = ranges.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    offsets = sizes_.select(F.col("range").alias("_range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.withColumn("local", local).join(offsets, F.col("range") == F.col("_range")).withColumn("place", F.col("before") + F.col("local")).drop("range", "_range", "before", "local")


def targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. The driver sees a few numbers a round."""
    by = placed(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    by = common.staged(by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")), "sources")
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(most)
    rate, full = 0.0, -1
    while True:
        over = limit <= F.col("w") * rate
        free, taken, count = by.agg(F.sum(F.when(~over, F.col("w"))), F.sum(F.when(over, limit)), F.count(F.when(over, 1))).first()
        if count == full or not free:
            break
        rate, full = (total - (taken or 0.0)) / free, count
    return by.select("source", "source_size", F.least(limit, F.col("w") * rate).alias("target"))


def rates(rows: DataFrame, most: int) -> DataFrame:
    """source and rate: copies expected are rate times weight, most at the most, and reach the target.

    Classes of equal weight are few. Taken from the heaviest on, those that would get more than most get most; the rate
    is that of the first class which, sharing what is left with all lighter ones, gets no more.
    """
    classes = rows.groupBy("source", "target", "w").agg(F.sum("size").alias("s"))
    by = Window.partitionBy("source").orderBy(F.desc("w"))
    full = F.coalesce(F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("s") * F.col("w")).over(by.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("rate", F.try_divide(F.col("target") - most * full, rest)).withColumn("k", F.row_number().over(by))
    first = F.min(F.when(F.col("rate") * F.col("w") <= most * (1 + 1e-12), F.struct("k", "rate")))
    return tried.groupBy("source").agg(F.coalesce(first["rate"], F.lit(float("inf"))).alias("rate"))


def _plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, weight: str | None = None) -> DataFrame:
    slim = common.staged(sizes(docs, weight), "sizes")
    goals = common.staged(targets(slim, weights, share, most), "targets")
    rows = numbered(slim).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = common.staged(rates(slim.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), most).withColumnRenamed("source", "_r"), "rates")
    rows = rows.join(rate, F.col("source").eqNullSafe(F.col("_r"))).drop("_r")
    expected = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.col("rate") * F.col("w"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-9))
    rows = rows.withColumn("p", F.greatest(F.col("expected") - F.col("certain"), F.lit(0.0)))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "digest", "source", "nth", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # Odds are mapped to 0..1 in order, so that cells of equal width hold like shares of documents.
    rows = rows.withColumn("rank", F.when(F.col("p") > 1e-9, odds / (1 + odds))).withColumn("tie", F.xxhash64("doc_id", "digest", "source", "nth", F.lit(seed + 1)))
    rows = common.staged(rows.select("doc_id", "source", "digest", "size", "source_size", "target", "certain", "rank", "tie"), "ranked")
    cut = cuts(rows)
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    key = F.struct(F.col("rank").alias("rank"), F.col("tie").alias("tie"))
    more = F.when(F.col("rank").isNull() | F.col("_source").isNull(), 0).when(key <= F.struct(F.col("cut_rank").alias("rank"), F.col("cut_tie").alias("tie")), 1).otherwise(0)
    return joined.select("doc_id", "source", "digest", "size", "source_size", "target", (F.col("certain") + more).cast("long").alias("copies"))


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row. how: weights, share, most, seed, weight."""
    return _plan(docs, **how).drop("digest")


def cuts(rows: DataFrame) -> DataFrame:
    """_source, cut_rank, cut_tie: the last document taken once more in each source; sources that take none have no row."""
    ranked = rows.filter("rank is not null").select("source", "tie", "size", "rank")
    # The words still wanted, once the certain copies of all documents are taken.
    certain = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted"), F.count(F.when(F.col("rank").isNotNull(), 1)).alias("ranked")).filter("ranked > 0").select("source", "wanted")
    state = certain.select(F.col("source").alias("_s"), "wanted", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("before"))
    width = 1.0
    for _ in range(LEVELS):
        width /= CELLS
        cell = F.least(F.floor(F.col("rank") / F.lit(width)), F.lit(round(1 / width) - 1)).cast("long")
        inside = ranked.join(state, F.col("source").eqNullSafe(F.col("_s"))).withColumn("sub", cell)
        if width < 1.0 / CELLS:
            inside = inside.filter(F.floor(F.col("sub") / CELLS) == F.col("cell"))
        sums = inside.groupBy("source", "wanted", "before", "sub").agg(F.sum("size").alias("words"))
        by = Window.partitionBy("source").orderBy("sub")
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(by))
        # The cell in which the sum passes what is wanted; the last cell if it never does.
        reach = F.when(F.col("upto") >= F.col("wanted"), F.struct(F.lit(0).alias("no"), F.col("sub").alias("sub"), (F.col("upto") - F.col("words")).alias("b")))
        last = F.struct(F.lit(1).alias("no"), F.col("sub").alias("sub"), (F.col("upto") - F.col("words")).alias("b"))
        state = sums.groupBy("source").agg(F.first("wanted").alias("wanted"), F.coalesce(F.min(reach), F.max(last)).alias("x"))
        state = common.staged(state.select(F.col("source").alias("_s"), "wanted", F.col("x.sub").alias("cell"), F.col("x.b").alias("before")), "cells")
    # Documents of the one narrow cell, in order; earlier cells are taken whole.
    near = ranked.join(state, F.col("source").eqNullSafe(F.col("_s"))).filter(F.least(F.floor(F.col("rank") / F.lit(width)), F.lit(round(1 / width) - 1)) == F.col("cell"))
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "tie")))
    key = F.struct("rank", "tie")
    taken = F.abs(F.col("upto") - F.col("wanted")) <= F.abs(F.col("upto") - F.col("size") - F.col("wanted"))
    best = near.groupBy("source").agg(F.max(F.when(taken & (F.col("upto") - F.col("size") < F.col("wanted")) | (F.col("upto") <= F.col("wanted")), key)).alias("best"), F.first("cell").alias("cell"))
    # Where not even the cell's first document is taken, the cut is the cell's lower end.
    return best.select(F.col("source").alias("_source"), F.coalesce("best.rank", F.col("cell") * F.lit(width)).alias("cut_rank"), F.coalesce("best.tie", F.lit(-(1 << 63))).alias("cut_tie"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken."""
    own = common.prefix(docs)
    copies = _plan(docs, **how).groupBy(*SAME).agg(F.sum("copies").alias(own + "copies"), F.count("*").alias(own + "rows")).filter(F.col(own + "copies") > 0)
    copies = common.staged(copies.withColumnsRenamed({c: own + c for c in SAME}), "copies")
    key = {"doc_id": docs["doc_id"].cast("long"), "source": docs["source"], "digest": digest(docs["text"])}
    equal = reduce(lambda x, y: x & y, [key[c].eqNullSafe(F.col(own + c)) for c in SAME])
    single = F.col(own + "rows") == 1
    out = docs.join(copies.filter(single), equal)
    if not copies.filter(~single).isEmpty():
        out = out.unionByName(docs.join(copies.filter(~single), equal).dropDuplicates([own + c for c in SAME]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own + "copies"))).alias(own + "copy")).drop(own + "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
