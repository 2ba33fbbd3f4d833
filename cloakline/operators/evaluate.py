"""Evaluation of detectors against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.operators.detect import overlaps

#: Recall wanted for explicit and implicit spans, and the recall below which a detector is given up.
EXPLICIT_TARGET, IMPLICIT_TARGET, KILL = 0.90, 0.70, 0.60


def matches(detected: Column, expected: Column) -> Column:
    """Number of detected spans that take an expected one: in order of detection, the first free one of the same type
    that overlaps. One span takes at most one."""

    def step(taken: Column, d: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(expected) - 1), lambda i: ~F.array_contains(taken, i) & (F.get(expected, i)["type"] == d["type"]) & overlaps(F.get(expected, i), d))
        return F.transform(F.array(free), lambda f: F.when(F.size(f) > 0, F.concat(taken, F.slice(f, 1, 1))).otherwise(taken))[0]

    taken = F.aggregate(detected, F.expr("cast(array() as array<int>)"), step)
    return F.when((F.size(expected) > 0) & (F.size(detected) > 0), F.size(taken)).otherwise(0)


def entry_counts(rows: DataFrame, detected: str = "detected", expected: str = "expected") -> DataFrame:
    """split (overall, explicit, implicit), tp, fp, fn of each row; matching is done anew within each split."""
    parts = []
    for split, keep in (("overall", lambda s: F.lit(True)), ("explicit", lambda s: ~s["implicit"]), ("implicit", lambda s: s["implicit"])):
        d, e = F.filter(detected, keep), F.filter(expected, keep)
        tp = matches(d, e)
        parts.append(F.struct(F.lit(split).alias("split"), tp.alias("tp"), (F.size(d) - tp).alias("fp"), (F.size(e) - tp).alias("fn")))
    kept = [c for c in rows.columns if c not in (detected, expected)]
    return rows.select(*kept, F.explode(F.array(*parts)).alias("_c")).select(*kept, "_c.*")


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def report(counts: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each group; ratios without a denominator are 1."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = sums.withColumn("precision", precision(F.col("tp"), F.col("fp"))).withColumn("recall", recall(F.col("tp"), F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def printed(reported: DataFrame) -> DataFrame:
    """split and line: a report's rows as lines of fixed width."""
    return reported.select("split", F.format_string("%-10s %6d %6d %6d %9.3f %9.3f %9.3f", "split", "tp", "fp", "fn", "precision", "recall", "f1").alias("line"))


def targets(reported: DataFrame) -> DataFrame:
    """split, verdict: pass, miss or kill."""
    wanted = F.when(F.col("split") == "explicit", EXPLICIT_TARGET).when(F.col("split") == "implicit", IMPLICIT_TARGET)
    return reported.filter("split != 'overall'").select("split", "recall", F.when(F.col("recall") < KILL, "kill").when(F.col("recall") >= wanted, "pass").otherwise("miss").alias("verdict"))


#: Cells in which the median is looked for first.
CELLS = 4096


def latency_summary(rows: DataFrame, latency: str = "latency", tokens: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, least, most and the upper median (element n div 2 of the sorted values, from 0).

    The median is found in two steps: counts by cells of equal width between least and most tell the cell that holds
    it, then only that cell's distinct values are ranked. So no task orders a group's values, whatever their number.
    """
    one, value = rows.filter(F.col(latency).isNotNull()), F.col(latency)
    if not by:
        one = one.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    stats = one.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(latency).alias("mean"), F.min(latency).alias("least"), F.max(latency).alias("most"), *([F.avg(F.col(tokens) / value).alias("tokens_per_second")] if tokens else []))

    def joined(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """left with the columns of right beside the keys (and more), which may be null."""
        named = right.withColumnsRenamed({k: "_k_" + k for k in (*keys, *more)})
        on = [left[k].eqNullSafe(named["_k_" + k]) for k in (*keys, *more)]
        return left.join(named, reduce(lambda x, y: x & y, on)).drop(*["_k_" + k for k in (*keys, *more)])

    counted = one.groupBy(*keys, latency).agg(F.count("*").alias("_c"))
    bounds = stats.select(*keys, F.col("n").alias("_n"), F.col("least").alias("_least"), F.col("most").alias("_most"))
    share = F.try_divide(value.cast("double") - F.col("_least"), F.col("_most").cast("double") - F.col("_least"))
    cells = joined(counted, bounds).withColumn("_cell", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1).cast("long")))
    wanted = F.floor(F.col("_n") / 2)
    upto = lambda order: F.sum("_c").over(Window.partitionBy(*keys).orderBy(order))
    sums = cells.groupBy(*keys, "_n", "_cell").agg(F.sum("_c").alias("_c")).withColumn("_upto", upto("_cell")).filter(F.col("_upto") > wanted)
    first = sums.groupBy(*keys).agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_c")).alias("before"))).alias("_f"))
    inside = joined(cells, first.select(*keys, "_f._cell", F.col("_f.before").alias("_before")), "_cell")
    ranked = inside.withColumn("_upto", F.col("_before") + upto(latency)).filter(F.col("_upto") > wanted)
    return joined(stats, ranked.groupBy(*keys).agg(F.min(latency).alias("median"))).drop("_all")


def dataset_totals(labels: DataFrame, spans: str = "spans") -> DataFrame:
    implicit = F.size(F.filter(spans, lambda s: s["implicit"]))
    return labels.agg(F.count("*").alias("entries"), F.sum(F.size(spans)).alias("spans"), F.sum(F.size(spans) - implicit).alias("explicit"), F.sum(implicit).alias("implicit"))
