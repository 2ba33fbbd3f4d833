"""Counters, gauges, histograms and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds, in seconds, of the deep tier's latency buckets.
DEEP_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 90.0, 120.0, 180.0, 300.0)
#: The usual bounds.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(events: DataFrame, name: str, label: str, amount: Column | None = None) -> DataFrame:
    """metric, label, value: one counter for each value of the label column."""
    return events.groupBy(F.col(label).cast("string").alias("label")).agg(F.sum(amount if amount is not None else F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "label", "value")


def pii_by_type(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of spans by placeholder prefix, added up within each row's array before any shuffle."""
    from cloakline.functions import types as ty

    return rows.select(F.explode(spans).alias("s")).groupBy(ty.prefix(F.col("s.type")).alias("pii_type")).agg(F.count("*").alias("n"))


def gauge(events: DataFrame, name: str, value: str, order: tuple[str, ...]) -> DataFrame:
    return events.agg(F.max_by(F.col(value).cast("double"), F.struct(*order)).alias("value")).select(F.lit(name).alias("metric"), "value")


def histogram(events: DataFrame, value: str, buckets: tuple[float, ...] = DEFAULT_BUCKETS, by: tuple[str, ...] = ()) -> DataFrame:
    """le, cumulative (and sum and count in every row), for each group of by. One pass: all buckets add up map-side."""
    sums = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    one = events.groupBy(*by).agg(*sums, F.count(value).alias("count"), F.sum(F.col(value).cast("double")).alias("sum"))
    cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return one.select(*by, "count", "sum", F.explode(cells).alias("c")).select(*by, F.col("c.le").alias("le"), F.col("c.n").alias("cumulative"), "count", "sum")


def silent_fallback(events: DataFrame, attempted: str, used: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Deep scans asked for, those that answered, and the difference."""
    out = events.groupBy(*by).agg(F.count_if(F.col(attempted)).alias("attempted"), F.count_if(F.col(used)).alias("succeeded"))
    return out.withColumn("silent", F.col("attempted") - F.col("succeeded"))


def health_summary(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """passed and total of all checks, and whether every one passed."""
    one = checks.agg(F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total"))
    return one.withColumn("healthy", F.col("passed") == F.col("total"))


def exposition(values: DataFrame, label_name: str) -> DataFrame:
    """Text lines of counters: metric{label="value"} number."""
    number = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    return values.select(F.concat(F.col("metric"), F.lit("{" + label_name + '="'), F.col("label"), F.lit('"} '), number).alias("line"))
