"""Model fingerprints: features, scores, rolling health, rotation of probes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.functions import text as tx

#: Scores a health verdict looks back on, and its bounds.
WINDOW, HEALTHY, DEGRADED = 8, 0.8, 0.5
#: The score of bucket distances 0, 1, 2, ...; further ones score 0.
LENGTH_SCORES, LATENCY_SCORES = (1.0, 0.5), (1.0, 0.7, 0.3)


def output_hash(text: Column) -> Column:
    return F.sha2(F.lower(tx.unicode_trim(text)), 256)


def log2_bucket(value: Column) -> Column:
    """Whole part of the binary logarithm, exact for every long; values below 1 count as 1."""
    return F.length(F.bin(F.greatest(value.cast("long"), F.lit(1)))) - 1


def log2_scaled(value: Column, times: int, plus: int) -> Column:
    """log2_bucket of value * times + plus, exact though that has more bits than any number type.

    value is whole and from 0 to 2**126 (the square of any long), times below 2**20, plus small. The number is looked at
    in three parts: what is above bit 84, bits 42 to 83, and the lowest 42.
    """
    whole, upper, lower = value.cast("decimal(38,0)"), F.lit(Decimal(1 << 84)), F.lit(Decimal(1 << 42))
    low = whole % upper * F.lit(Decimal(times)) + F.lit(Decimal(plus))
    top = _div(whole, upper) * times + _div(low + upper, upper) - 1
    middle = _div(low % upper, lower)
    return F.when(top > 0, log2_bucket(top) + 84).when(middle > 0, log2_bucket(middle) + 42).otherwise(log2_bucket(low % lower))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def by_distance(a: Column, b: Column, scores: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for distance, score in enumerate(scores):
        out = F.when(F.abs(a - b) == distance, score).otherwise(out)
    return out


def score_probes(probes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds the four scores and their mean. Both have prompt, output_hash, length_bucket, stop_reason, latency_bucket."""
    base = baseline.select(F.col("prompt").alias("_p"), *[F.col(c).alias("_" + c) for c in ("output_hash", "length_bucket", "stop_reason", "latency_bucket")])
    rows = probes.join(base, F.col("prompt") == F.col("_p"))
    rows = rows.withColumn("score_output", F.when(F.col("output_hash") == F.col("_output_hash"), 1.0).otherwise(0.0))
    rows = rows.withColumn("score_length", by_distance(F.col("length_bucket"), F.col("_length_bucket"), LENGTH_SCORES))
    rows = rows.withColumn("score_stop", F.when(F.col("stop_reason") == F.col("_stop_reason"), 1.0).otherwise(0.0))
    rows = rows.withColumn("score_latency", by_distance(F.col("latency_bucket"), F.col("_latency_bucket"), LATENCY_SCORES))
    composite = (F.col("score_output") + F.col("score_length") + F.col("score_stop") + F.col("score_latency")) / 4
    return rows.withColumn("composite", composite).drop(*[c for c in rows.columns if c.startswith("_")])


def unknown_prompts(probes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Probes without a fingerprint: errors."""
    return probes.join(baseline.select("prompt"), "prompt", "left_anti")


def health(mean: Column) -> Column:
    return F.when(mean >= HEALTHY, "healthy").when(mean < DEGRADED, "degraded").otherwise("unknown")


def health_of(mean: float) -> str:
    """The same for one number."""
    return "healthy" if mean >= HEALTHY else "degraded" if mean < DEGRADED else "unknown"


def rolling_health(scored: DataFrame, series: str, order: tuple[str, ...]) -> DataFrame:
    """Adds mean_score and health over the last WINDOW scores of each series (a model, say)."""
    by = Window.partitionBy(series).orderBy(*order).rowsBetween(1 - WINDOW, 0)
    return scored.withColumn("mean_score", F.avg("composite").over(by)).withColumn("health", health(F.col("mean_score")))


def status(scored: DataFrame, series: str, order: tuple[str, ...], time: str) -> DataFrame:
    """series, health, last_probe_at, probes_in_window."""
    rank = F.row_number().over(Window.partitionBy(series).orderBy(*[F.desc(c) for c in order]))
    recent = scored.withColumn("_n", rank).filter(F.col("_n") <= WINDOW)
    return recent.groupBy(series).agg(health(F.avg("composite")).alias("health"), F.max(time).alias("last_probe_at"), F.count("*").alias("probes_in_window"))


def daily_seed(day: Column) -> Column:
    """Days since the common era began."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1


def rotation(days: DataFrame, prompts: DataFrame) -> DataFrame:
    """day, prompt, turn: each day's order of the prompts. The order follows a digest of day and prompt."""
    pairs = days.select("day").distinct().join(F.broadcast(prompts.select("prompt")))
    key = F.sha2(F.concat(F.date_format("day", "yyyy-MM-dd"), F.col("prompt")), 256)
    return pairs.withColumn("turn", F.row_number().over(Window.partitionBy("day").orderBy(key)) - 1)


def jittered(seconds: Column, key: Column, spread: float = 0.2) -> Column:
    """An interval within spread of itself, by a hash of key; zero stays zero."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / F.lit(1_000_002.0)
    return seconds * (1 - spread + 2 * spread * u)
