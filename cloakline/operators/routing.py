"""Routes by privacy score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUTE_SCHEMA = "position int, name string, score_min int, score_max int, upstream_url string, api_format string, api_key_env string"


def invalid_routes(routes: DataFrame) -> DataFrame:
    """position and problem of each route that can't stand: empty or wide ranges, unknown formats, overlaps."""
    own = F.when(F.col("score_min") > F.col("score_max"), "min_above_max").when(F.col("score_max") > 100, "above_100").when(~F.lower("api_format").isin("anthropic", "openai"), "api_format")
    other = routes.select(F.col("position").alias("_p"), F.col("score_min").alias("_min"), F.col("score_max").alias("_max"))
    overlap = routes.join(other, (F.col("_p") < F.col("position")) & (F.col("score_min") <= F.col("_max")) & (F.col("_min") <= F.col("score_max")), "left_semi")
    return routes.withColumn("problem", own).filter("problem is not null").select("position", "problem").unionByName(overlap.select("position", F.lit("overlap").alias("problem")))


def select_route(scored: DataFrame, routes: DataFrame, score: str = "privacy_score") -> DataFrame:
    """Adds route (the first whose range holds the score, else null) and its format.

    A hundred and one scores at most can be asked for, so routes become a table of scores and the join is an
    equi-join against a side of bounded size, whatever the number of routes.
    """
    spread = routes.select("position", "name", "api_format", F.explode(F.sequence(F.greatest("score_min", F.lit(0)), F.least("score_max", F.lit(100)))).alias("_score"))
    first = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_score").orderBy("position"))).filter("_n = 1")
    return scored.join(F.broadcast(first.select("_score", F.col("name").alias("route"), F.col("api_format").alias("route_format"))), F.col(score) == F.col("_score"), "left").drop("_score")
