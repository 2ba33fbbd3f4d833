"""The mapping store: placeholders by session, with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import types as ty
from cloakline.operators.spans import restore


def mapping_rows(redacted: DataFrame, created_at: Column, session: str = "session_id", message: str = "message_idx") -> DataFrame:
    """Store rows of redacted messages: one for each distinct placeholder, all with the batch's time."""
    rows = redacted.select(session, message, F.explode("mappings").alias("m"))
    return rows.select(session, message, F.col("m.placeholder_text").alias("placeholder_text"), F.col("m.original_text").alias("original_text"), ty.prefix(F.col("m.type")).alias("pii_type"), created_at.alias("created_at"))


def lookup(store: DataFrame, session_id: str, placeholder: str | Column) -> DataFrame:
    """The original of one placeholder, at most one row."""
    return store.filter((F.col("session_id") == session_id) & (F.col("placeholder_text") == placeholder)).select("original_text").limit(1)


def lookup_all(store: DataFrame) -> DataFrame:
    """All placeholders with id (what stands between the last _ and ]) and type."""
    return store.select("session_id", F.regexp_extract("placeholder_text", r"_([^_]*?)\]*$", 1).alias("placeholder_id"), "placeholder_text", "original_text", ty.parse_stored_type(F.col("pii_type")).alias("type"))


def live(store: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows that haven't expired; times compare as text in one fixed format, so a filter reaches the scan."""
    return store.filter(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def collisions(store: DataFrame) -> DataFrame:
    """Placeholders of a session that stand for several originals."""
    return store.groupBy("session_id", "placeholder_text").agg(F.count_distinct("original_text").alias("originals")).filter("originals > 1")


def session_maps(store: DataFrame) -> DataFrame:
    """One map of placeholders for each session. A session's mappings are bounded by its requests."""
    one = store.groupBy("session_id", "placeholder_text").agg(F.min("original_text").alias("original_text"))
    return one.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("placeholder_text", "original_text")))).alias("originals"))


def deanonymize(df: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """Adds restored, placeholders_replaced and found (whether the session has any mapping)."""
    out = df.join(session_maps(store), "session_id", "left")
    used = F.size(F.filter(F.map_keys("originals"), lambda k: F.contains(F.col(text), k)))
    return (
        out.withColumn("restored", F.when(F.col("originals").isNotNull(), restore(F.col(text), F.col("originals"))))
        .withColumn("placeholders_replaced", F.when(F.col("originals").isNotNull(), used))
        .withColumn("found", F.col("originals").isNotNull()).drop("originals")
    )
