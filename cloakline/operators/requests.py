"""The request flow end to end: scan, replace, score, route, record; and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import chat
from cloakline.functions import types as ty
from cloakline.operators import detect, routing, spans


def scan_messages(requests: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per text message: spans, redacted text, mappings. requests: request_id, session_id, body.

    Code blocks are left alone: the pieces around them are scanned where they lie.
    """
    rows = requests.select("request_id", "session_id", "body", F.explode(chat.messages(F.col("body"))).alias("m"))
    rows = rows.select("request_id", "session_id", F.col("m.idx").alias("message_idx"), F.col("m.content").alias("text"))
    rows = rows.withColumn("spans", spans.detect_outside_code(F.col("text"), detect.regex_detect))
    return spans.anonymize(rows, key=key)


def request_scores(scanned: DataFrame) -> DataFrame:
    """request_id, n_spans, privacy_score, privacy_class. Weighted confidences add up over all messages.

    Sums are of decimals, so the result doesn't depend on the order in which tasks finish.
    """
    return _scored(scanned.groupBy("request_id").agg(*_sums()))


def _sums() -> list[Column]:
    lost = F.aggregate("spans", F.lit(0.0), lambda acc, s: acc + ty.weight(s["type"], s["implicit"]) * s["confidence"])
    return [F.sum(F.size("spans")).alias("n_spans"), F.sum(lost.cast("decimal(20,8)")).alias("lost")]


def _scored(one: DataFrame) -> DataFrame:
    score = F.least(F.lit(100), F.floor(F.greatest(F.lit(0.0), 100.0 - F.col("lost").cast("double"))).cast("int"))
    rest = [c for c in one.columns if c not in ("request_id", "n_spans", "lost")]
    return one.select("request_id", "n_spans", score.alias("privacy_score"), ty.classify(score).alias("privacy_class"), *rest)


def anonymize_requests(requests: DataFrame, routes: DataFrame | None = None, key: bytes | None = None, strict: bool = True) -> DataFrame:
    """request_id, session_id, error_kind, status, new_body, n_spans, privacy_score, privacy_class and route."""
    checked = requests.withColumn("error_kind", chat.body_error(F.col("body"), strict))
    good = checked.filter("error_kind is null")
    scanned = scan_messages(good, key)
    # A request's messages come together once, for its score and its texts.
    texts = F.map_from_entries(F.collect_list(F.struct("message_idx", "redacted"))).alias("texts")
    out = checked.join(_scored(scanned.groupBy("request_id").agg(*_sums(), texts)), "request_id", "left")
    none = F.col("error_kind").isNull()
    out = out.withColumn("privacy_score", F.when(none, F.coalesce("privacy_score", F.lit(100)))).withColumn("n_spans", F.when(none, F.coalesce("n_spans", F.lit(0).cast("long"))))
    out = out.withColumn("privacy_class", F.when(none, ty.classify(F.col("privacy_score"))))
    out = out.withColumn("new_body", F.when(none, F.when(F.col("texts").isNull(), F.col("body")).otherwise(chat.rebuild_body(F.col("body"), F.col("texts")))))
    out = out.withColumn("status", F.coalesce(ty.error_status(F.col("error_kind"), F.lit(None).cast("int")), F.lit(200))).drop("texts")
    return routing.select_route(out, routes) if routes is not None else out


def restore_responses(responses: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds restored_body: placeholders replaced inside the content field, so quotes stay well formed.

    responses: session_id, body, api_format; originals: session_id, originals.
    """
    rows = responses.join(originals, "session_id", "left")
    content = chat.response_content(F.col("body"), F.col("api_format"))
    new = spans.restore(content, F.coalesce("originals", F.expr("cast(map() as map<string,string>)")))
    return rows.withColumn("restored_body", chat.rebuild_response(F.col("body"), F.col("api_format"), new)).drop("originals")


def audit_rows(scored: DataFrame, timestamp: Column) -> DataFrame:
    """Entries to chain: counts, score and digests of each request."""
    return scored.select("request_id", "session_id", timestamp.alias("timestamp"), F.col("n_spans").alias("pii_spans_detected"), F.col("privacy_score").cast("long").alias("privacy_score"))
