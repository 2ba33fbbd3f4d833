"""Types of personal data, their weights and names, and the small label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type, placeholder prefix, weight of an explicit and of an implicit span.
PII_TYPES = (
    ("PERSON", "PERSON", 10, 15),
    ("ORGANIZATION", "ORG", 5, 8),
    ("LOCATION", "LOCATION", 5, 5),
    ("EMAIL", "EMAIL", 12, 12),
    ("PHONE", "PHONE", 12, 12),
    ("SSN", "SSN", 12, 12),
    ("CREDENTIAL", "CREDENTIAL", 20, 20),
)
TYPE_NAMES = tuple(t for t, *_ in PII_TYPES)
PREFIXES = tuple(p for _, p, *_ in PII_TYPES)
#: Error kind and HTTP status.
ERROR_STATUS = {
    "bad_request": 400, "payload_too_large": 413, "unsupported_media_type": 415, "model_unavailable": 503, "session_store": 503,
    "audit_trail": 503, "upstream_unavailable": 502, "upstream_error": None, "upstream_timeout": 504, "internal": 500,
}
#: Detection error and its metric label.
DETECTION_ERRORS = {
    "InferenceTimeout": "timeout", "OllamaServerError": "server_error", "ConnectionRefused": "connection_refused",
    "ModelOutputParseError": "parse_error", "EmptyModelResponse": "empty_response", "Other": "other",
}
#: The least score of each class, best first.
SCORE_CLASSES = ((90, "LOW"), (50, "MEDIUM"), (0, "HIGH"))

SPAN = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("implicit", T.BooleanType()),
])
SPANS = T.ArrayType(SPAN)
NO_SPANS = f"cast(array() as {SPANS.simpleString()})"


def choose(value: Column, cases: dict) -> Column:
    """value looked up in a small map of literals; null if it isn't there."""
    out = F.lit(None)
    for key, result in cases.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def span(type_: Column, start: Column, end: Column, text: Column, confidence: Column, implicit: Column) -> Column:
    return F.struct(type_.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), confidence.cast("double").alias("confidence"), implicit.alias("implicit"))


def weight(type_: Column, implicit: Column) -> Column:
    return F.when(implicit, choose(type_, {t: i for t, _, _, i in PII_TYPES})).otherwise(choose(type_, {t: e for t, _, e, _ in PII_TYPES}))


def prefix(type_: Column) -> Column:
    return choose(type_, {t: p for t, p, *_ in PII_TYPES})


def parse_rule_type(name: Column) -> Column:
    """Any case, with the short form of organisations; unknown names are persons."""
    upper = F.upper(name)
    return F.coalesce(choose(upper, {t: t for t in TYPE_NAMES} | {"ORG": "ORGANIZATION"}), F.lit("PERSON"))


def parse_model_type(name: Column) -> Column:
    """Any case, full names only; null if unknown."""
    return choose(F.upper(name), {t: t for t in TYPE_NAMES})


def parse_label_type(name: Column) -> Column:
    """Exact full names only; null if unknown."""
    return choose(name, {t: t for t in TYPE_NAMES})


def parse_stored_type(name: Column) -> Column:
    """Prefix form only; anything else is an error."""
    found = choose(name, {p: t for t, p, *_ in PII_TYPES})
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown stored type "), name)).cast("string"))


def classify(score: Column) -> Column:
    out = F.lit(SCORE_CLASSES[-1][1])
    for least, name in reversed(SCORE_CLASSES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_header(score: Column) -> Column:
    return F.format_string("%d (%s)", score, classify(score))


def tier_label(deep_scan_used: Column) -> Column:
    return F.when(deep_scan_used, "deep").otherwise("fast")


def detection_error_label(kind: Column) -> Column:
    return F.coalesce(choose(kind, DETECTION_ERRORS), F.when(kind.isNotNull(), "other"))


def error_status(kind: Column, upstream_status: Column) -> Column:
    """HTTP status of an error kind; upstream errors pass their own on."""
    return F.when(kind == "upstream_error", upstream_status).otherwise(choose(kind, {k: v for k, v in ERROR_STATUS.items() if v})).cast("int")


def mask(spans: Column) -> Column:
    """Spans for display: [TYPE] stands in place of the text."""
    return F.transform(spans, lambda s: s.withField("text", F.concat(F.lit("["), s["type"], F.lit("]"))))
