"""Detectors: fixed patterns, user rules, model replies, and the tiers that combine them.

Every detector is an expression from text to an array of spans, so detection is one narrow stage inside the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import text as tx
from cloakline.functions import types as ty

#: Type and pattern of each built-in detector, in the order in which their spans are listed.
#: (?U) gives classes and boundaries their Unicode meaning.
PATTERNS = {
    "url_credential": ("CREDENTIAL", r"https?://[a-zA-Z0-9._%+-]+:[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}[^\s]*"),
    "email": ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "ssn": ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    "phone": ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    "api_key": ("CREDENTIAL", r"\b(?:sk|pk|api|token|key|secret|bearer)[-_][a-zA-Z0-9_\-]{8,}\b"),
}
LOW_CONFIDENCE, LONG_TEXT_WORDS = 0.7, 200


def empty() -> Column:
    return F.expr(ty.NO_SPANS)


def pattern_spans(text: Column, type_: str, pattern: str, confidence: float = 1.0) -> Column:
    """Spans of all matches of one pattern."""
    return _as_spans(tx.find_all(text, "(?U)" + pattern), type_, confidence)


def _as_spans(found: Column, type_: str, confidence: float) -> Column:
    return F.transform(found, lambda m: ty.span(F.lit(type_), m["start"], m["end"], m["text"], F.lit(confidence), F.lit(False)))


def detect(text: Column, name: str) -> Column:
    return pattern_spans(text, *PATTERNS[name])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def overlaps(a: Column, b: Column) -> Column:
    """Half-open: spans that only touch don't overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def drop_contained(spans: Column, key) -> Column:
    """Sort by key, then by place in the list, and keep a span unless one before it contains it.

    Containment is transitive, so it doesn't matter whether the containing span is itself kept.
    """

    def numbered(s: Column) -> Column:
        return F.array_sort(F.transform(s, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("span"))))

    def kept(s: Column) -> Column:
        return F.filter(s, lambda x, i: ~F.exists(F.slice(s, F.lit(1), i), lambda y: contains(y["span"], x["span"])))

    return F.when(F.size(spans) < 2, spans).otherwise(tx.let(numbered(spans), lambda s: F.transform(F.array_sort(F.transform(kept(s), lambda x: F.struct(x["span"]["start"].alias("start"), x["i"].alias("i"), x["span"].alias("span")))), lambda x: x["span"])))


def regex_detect(text: Column) -> Column:
    """All built-in patterns, sorted by start, without spans contained in an earlier one."""
    found = F.concat(*[detect(text, name) for name in PATTERNS])
    return tx.let(found, lambda s: drop_contained(s, lambda x: x["start"]))


def merge(spans: Column) -> Column:
    """Longest first, contained spans dropped whatever their type, back in order of start."""
    return tx.let(spans, lambda s: drop_contained(s, lambda x: x["start"] - x["end"]))


@dataclass
class Rule:
    """A user-defined detector."""

    name: str
    type: str
    patterns: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    confidence: float = 0.8


def rule_spans(text: Column, rules: list[Rule]) -> Column:
    """Spans of all rules, patterns before keywords within each, sorted by start; nothing is merged."""
    parts = []
    for rule in rules:
        parts += [pattern_spans(text, rule.type, p, rule.confidence) for p in rule.patterns]
        for word in rule.keywords:
            parts.append(_as_spans(tx.find_literal(text, F.lit(word)), rule.type, rule.confidence))
    if not parts:
        return empty()
    every = F.transform(F.concat(*parts), lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x.alias("span")))
    return F.transform(F.array_sort(every), lambda x: x["span"])


RAW = "array<struct<type:string,start:int,end:int,text:string,confidence:double,implicit:boolean>>"


def parse_reply(reply: Column) -> Column:
    """(spans, error) of a model's reply.

    Fences are stripped. An empty reply and one that isn't a JSON array whose every element has the needed fields are
    errors; elements of unknown type are dropped.
    """
    trimmed = tx.unicode_trim(F.coalesce(reply, F.lit("")))
    opened = F.regexp_replace(F.regexp_replace(trimmed, "^(```json)+", ""), "^(```)+", "")
    body = F.when(F.startswith(trimmed, F.lit("```")), tx.unicode_trim(F.regexp_replace(opened, "(```)+$", ""))).otherwise(trimmed)
    raw = F.from_json(body, RAW, {"mode": "PERMISSIVE"})
    bad = raw.isNull() | ~F.startswith(body, F.lit("[")) | F.exists(raw, lambda s: s.isNull() | s["type"].isNull() | s["start"].isNull() | s["end"].isNull() | s["text"].isNull() | s["confidence"].isNull())
    good = F.filter(F.transform(raw, lambda s: ty.span(ty.parse_model_type(s["type"]), s["start"], s["end"], s["text"], s["confidence"], F.coalesce(s["implicit"], F.lit(False)))), lambda s: s["type"].isNotNull())
    error = F.when(trimmed == "", "EmptyModelResponse").when(F.coalesce(bad, F.lit(True)), "ModelOutputParseError")
    return tx.let(F.struct(error.alias("error"), good.alias("good")), lambda x: F.struct(F.when(x["error"].isNull(), x["good"]).alias("spans"), x["error"].alias("error")))


def parse_reply_leniently(reply: Column) -> Column:
    """Spans of the first bracketed part; elements that don't fit are skipped, anything unreadable gives none."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0)
    # Elements are read one by one, so that a bad one spoils only itself.
    parts = F.coalesce(F.from_json(body, "array<string>"), F.expr("cast(array() as array<string>)"))
    raw = F.transform(parts, lambda p: F.from_json(p, "type string, start string, end string, text string, confidence string, implicit string"))
    spans = F.transform(raw, lambda s: ty.span(ty.parse_model_type(s["type"]), s["start"].try_cast("int"), s["end"].try_cast("int"), F.coalesce(s["text"], F.lit("")), F.coalesce(s["confidence"], F.lit("0")).try_cast("double"), F.coalesce(s["implicit"] == "true", F.lit(False))))
    return F.filter(spans, lambda s: s["type"].isNotNull() & s["start"].isNotNull() & s["end"].isNotNull() & s["confidence"].isNotNull())


def escalates(spans: Column, text: Column) -> Column:
    """A span below the confidence bound, or none at all in a long text. spans: before merging."""
    return F.exists(spans, lambda s: s["confidence"] < LOW_CONFIDENCE) | ((F.size(spans) == 0) & (tx.word_count(text) > LONG_TEXT_WORDS))


def fast_tier(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", fast_reply: str | None = "fast_reply") -> DataFrame:
    """Adds fast_spans (patterns, fast model, rules, in this order), fast_error and rules_attempted.

    fast_error is fatal for its row: detection then has no spans, and callers answer that the model is unavailable.
    """
    parsed = parse_reply(F.col(fast_reply)) if fast_reply else F.struct(empty().alias("spans"), F.lit(None).cast("string").alias("error"))
    out = df.withColumn("_fast", parsed)
    parts = F.concat(regex_detect(F.col(text)), F.coalesce(F.col("_fast.spans"), empty()), rule_spans(F.col(text), rules or []))
    return out.withColumn("fast_error", F.col("_fast.error")).withColumn("fast_spans", F.when(F.col("fast_error").isNull(), parts)).withColumn("rules_attempted", F.lit(bool(rules))).drop("_fast")


def tiers(df: DataFrame, mode: str = "auto", rules: list[Rule] | None = None, text: str = "text", fast_reply: str | None = "fast_reply", deep_reply: str | None = "deep_reply", deep_error: str | None = None) -> DataFrame:
    """Adds spans (merged), deep_scan_available, deep_attempted, deep_scan_used, deep_error, rules_attempted, fast_error.

    mode: fast never asks the deep model, deep always does, auto does where the fast tier's spans escalate. A deep
    model that fails leaves the fast tier's result in place. The reply columns hold models' answers, computed before
    for the rows that need them (escalated()), so no model runs for a row that doesn't.
    """
    if mode not in ("fast", "deep", "auto"):
        raise ValueError(f"unknown scan mode {mode}")
    out = fast_tier(df, rules, text, fast_reply)
    available = deep_reply is not None and mode != "fast"
    wanted = F.lit(False) if not available else F.lit(True) if mode == "deep" else F.coalesce(escalates(F.col("fast_spans"), F.col(text)), F.lit(False))
    out = out.withColumn("deep_attempted", wanted & F.col("fast_error").isNull())
    if available:
        parsed = parse_reply(F.col(deep_reply))
        out = out.withColumn("_deep", F.when(F.col("deep_attempted"), parsed))
        failed = F.coalesce(F.col(deep_error), F.col("_deep.error")) if deep_error else F.col("_deep.error")
        out = out.withColumn("_failed", F.when(F.col("deep_attempted"), failed))
        out = out.withColumn("deep_scan_used", F.col("deep_attempted") & F.col("_failed").isNull())
        spans = F.when(F.col("deep_scan_used"), F.concat("fast_spans", F.coalesce("_deep.spans", empty()))).otherwise(F.col("fast_spans"))
        out = out.withColumn("spans", merge(spans)).withColumn("deep_error", F.col("_failed")).drop("_deep", "_failed")
    else:
        out = out.withColumn("deep_scan_used", F.lit(False)).withColumn("spans", merge(F.col("fast_spans"))).withColumn("deep_error", F.lit(None).cast("string"))
    return out.withColumn("deep_scan_available", F.lit(available)).drop("fast_spans")


def escalated(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", fast_reply: str | None = "fast_reply") -> DataFrame:
    """The rows whose fast tier escalates: the only ones to send to a deep model."""
    return fast_tier(df, rules, text, fast_reply).filter(escalates(F.col("fast_spans"), F.col(text)))


class Detector(Protocol):
    """What can be plugged in: a name, and spans as an expression of the text. Models plug in as reply columns instead."""

    name: str

    def detect(self, text: Column) -> Column: ...


@dataclass
class PatternDetector:
    """The patterns."""

    name: str = "patterns"

    def detect(self, text: Column) -> Column:
        return regex_detect(text)


@dataclass
class RuleDetector:
    """User rules."""

    rules: list[Rule]
    name: str = "rules"

    def detect(self, text: Column) -> Column:
        return rule_spans(text, self.rules)


def detect_with(df: DataFrame, detectors: list[Detector], text: str = "text") -> DataFrame:
    """Adds spans, merged over all detectors, and the flags that a detector without tiers has: all false."""
    parts = [d.detect(F.col(text)) for d in detectors]
    no = {name: F.lit(False) for name in ("deep_scan_available", "deep_attempted", "deep_scan_used", "rules_attempted")}
    return df.withColumn("spans", merge(F.concat(*parts)) if parts else empty()).withColumns(no)


@dataclass
class Tiers:
    """Tiers built from options: a deep model only where the mode may ask it, rules only if their file can be read."""

    mode: str
    rules: list[Rule]
    fast_reply: str | None
    deep_reply: str | None

    @classmethod
    def build(cls, mode: str, read_rules=None, fast_reply: str | None = "fast_reply", deep_reply: str | None = "deep_reply") -> Tiers:
        """read_rules: called for the rules; rules that can't be read count as none."""
        if mode.lower() not in ("fast", "deep", "auto"):
            raise ValueError(f"unknown scan mode {mode}")
        try:
            rules = read_rules() if read_rules else []
        except Exception:  # noqa: BLE001  any defect of the rules means none
            rules = []
        return cls(mode.lower(), rules, fast_reply, None if mode.lower() == "fast" else deep_reply)

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        return tiers(df, self.mode, self.rules, text, self.fast_reply, self.deep_reply)


#: What a model is told before a text, how long it may take, and how much it may answer.
PROMPT = "Find personal data in the text. Answer with a JSON array of objects with type, start, end, text, confidence and implicit, and nothing else. Types: {types}."
SECONDS, TOKENS = 8.0, 1024


def asking(complete, prompt: str | None = None, seconds: float = SECONDS, tokens: int = TOKENS):
    """A model for with_model out of complete(prompt, text, tokens) -> reply. A call that takes longer gives up on its
    text: the reply is null, which reads as an empty one."""
    told = prompt or PROMPT.format(types=", ".join(ty.TYPE_NAMES))

    def model(texts: list[str]) -> list[str | None]:
        from concurrent.futures import ThreadPoolExecutor
        from concurrent.futures import TimeoutError as Late

        pool, out = ThreadPoolExecutor(max(len(texts), 1)), []
        calls = [pool.submit(complete, told, t, tokens) for t in texts]
        for call in calls:
            try:
                out.append(call.result(timeout=seconds))
            except Late:
                call.cancel()
                out.append(None)
        pool.shutdown(wait=False, cancel_futures=True)
        return out

    return model


def with_model(df: DataFrame, model, text: str = "text", reply: str = "reply", key: str = "id", only: Column | None = None, retries: int = 1) -> DataFrame:
    """Adds reply, the answer of model(texts) -> list of strings, asked in Arrow batches for the rows of only.

    A reply that can't be read is asked for again once; other failures aren't. The rows that aren't asked don't pass
    through Python: the answers are joined back by key. See asking() for a model's prompt, time and length.
    """
    asked = (df.filter(only) if only is not None else df).select(key, text)
    kind = asked.schema[key].dataType.simpleString()

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            replies = list(model(texts))
            for _ in range(retries):
                again = []
                for i, r in enumerate(replies):
                    try:
                        json.loads(r.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
                    except (ValueError, AttributeError):
                        if r and r.strip():
                            again.append(i)
                if not again:
                    break
                for i, r in zip(again, model([texts[i] for i in again]), strict=True):
                    replies[i] = r
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=[key, reply])

    answers = asked.mapInArrow(run, f"{key} {kind}, {reply} string")
    return df.join(answers, key, "left")
