"""Chat bodies and server-sent events in two wire formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import text as tx

OPENAI, ANTHROPIC = "openai", "anthropic"
#: Headers that aren't passed on, and those of answers that aren't passed back.
DROPPED_REQUEST_HEADERS = ("host", "transfer-encoding", "connection", "content-length", "x-cloakline-session", "authorization", "x-api-key")
DROPPED_RESPONSE_HEADERS = ("transfer-encoding", "content-length", "connection")


def api_format(path: Column) -> Column:
    return F.when(F.regexp_replace(path, "/+$", "") == "/v1/chat/completions", OPENAI).otherwise(ANTHROPIC)


def parse_api_format(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin(OPENAI, ANTHROPIC), low).otherwise(F.raise_error(F.concat(F.lit("unknown api format "), name)).cast("string"))


def raw_messages(body: Column) -> Column:
    """The elements of messages, each as JSON text; null if there is no such array."""
    return F.from_json(F.get_json_object(body, "$.messages"), "array<string>")


def is_text(message: Column) -> Column:
    """Whether a message's content is a string: only those are scanned."""
    return F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(message), "$.content", "variant")) == "STRING", F.lit(False))


def messages(body: Column) -> Column:
    """Array of (idx, content) of all messages with string content; null if there is no messages array."""
    every = F.transform(raw_messages(body), lambda m, i: F.struct(i.alias("idx"), F.when(is_text(m), F.get_json_object(m, "$.content")).alias("content")))
    return F.filter(every, lambda m: m["content"].isNotNull())


def body_error(body: Column, strict: bool = True) -> Column:
    """Error kind of a request body: not JSON, no messages, or (strict) content that can't be scanned."""
    raw = raw_messages(body)
    bad = body.isNull() | (F.trim(body) == "") | F.try_parse_json(body).isNull() | raw.isNull()
    unseen = F.exists(raw, lambda m: F.get_json_object(m, "$.content").isNotNull() & ~is_text(m)) | F.get_json_object(body, "$.system").isNotNull()
    out = F.when(bad, "bad_request")
    return out.when(F.coalesce(unseen, F.lit(False)), "unsupported_media_type") if strict else out


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def rebuild_body(body: Column, texts: Column) -> Column:
    """The body with messages' contents replaced. texts: map from message index to text.

    Messages are rebuilt as maps of raw JSON values, so other fields keep their values.
    """

    def one(m: Column, i: Column) -> Column:
        new = F.try_element_at(texts, i)
        fields = F.from_json(m, "map<string,variant>")
        parts = F.transform(F.map_entries(fields), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"] == "content", quoted(new)).otherwise(F.to_json(e["value"]))))
        return F.when(new.isNotNull() & is_text(m), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(m)

    fields = F.from_json(body, "map<string,variant>")
    rebuilt = F.concat(F.lit("["), F.array_join(F.transform(raw_messages(body), one), ","), F.lit("]"))
    parts = F.transform(F.map_entries(fields), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"] == "messages", rebuilt).otherwise(F.to_json(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def response_content(body: Column, format_: Column) -> Column:
    return F.when(format_ == OPENAI, F.get_json_object(body, "$.choices[0].message.content")).otherwise(F.get_json_object(body, "$.content[0].text"))


def _raw(text: Column, value: Column) -> Column:
    """JSON of a field, from its text (unquoted if it is a string) and its value."""
    return F.when(F.schema_of_variant(value) == "STRING", quoted(text)).otherwise(F.coalesce(text, F.lit("null")))


def set_string(json: Column, path: tuple[str | int, ...], new: Column) -> Column:
    """JSON text with the string at a path of keys and places replaced; all beside the path stays as it is written."""
    if not path:
        return quoted(new)
    deeper = lambda text: set_string(text, path[1:], new)
    if isinstance(path[0], int):
        values = F.from_json(json, "array<variant>")
        items = F.transform(F.from_json(json, "array<string>"), lambda x, i: F.when(i == path[0], deeper(x)).otherwise(_raw(x, F.get(values, i))))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    values = F.map_values(F.from_json(json, "map<string,variant>"))
    fields = F.map_entries(F.from_json(json, "map<string,string>"))
    parts = F.transform(fields, lambda e, i: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"] == path[0], deeper(e["value"])).otherwise(_raw(e["value"], F.get(values, i)))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def with_string(json: Column, path: tuple[str | int, ...], new: Column) -> Column:
    """set_string where a string lies at the path and new isn't null, else the text itself."""
    place = "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in path)
    found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), place, "variant")) == "STRING"
    return F.coalesce(F.when(F.coalesce(found, F.lit(False)) & new.isNotNull(), set_string(json, path, new)), json)


def rebuild_response(body: Column, format_: Column, new: Column) -> Column:
    """The answer with the string at its content's path replaced; bodies without one come back unchanged."""
    openai, other = (with_string(body, path, new) for path in (("choices", 0, "message", "content"), ("content", 0, "text")))
    return F.when(format_ == OPENAI, openai).otherwise(other)


def delta(event: Column, format_: Column) -> Column:
    return F.when(format_ == OPENAI, F.get_json_object(event, "$.choices[0].delta.content")).otherwise(F.get_json_object(event, "$.delta.text"))


def set_delta(event: Column, format_: Column, new: Column) -> Column:
    openai, other = (with_string(event, path, new) for path in (("choices", 0, "delta", "content"), ("delta", "text")))
    return F.when(format_ == OPENAI, openai).otherwise(other)


def build_delta(text: Column, format_: Column) -> Column:
    """A made event that carries a flushed tail."""
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices")))
    anthropic = F.to_json(F.struct(F.struct(text.alias("text")).alias("delta")))
    return F.when(format_ == OPENAI, openai).otherwise(anthropic)


def streams(body: Column, enabled: bool = True) -> Column:
    return F.lit(enabled) & F.coalesce(F.get_json_object(body, "$.stream") == "true", F.lit(False))


def pass_headers(headers: Column, dropped: tuple[str, ...] = DROPPED_REQUEST_HEADERS) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*dropped))


def complete_events(text: Column) -> Column:
    """Events of a concatenated stream, each with its blank line; an unfinished one is left out."""
    parts = F.split(text, "\n\n", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p, F.lit("\n\n")))


def unfinished(text: Column) -> Column:
    return F.element_at(F.split(text, "\n\n", -1), -1)


def event_line_kind(line: Column) -> Column:
    """delta, done or pass."""
    return F.when(line == "data: [DONE]", "done").when(F.startswith(line, F.lit("data: ")) & F.try_parse_json(F.substring(line, F.lit(7), F.length(line))).isNotNull(), "delta").otherwise("pass")


def is_blank(text: Column) -> Column:
    return tx.unicode_trim(text) == ""
