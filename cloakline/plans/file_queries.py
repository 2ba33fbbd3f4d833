"""Queries of sources and sinks: files are written to a shared folder, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakline.functions import chat
from cloakline.functions import types as ty
from cloakline.operators import audit, canary, detect, evaluate, metrics, network, spans
from cloakline.plans import planted
from cloakline.plans import sql as s
from cloakline.plans.record_queries import EVAL, REPORT, labelled_pairs
from cloakline.plans.text_queries import FOUND, detected, listed
from cloakline.sources import files
from cloakline.streaming import streams

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("labelled_scan", """SELECT id, 'EMAIL' AS type, cast(8 AS BIGINT) AS start, cast(8 + length(t) AS BIGINT) AS "end", t AS text, id % 2 = 0 AS implicit
  FROM (SELECT cast(c_custkey AS BIGINT) AS id, 'u' || c_custkey || '@x.org' AS t FROM customer)""")
def labelled_scan(spark, d):
    """Written and read back; blank lines lie between, and implicit is missing where it is false."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("u"), "c_custkey", F.lit("@x.org")).alias("t"))
    implicit = F.when(F.col("id") % 2 == 0, F.lit(True))
    span = F.struct(F.lit("EMAIL").alias("type"), F.lit(8).alias("start"), (F.length("t") + 8).alias("end"), F.col("t").alias("text"), implicit.alias("implicit"))
    line = F.to_json(F.struct(F.concat(F.col("id").cast("string"), F.lit(": mail "), "t").alias("prompt"), F.array(span).alias("spans")))
    path = files.scratch(spark, "labelled")
    rows.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    found = files.labelled(spark, path).select(F.regexp_extract("prompt", "^[0-9]+", 0).cast("long").alias("id"), F.explode("spans").alias("s"))
    return found.select("id", "s.type", "s.start", "s.end", "s.text", "s.implicit")


def log_rows(spark, d):
    """Entries of one log for each of ten sessions, in order of time, over many days."""
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") * 60)
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("session_id"), F.col("o_orderkey").cast("long").alias("pos"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.date_format(time, "yyyy-MM-dd").alias("day"),
        (F.col("o_orderkey") % 5).cast("long").alias("pii_spans_detected"), (100 - F.col("o_orderkey") % 80).cast("long").alias("privacy_score"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("request_id"), F.lit(audit.V2).alias("hash_recipe"),
    )


def written_log(spark, d):
    path = files.scratch(spark, "audit")
    chained = audit.build_chains(log_rows(spark, d), "session_id", "pos").withColumn("day", F.substring("timestamp", F.lit(1), F.lit(10)))
    files.write_audit(chained, path)
    return path


@query("audit_append", """SELECT strftime(t, '%Y-%m-%d') AS day, request_id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", spans AS pii_spans_detected, score AS privacy_score, 'not_yet_anchored' AS anchor_status, cast(-1 AS BIGINT) AS log_index
  FROM (SELECT TIMESTAMP '1970-01-01' + to_seconds(1700000000 + cast(o_orderkey AS BIGINT) * 60) AS t, 'r' || o_orderkey AS request_id, cast(o_orderkey % 5 AS BIGINT) AS spans, cast(100 - o_orderkey % 80 AS BIGINT) AS score FROM orders)""")
def audit_append(spark, d):
    out = files.audit_log(spark, written_log(spark, d))
    day = F.regexp_extract("file", "day=([0-9-]+)", 1)
    return out.select(day.alias("day"), "request_id", "timestamp", "pii_spans_detected", "privacy_score", "anchor_status", "log_index")


@query("audit_folder", "SELECT 's' || o_custkey % 10 AS session_id, count(*) AS entries, true AS valid, cast(NULL AS BIGINT) AS first_bad FROM orders GROUP BY 1")
def audit_folder(spark, d):
    """Chains over the files of a folder: the first entry of a file follows the last of the file before."""
    return audit.verify_chains(files.audit_log(spark, written_log(spark, d)), "session_id", ("file", "place"))


@query("checkpoint_rows", """SELECT k AS batch, count(*) AS n_heads, arg_min(h, p) AS first_head, arg_max(h, p) AS last_head
  FROM (SELECT cast(o_custkey % 40 AS BIGINT) AS k, o_orderkey AS p, sha256(cast(o_orderkey AS VARCHAR)) AS h FROM orders) GROUP BY 1""")
def checkpoint_rows(spark, d):
    path = files.scratch(spark, "checkpoints")
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 40).cast("long").alias("batch"), F.col("o_orderkey").alias("pos"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("head"))
    files.write_checkpoints(rows, path)
    return spark.read.parquet(path).drop("merkle_root")


@query("baseline_file", "SELECT 'm' AS model_label, 'prompt ' || c_custkey AS prompt, sha256(c_name) AS output_hash, cast(c_custkey % 12 AS BIGINT) AS length_bucket, 'end_turn' AS stop_reason, cast(c_custkey % 9 AS BIGINT) AS latency_bucket FROM customer")
def baseline_file(spark, d):
    """A model's prompts are written as one object and read back, with the fingerprints of each."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(
        F.lit("m").alias("model_label"), F.lit("2024-01-01").alias("created_at"), F.lit("1").alias("engine_version"), F.concat(F.lit("prompt "), F.col("c_custkey").cast("string")).alias("prompt"),
        F.sha2("c_name", 256).alias("output_hash"), (F.col("c_custkey") % 12).cast("int").alias("length_bucket"), F.lit("end_turn").alias("stop_reason"), (F.col("c_custkey") % 9).cast("int").alias("latency_bucket"),
    )
    path = files.scratch(spark, "baseline")
    files.write_baseline(rows, path)
    return files.baseline(spark, path).select("model_label", "prompt", "output_hash", "length_bucket", "stop_reason", "latency_bucket")


@query("baseline_order", "SELECT list_sort(list('p' || c_custkey)) AS prompts FROM customer")
def baseline_order(spark, d):
    """The written object's keys are in order."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("m").alias("model_label"), F.lit("t").alias("created_at"), F.lit("v").alias("engine_version"), F.concat(F.lit("p"), "c_custkey").alias("prompt"), F.lit("h").alias("output_hash"), F.lit(1).alias("length_bucket"), F.lit("end_turn").alias("stop_reason"), F.lit(2).alias("latency_bucket"))
    path = files.scratch(spark, "order")
    files.write_baseline(rows, path)
    return spark.read.text(path).select(F.json_object_keys(F.get_json_object("value", "$.prompts")).alias("prompts"))


@query("evaluation_file", f"{EVAL} SELECT cast(id AS BIGINT) AS idx, cast(3 AS BIGINT) AS n_expected, cast(3 AS BIGINT) AS n_detected, tp, cast(fp AS BIGINT) AS fp, cast(fp AS BIGINT) AS fn, id % 7 / 2.0::DOUBLE AS latency FROM cnt WHERE split = 'overall'")
def evaluation_file(spark, d):
    """An entry's line has the spans themselves and its counts."""
    pairs = labelled_pairs(spark, d)
    counts = evaluate.entry_counts(pairs).filter("split = 'overall'").drop("split")
    rows = pairs.join(counts, "id").withColumn("idx", F.col("id")).withColumn("latency", (F.col("id") % 7) / F.lit(2.0))
    path = files.scratch(spark, "evaluation")
    files.write_evaluation(rows, path)
    span = "array<struct<type:string,start:int,end:int>>"
    out = spark.read.schema(f"idx long, expected {span}, detected {span}, tp long, fp long, fn long, latency double").json(path)
    return out.select("idx", F.size("expected").alias("n_expected"), F.size("detected").alias("n_detected"), "tp", "fp", "fn", "latency")


@query("report_lines", f"{REPORT} SELECT split, format('{{:<10s}} {{:>6d}} {{:>6d}} {{:>6d}} {{:>9.3f}} {{:>9.3f}} {{:>9.3f}}', split, tp, fp, fn, p, p, p) AS line FROM pr")
def report_lines(spark, d):
    return evaluate.printed(evaluate.report(evaluate.entry_counts(labelled_pairs(spark, d))))


@query("mapping_retention", "SELECT DISTINCT cast(ts AS DATE) AS day FROM events WHERE cast(ts AS DATE) < DATE '2024-01-31' - 10")
def mapping_retention(spark, d):
    path = files.scratch(spark, "mappings")
    files.write_mappings(spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").alias("created_at"), F.col("event_id")), path)
    return files.expired_days(spark, path, "2024-01-31", 10)


RULES = '{"rules": [{"name": "a", "type": "org", "patterns": ["x+", "(bad"], "keywords": ["Heron", ""]}, {"name": "b", "type": "planet", "keywords": ["Mars"], "confidence": 0.5}]}'


@query("rules_source", "SELECT * FROM (VALUES ('a', 'ORGANIZATION', ['x+'], ['Heron'], 0.8::DOUBLE), ('b', 'PERSON', CAST([] AS VARCHAR[]), ['Mars'], 0.5::DOUBLE)) t(name, type, patterns, keywords, confidence)")
def rules_source(spark, d):
    rows = [(r.name, r.type, r.patterns, r.keywords, r.confidence) for r in files.rules_from_text(RULES)]
    return spark.createDataFrame(rows, "name string, type string, patterns array<string>, keywords array<string>, confidence double")


ROUTES = '{"routes": [{"name": "a", "score_min": 50, "score_max": 100, "upstream_url": "u", "api_format": "OpenAI", "api_key_env": "K"}]}'


@query("routes_source", "SELECT * FROM (VALUES (1, cast(0 AS BIGINT), 'a', 'openai', cast(50 AS BIGINT)), (2, NULL, NULL, NULL, NULL), (3, NULL, NULL, NULL, NULL)) t(file, position, name, api_format, score_min)")
def routes_source(spark, d):
    """A good file, a missing one and an unreadable one: the last two give no routes."""
    parts = [files.routes_from_text(spark, text).withColumn("file", F.lit(n)) for n, text in ((1, ROUTES), (2, None), (3, "{oops"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    each = spark.range(1, 4).select(F.col("id").cast("int").alias("file"))
    return each.join(rows, "file", "left").select("file", "position", "name", "api_format", "score_min")


@query("options_source", "SELECT * FROM (VALUES ('audit_retention_days', '7'), ('scan_mode', 'fast'), ('session_ttl_seconds', '7200'), ('show_score', 'false'), ('stream', 'true')) t(name, value)")
def options_source(spark, d):
    env = {"CLOAKLINE_SCAN_MODE": "fast", "CLOAKLINE_SESSION_TTL_SECONDS": "2h", "CLOAKLINE_AUDIT_RETENTION_DAYS": "7d", "CLOAKLINE_SHOW_SCORE": "no"}
    rows = [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in vars(files.Options.from_env(env)).items()]
    return spark.createDataFrame(rows, "name string, value string")


@query("endpoints_source", "SELECT * FROM (VALUES ('a.example', cast(443 AS BIGINT)), ('b.example', cast(8443 AS BIGINT))) t(host, port)")
def endpoints_source(spark, d):
    return files.endpoints_from_text(spark, '{"endpoints": [{"host": "a.example"}, {"host": "b.example", "port": 8443}]}')


KINDS = "['InferenceTimeout', 'OllamaServerError', 'ConnectionRefused', 'ModelOutputParseError', 'EmptyModelResponse', 'Other', 'Strange']"
LABELS = "['timeout', 'server_error', 'connection_refused', 'parse_error', 'empty_response', 'other', 'other']"


@query("error_labels", f"SELECT event_id, CASE WHEN event_id % 8 < 7 THEN ({LABELS})[event_id % 8 + 1] END AS label FROM events")
def error_labels(spark, d):
    kinds = F.array(*map(F.lit, [x.strip(" '") for x in KINDS.strip("[]").split(",")]))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", ty.detection_error_label(F.get(kinds, (F.col("event_id") % 8).cast("int"))).alias("label"))


@query("format_names", "SELECT cast(c_custkey AS BIGINT) AS id, CASE c_custkey % 2 WHEN 0 THEN 'openai' ELSE 'anthropic' END AS format FROM customer")
def format_names(spark, d):
    written = F.get(F.array(*map(F.lit, ("OpenAI", "anthropic", "openai", "ANTHROPIC"))), (F.col("c_custkey") % 4).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), chat.parse_api_format(written).alias("format"))


@query("jitter_bounds", "SELECT event_id % 5 AS minutes, count(*) AS n, true AS within, event_id % 5 > 0 AS spreads FROM events GROUP BY 1, 4")
def jitter_bounds(spark, d):
    """Intervals stay within a fifth of themselves, zero stays zero, and the others differ."""
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 5).alias("minutes"), canary.jittered((F.col("event_id") % 5) * 60.0, F.col("event_id")).alias("j"))
    base = F.col("minutes") * 60
    return rows.groupBy("minutes").agg(F.count("*").alias("n"), F.bool_and(F.col("j").between(base * 0.8 - 1e-9, base * 1.2 + 1e-9)).alias("within"), (F.max("j") - F.min("j") > base.cast("double") * 0 + F.when(F.first("minutes") > 0, 1.0).otherwise(0.0)).alias("spreads"))


@query("address_words", "SELECT cast(c_custkey AS BIGINT) AS id, cast(536939960 AS BIGINT) AS first, cast(c_custkey % 65536 AS BIGINT) AS last, 167772160 + c_custkey % 256 AS v4 FROM customer")
def address_words(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))
    six = network.ipv6_words(F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("id") % 65536))))
    four = network.ipv4_number(F.concat(F.lit("10.0.0."), (F.col("id") % 256).cast("string")))
    return rows.select("id", six[0].alias("first"), six[3].alias("last"), four.alias("v4"))


@query("sse_tail", "SELECT cast(c_custkey AS BIGINT) AS stream_id, cast(i AS BIGINT) AS idx, CASE i WHEN 0 THEN 'data: ' || c_name || E'\\n\\n' ELSE 'data: rest' END AS event FROM customer, range(0, 2) r(i)")
def sse_tail(spark, d):
    """What follows the last blank line comes last, as it is."""
    whole = F.encode(F.concat(F.lit("data: "), "c_name", F.lit("\n\ndata: rest")), "utf-8")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("stream_id"), whole.alias("b"))
    cut = rows.select("stream_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / 7).cast("int"))).alias("seq"), "b")
    return streams.reassemble(cut.select("stream_id", "seq", F.substring("b", F.col("seq") * 7 + 1, F.lit(7)).alias("chunk")), with_tail=True)


@query("first_entries", "SELECT event_id FROM events ORDER BY event_id LIMIT 10")
def first_entries(spark, d):
    """A limit as the feature: the first entries of an evaluation."""
    return spark.read.parquet(f"{d}/events.parquet").select("event_id").orderBy("event_id").limit(10)


@query("health_checks", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) AS total, bool_and(event_type <> 'error') AS healthy FROM events")
def health_checks(spark, d):
    return metrics.health_summary(spark.read.parquet(f"{d}/events.parquet").withColumn("passed", F.col("event_type") != "error"))


@query("warm_up", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32 END::BIGINT AS wait_seconds, event_id % 7 >= 5 AS gives_up FROM events")
def warm_up(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 7).alias("attempt"))
    return network.warm_up_schedule(rows).select("event_id", "wait_seconds", "gives_up")


@query("detector_flags", f'{FOUND} SELECT id, start, "end", false AS deep_scan_used, false AS rules_attempted FROM found')
def detector_flags(spark, d):
    """A plugged-in detector has no tiers: all flags are false."""
    out = detect.detect_with(planted.load(spark, d, "planted").select("id", "text"), [detect.PatternDetector()])
    return out.select("id", F.explode("spans").alias("s"), "deep_scan_used", "rules_attempted").select("id", "s.start", "s.end", "deep_scan_used", "rules_attempted")
