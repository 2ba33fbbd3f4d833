"""Queries of detectors, tiers, span algebra, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakline.functions import text as tx
from cloakline.functions import types as ty
from cloakline.operators import detect, routing, sessions, spans
from cloakline.operators.detect import Rule
from cloakline.plans import planted
from cloakline.plans import sql as s
from cloakline.sources import files

RULES = [
    Rule("projects", "ORGANIZATION", patterns=["Project\\s+Heron"], confidence=0.9),
    Rule("places", "LOCATION", keywords=["Campus North", "Project"], confidence=0.6),
]
Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def listed(df, column="found", *keep):
    """One row per span."""
    return df.select(*(keep or ("id",)), F.explode(column).alias("s")).select(*(keep or ("id",)), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), *([F.col("s.type").alias("type")] if "type" in df.schema[column].dataType.elementType.names else []))


for _name, (_type, _pattern) in detect.PATTERNS.items():
    query(f"detect_{_name}", f'WITH {s.planted_cte("planted")} SELECT id, start, "end", text, \'{_type}\' AS type FROM ({s.matches("planted", _pattern)})')(
        lambda spark, d, n=_name: listed(planted.load(spark, d, "planted").withColumn("found", detect.detect(F.col("text"), n)))
    )

for _name in ("email", "phone"):
    query(f"documents_{_name}", f'SELECT doc_id, start, "end", text, \'{detect.PATTERNS[_name][0]}\' AS type FROM ({s.matches("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", detect.PATTERNS[_name][1], "doc_id")})')(
        lambda spark, d, n=_name: listed(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", detect.detect(F.col("text"), n).alias("found")), "found", "doc_id")
    )


def detected(spark, d):
    return planted.load(spark, d, "planted").withColumn("spans", detect.regex_detect(F.col("text")))


FOUND = f"WITH {s.planted_cte('planted')}, {s.found('planted')}"


@query("regex_detect", f'{FOUND} SELECT id, start, "end", text, type FROM found')
def regex_detect(spark, d):
    return listed(detected(spark, d), "spans")


@query("containment_anti_join", f'{FOUND}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pi, i) AS place FROM raw) SELECT a.id, a.start, a."end", a.text, a.type FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.id = b.id AND b.start <= a.start AND a."end" <= b."end" AND (b.start - b."end", b.place) < (a.start - a."end", a.place))')
def containment(spark, d):
    found = F.concat(*[detect.detect(F.col("text"), n) for n in detect.PATTERNS])
    rows = planted.load(spark, d, "planted").select("id", F.posexplode(found).alias("place", "x")).select("id", "place", "x.*")
    return spans.contained_anti_join(rows).select("id", "start", "end", "text", "type")


RULE_SQL = f"""
  r AS (SELECT id, i, start, "end", text, 'ORGANIZATION' AS type, 0.9::DOUBLE AS confidence, 0 AS p FROM ({s.matches('planted', 'Project\\s+Heron')})
    UNION ALL SELECT id, i, start, "end", text, 'LOCATION', 0.6, 1 FROM ({s.matches('planted', 'Campus North')})
    UNION ALL SELECT id, i, start, "end", text, 'LOCATION', 0.6, 2 FROM ({s.matches('planted', 'Project')}))"""


@query("rules_detect", f'WITH {s.planted_cte("planted")}, {RULE_SQL} SELECT id, start, "end", text, type, confidence FROM r')
def rules_detect(spark, d):
    rows = planted.load(spark, d, "planted").select("id", F.explode(detect.rule_spans(F.col("text"), RULES)).alias("x"))
    return rows.select("id", "x.start", "x.end", "x.text", "x.type", "x.confidence")


MERGED = f"""{FOUND}, {RULE_SQL},
  u AS (SELECT id, start, "end", text, type, confidence, 0 AS tier, pi AS a, i AS b, 0 AS c FROM found UNION ALL SELECT id, start, "end", text, type, confidence, 1, start, p, i FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier = 0 THEN start ELSE a END, a, b, c) AS place FROM u),
  merged AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.id = b.id AND b.start <= a.start AND a."end" <= b."end" AND (b.start - b."end", b.place) < (a.start - a."end", a.place)))"""


@query("merge_spans", f'{MERGED} SELECT id, start, "end", text, type FROM merged')
def merge_spans(spark, d):
    every = F.concat(detect.regex_detect(F.col("text")), detect.rule_spans(F.col("text"), RULES))
    return listed(planted.load(spark, d, "planted").withColumn("spans", detect.merge(every)), "spans")


@query("escalate", f"""{FOUND}, {RULE_SQL}
  SELECT p.id, coalesce((SELECT bool_or(confidence < 0.7) FROM r WHERE r.id = p.id), false)
    OR (NOT EXISTS (SELECT 1 FROM found f WHERE f.id = p.id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = p.id) AND len(regexp_extract_all(p.text, '\\S+')) > 200) AS escalates
  FROM planted p""")
def escalate(spark, d):
    rows = detect.fast_tier(planted.load(spark, d, "planted"), RULES, fast_reply=None)
    return rows.select("id", detect.escalates(F.col("fast_spans"), F.col("text")).alias("escalates"))


REPLY = """
  t AS (SELECT id, text, trim(reply, E' \\n\\t') AS r0 FROM model_spans),
  b AS (SELECT id, text, CASE WHEN r0 LIKE '```%' THEN trim(regexp_replace(regexp_replace(r0, '^(```json)?', ''), '(```)$', ''), E' \\n') ELSE r0 END AS body FROM t),
  e AS (SELECT id, text, body, CASE WHEN body = '' THEN 'EmptyModelResponse' WHEN NOT json_valid(body) THEN 'ModelOutputParseError'
     WHEN EXISTS (SELECT 1 FROM (SELECT unnest(TRY_CAST(body AS JSON[])) AS j) WHERE j->>'text' IS NULL OR j->>'end' IS NULL OR j->>'confidence' IS NULL) THEN 'ModelOutputParseError' END AS error FROM b),
  j AS (SELECT id, text, error, CASE WHEN error IS NULL THEN TRY_CAST(body AS JSON[]) ELSE [] END AS js FROM e),
  parsed AS (SELECT id, i, upper(x->>'type') AS type, cast(x->>'start' AS BIGINT) AS start, cast(x->>'end' AS BIGINT) AS "end", x->>'text' AS text, cast(x->>'confidence' AS DOUBLE) AS confidence, coalesce(cast(x->>'implicit' AS BOOLEAN), false) AS implicit
    FROM (SELECT id, unnest(js) AS x, unnest(range(1, len(js) + 1)) AS i FROM j) WHERE upper(x->>'type') IN ('PERSON', 'ORGANIZATION', 'LOCATION', 'EMAIL', 'PHONE', 'SSN', 'CREDENTIAL'))"""
MODEL = f"WITH {s.planted_cte('model_spans')}, {REPLY}"


@query("model_parse", f'{MODEL} SELECT j.id, error, p.start, p."end", p.text, p.type, p.confidence, p.implicit FROM j LEFT JOIN parsed p ON j.id = p.id')
def model_parse(spark, d):
    rows = planted.load(spark, d, "model_spans").select("id", detect.parse_reply(F.col("reply")).alias("p"))
    return rows.select("id", F.col("p.error").alias("error"), F.explode_outer("p.spans").alias("x")).select("id", "error", "x.start", "x.end", "x.text", "x.type", "x.confidence", "x.implicit")


@query("model_parse_lenient", f"""WITH {s.planted_cte("model_spans")},
  b AS (SELECT id, regexp_extract(reply, '(?s)\\[.*\\]') AS body FROM model_spans),
  j AS (SELECT id, CASE WHEN body <> '' AND json_valid(body) THEN TRY_CAST(body AS JSON[]) ELSE [] END AS js FROM b)
  SELECT id, start, "end", text, type, confidence FROM (
    SELECT id, upper(x->>'type') AS type, try_cast(x->>'start' AS BIGINT) AS start, try_cast(x->>'end' AS BIGINT) AS "end", coalesce(x->>'text', '') AS text, coalesce(try_cast(x->>'confidence' AS DOUBLE), 0.0) AS confidence
    FROM (SELECT id, unnest(js) AS x FROM j)) WHERE type IN ('PERSON', 'ORGANIZATION', 'LOCATION', 'EMAIL', 'PHONE', 'SSN', 'CREDENTIAL') AND start IS NOT NULL AND "end" IS NOT NULL""")
def model_parse_lenient(spark, d):
    rows = planted.load(spark, d, "model_spans").select("id", F.explode(detect.parse_reply_leniently(F.col("reply"))).alias("x"))
    return rows.select("id", "x.start", "x.end", "x.text", "x.type", "x.confidence")


def tier_query(mode):
    attempted = {"fast": "false", "deep": "true", "auto": "false"}[mode]
    text = f"""{MODEL} SELECT id, {attempted} AS deep_attempted, {attempted} AND error IS NULL AS deep_scan_used, CASE WHEN {attempted} THEN error END AS deep_error,
      CASE WHEN {attempted} AND error IS NULL THEN 'deep' ELSE 'fast' END AS tier,
      cast(CASE WHEN {attempted} AND error IS NULL THEN (SELECT count(*) FROM parsed p WHERE p.id = j.id AND NOT EXISTS (
        SELECT 1 FROM parsed q WHERE q.id = p.id AND q.start <= p.start AND p."end" <= q."end" AND (q.start - q."end", q.i) < (p.start - p."end", p.i))) ELSE 0 END AS BIGINT) AS n_spans FROM j"""

    def run(spark, d):
        rows = detect.tiers(planted.load(spark, d, "model_spans"), mode, fast_reply=None, deep_reply="reply")
        return rows.select("id", "deep_attempted", "deep_scan_used", "deep_error", ty.tier_label(F.col("deep_scan_used")).alias("tier"), F.size("spans").alias("n_spans"))

    query(f"tier_{mode}", text)(run)


for _mode in ("fast", "deep", "auto"):
    tier_query(_mode)


@query("deep_fallback", f"""{MODEL}, low AS (SELECT j.id, j.error, coalesce((SELECT min(confidence) FROM parsed p WHERE p.id = j.id), 1.0) < 0.7 AS low FROM j)
  SELECT id, error IS NOT NULL AS fast_failed, error IS NULL AND low AS deep_attempted, error IS NULL AND low AND id % 2 = 0 AS deep_scan_used,
    CASE WHEN error IS NULL AND low AND id % 2 = 1 THEN 'InferenceTimeout' END AS deep_error FROM low""")
def deep_fallback(spark, d):
    rows = planted.load(spark, d, "model_spans").withColumn("deep_reply", F.lit("[]")).withColumn("broken", F.when(F.col("id") % 2 == 1, "InferenceTimeout"))
    out = detect.tiers(rows, "auto", fast_reply="reply", deep_reply="deep_reply", deep_error="broken")
    return out.select("id", F.col("fast_error").isNotNull().alias("fast_failed"), "deep_attempted", "deep_scan_used", "deep_error")


CODE = """parts AS (SELECT id, text, string_split(text, '```') AS p FROM planted),
  blocks AS (SELECT id, text, p, len(p) AS n FROM parts),
  x AS (SELECT id, text, p, n, unnest(range(1, n + 1)) AS i FROM blocks),
  y AS (SELECT *, (i % 2 = 0 AND i < n) AS block FROM x),
  z AS (SELECT *, count(*) FILTER (WHERE block) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM y),
  st AS (SELECT id, string_agg(CASE WHEN block THEN '__CODEBLOCK_' || k || '_' WHEN i % 2 = 0 THEN '```' || p[i] ELSE p[i] END, '' ORDER BY i) AS stripped,
    count(*) FILTER (WHERE block) AS n_blocks FROM z GROUP BY id)"""


@query("code_strip", f"WITH {s.planted_cte('planted')}, {CODE} SELECT id, stripped, n_blocks FROM st")
def code_strip(spark, d):
    return planted.load(spark, d, "planted").select("id", tx.strip_code(F.col("text")).alias("c")).select("id", F.col("c.text").alias("stripped"), F.size("c.blocks").alias("n_blocks"))


@query("code_restore", f"WITH {s.planted_cte('planted')} SELECT id, text FROM planted")
def code_restore(spark, d):
    return planted.load(spark, d, "planted").select("id", tx.strip_code(F.col("text")).alias("c")).select("id", tx.restore_code(F.col("c.text"), F.col("c.blocks")).alias("text"))


def anonymized(spark, d):
    rows = detected(spark, d).withColumn("session_id", F.concat(F.lit("s"), F.col("id").cast("string"))).withColumn("message_idx", F.lit(0))
    return spans.anonymize(rows)


DONE = f"{FOUND}, {s.clusters()}, {s.redacted('planted')}"


@query("substitute", f"{DONE} SELECT p.id, coalesce(redacted, p.text) AS redacted FROM planted p LEFT JOIN done USING (id)")
def substitute(spark, d):
    return anonymized(spark, d).select("id", "redacted")


@query("mappings", f"""{DONE} SELECT DISTINCT 's' || id AS session_id, cast(0 AS BIGINT) AS message_idx, token AS placeholder_text, original AS original_text, regexp_extract(token, '^\\[([A-Z]+)_', 1) AS pii_type FROM named""")
def mappings(spark, d):
    return sessions.mapping_rows(anonymized(spark, d), F.lit("2024-01-01").cast("timestamp")).drop("created_at")


@query("restore", f"WITH {s.planted_cte('planted')} SELECT id, text FROM planted")
def restore(spark, d):
    originals = F.map_from_entries(F.transform("mappings", lambda m: F.struct(m["placeholder_text"], m["original_text"])))
    return anonymized(spark, d).select("id", spans.restore(F.col("redacted"), originals).alias("text"))


@query("deanonymize", f"""{DONE}, m AS (SELECT DISTINCT id, token FROM named)
  SELECT p.id, CASE WHEN d.id IS NOT NULL THEN p.text END AS restored, CASE WHEN d.id IS NOT NULL THEN (SELECT count(*) FROM m WHERE m.id = p.id) END AS placeholders_replaced, d.id IS NOT NULL AS found
  FROM planted p LEFT JOIN done d USING (id)""")
def deanonymize(spark, d):
    rows = files.kept(anonymized(spark, d).select("id", "session_id", "message_idx", "redacted", "mappings"), "anonymized")
    store = sessions.mapping_rows(rows, F.lit("2024-01-01").cast("timestamp"))
    out = sessions.deanonymize(rows.select("id", "session_id", F.col("redacted").alias("text")), store)
    return out.select("id", "restored", "placeholders_replaced", "found")


@query("session_all", f"""{DONE} SELECT DISTINCT 's' || id AS session_id, regexp_extract(token, '_([^_]*?)\\]*$', 1) AS placeholder_id, token AS placeholder_text, original AS original_text,
  {s.case("regexp_extract(token, '^.([A-Z]+)_', 1)", {p: t for t, p, *_ in ty.PII_TYPES})} AS type FROM named""")
def session_all(spark, d):
    return sessions.lookup_all(sessions.mapping_rows(anonymized(spark, d), F.lit("2024-01-01").cast("timestamp")))


@query("session_lookup", f"{DONE} SELECT DISTINCT original AS original_text FROM named WHERE id = 1 AND original LIKE 'user%'")
def session_lookup(spark, d):
    store = sessions.mapping_rows(anonymized(spark, d), F.lit("2024-01-01").cast("timestamp"))
    token = F.concat(F.lit("[EMAIL_"), F.left(F.sha2(F.lit("s1:0:user1@mail1.example.com"), 256), F.lit(8)), F.lit("]"))
    return sessions.lookup(store, "s1", token)


@query("session_ttl", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def session_ttl(spark, d):
    store = spark.read.parquet(f"{d}/events.parquet").withColumn("created_at", F.col("ts"))
    return sessions.live(store, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 86_400).select("event_id")


@query("placeholder_collisions", "SELECT 's' AS session_id, 't' AS placeholder_text, cast(0 AS BIGINT) AS originals WHERE false")
def placeholder_collisions(spark, d):
    return sessions.collisions(sessions.mapping_rows(anonymized(spark, d), F.lit("2024-01-01").cast("timestamp")))


@query("privacy_score", f"""{FOUND}, t AS (SELECT p.id, {s.SCORE} AS score FROM planted p LEFT JOIN found f USING (id) GROUP BY p.id)
  SELECT id, score, {s.CLASS.format('score')} AS class, cast(score AS VARCHAR) || ' (' || {s.CLASS.format('score')} || ')' AS header FROM t""")
def privacy_score(spark, d):
    rows = detected(spark, d).withColumn("score", spans.privacy_score(F.col("spans")))
    return rows.select("id", "score", ty.classify(F.col("score")).alias("class"), ty.score_header(F.col("score")).alias("header"))


@query("pii_by_type", f"{FOUND} SELECT {s.case('type', s.PREFIX)} AS pii_type, count(*) AS n FROM found GROUP BY 1")
def pii_by_type(spark, d):
    from cloakline.operators import metrics

    return metrics.pii_by_type(detected(spark, d))


@query("span_masking", f"{FOUND} SELECT id, start, \"end\", '[' || type || ']' AS text, type FROM found")
def span_masking(spark, d):
    return listed(detected(spark, d).withColumn("spans", ty.mask(F.col("spans"))), "spans")


SHIFTED = f"""WITH {s.planted_cte('model_spans')}, {REPLY},
  checked AS (SELECT p.*, m.text AS whole, start >= 0 AND "end" <= length(m.text) AND substr(m.text, start + 1, "end" - start) = p.text AS ok FROM parsed p JOIN model_spans m USING (id))"""


@query("offsets_valid", f'{SHIFTED} SELECT id, start, "end", ok FROM checked')
def offsets_valid(spark, d):
    rows = planted.load(spark, d, "model_spans").withColumn("s", F.explode(detect.parse_reply(F.col("reply"))["spans"]))
    return rows.select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), spans.offsets_valid(F.col("text"), F.col("s")).alias("ok"))


@query("offsets_relocate", f"""{SHIFTED} SELECT id, CASE WHEN ok THEN start ELSE instr(whole, text) - 1 END AS start, CASE WHEN ok THEN "end" ELSE instr(whole, text) - 1 + length(text) END AS "end", text, type FROM checked WHERE ok OR contains(whole, text)""")
def offsets_relocate(spark, d):
    rows = planted.load(spark, d, "model_spans").withColumn("found", detect.parse_reply(F.col("reply"))["spans"]).filter("found is not null")
    return listed(rows.withColumn("found", spans.relocate(F.col("text"), F.col("found"))), "found")


@query("byte_offsets", f'{FOUND} SELECT f.id, octet_length(encode(substr(p.text, 1, cast(f.start AS BIGINT)))) AS byte_start FROM found f JOIN planted p USING (id)')
def byte_offsets(spark, d):
    rows = detected(spark, d).select("id", "text", F.explode("spans").alias("s"))
    return rows.select("id", tx.byte_offset(F.col("text"), F.col("s.start")).alias("byte_start"))


@query("word_count", "SELECT doc_id, cast(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT) AS words FROM documents")
def word_count(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.word_count(F.col("text")).alias("words"))


ROUTES = [(0, "direct", 90, 100, "https://a.example", "anthropic", "A"), (1, "primary", 50, 89, "https://b.example", "anthropic", "A"), (2, "cheap", 0, 40, "https://c.example", "openai", "B")]
ROUTE_SQL = "routes(position, name, lo, hi, fmt) AS (VALUES (0, 'direct', 90, 100, 'anthropic'), (1, 'primary', 50, 89, 'anthropic'), (2, 'cheap', 0, 40, 'openai'))"


@query("route_select", f"""WITH {ROUTE_SQL}, s AS (SELECT cast(c_custkey AS BIGINT) AS id, c_custkey % 101 AS score FROM customer)
  SELECT id, cast(score AS BIGINT) AS privacy_score, name AS route, fmt AS route_format FROM s LEFT JOIN routes ON score BETWEEN lo AND hi""")
def route_select(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 101).alias("privacy_score"))
    return routing.select_route(rows, spark.createDataFrame(ROUTES, routing.ROUTE_SCHEMA))


@query("route_check", "SELECT * FROM (VALUES (3, 'overlap'), (4, 'min_above_max'), (5, 'above_100'), (5, 'overlap'), (6, 'api_format')) t(position, problem)")
def route_check(spark, d):
    bad = [(3, "x", 95, 99, "u", "openai", "K"), (4, "y", 49, 45, "u", "openai", "K"), (5, "z", 100, 120, "u", "openai", "K"), (6, "w", 41, 44, "u", "other", "K")]
    return routing.invalid_routes(spark.createDataFrame(ROUTES + bad, routing.ROUTE_SCHEMA))


FLAGSHIP = f"""WITH planted AS (SELECT doc_id AS id, text FROM documents), {s.found('planted')}, {s.clusters()}, {s.redacted('planted')}, {ROUTE_SQL},
  t AS (SELECT p.id, count(f.id) AS n_spans, {s.SCORE} AS privacy_score FROM planted p LEFT JOIN found f USING (id) GROUP BY p.id)
  SELECT t.id AS doc_id, t.n_spans, t.privacy_score, {s.CLASS.format('t.privacy_score')} AS privacy_class, name AS route, coalesce(d.redacted, p.text) AS redacted
  FROM t JOIN planted p USING (id) LEFT JOIN done d ON d.id = t.id LEFT JOIN routes ON t.privacy_score BETWEEN lo AND hi"""


@query("flagship", FLAGSHIP)
def flagship(spark, d):
    """Detect, merge, redact, score and route whole documents: one narrow stage and a bounded broadcast."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("spans", detect.regex_detect(F.col("text"))).withColumn("session_id", F.concat(F.lit("s"), F.col("doc_id").cast("string"))).withColumn("message_idx", F.lit(0))
    done = routing.select_route(spans.anonymize(rows), spark.createDataFrame(ROUTES, routing.ROUTE_SCHEMA))
    return done.select("doc_id", F.size("spans").alias("n_spans"), "privacy_score", "privacy_class", "route", "redacted")
