"""Queries of chat bodies, events, audit chains, anchoring, canary, metrics, evaluation, endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakline.functions import chat
from cloakline.functions import text as tx
from cloakline.functions import types as ty
from cloakline.operators import audit, canary, evaluate, metrics, network, requests, spans
from cloakline.plans import planted
from cloakline.plans import sql as s
from cloakline.plans.text_queries import DONE, ROUTES, anonymized
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


REQ = f"WITH {s.planted_cte('requests')}"
VALID = "CASE WHEN json_valid(body) THEN body ELSE 'null' END"
MESSAGES = f"""{REQ}, msg AS (SELECT request_id, session_id, i - 1 AS idx, m FROM (SELECT request_id, session_id, unnest(CAST(js AS JSON[])) AS m, unnest(range(1, len(CAST(js AS JSON[])) + 1)) AS i
    FROM (SELECT request_id, session_id, json_extract({VALID}, '$.messages') AS js FROM requests) WHERE js IS NOT NULL)),
  texts AS (SELECT request_id, session_id, idx, m->>'content' AS content FROM msg WHERE json_type(m, '$.content') = 'VARCHAR')"""


@query("chat_messages", f"{MESSAGES} SELECT request_id, idx, content FROM texts")
def chat_messages(spark, d):
    rows = planted.load(spark, d, "requests").select("request_id", F.explode(chat.messages(F.col("body"))).alias("m"))
    return rows.select("request_id", "m.idx", "m.content")


ERROR = f"""CASE WHEN trim(body) = '' OR NOT json_valid(body) OR json_extract({VALID}, '$.messages') IS NULL THEN 'bad_request'
  WHEN EXISTS (SELECT 1 FROM msg WHERE msg.request_id = requests.request_id AND json_type(m, '$.content') <> 'VARCHAR') THEN 'unsupported_media_type' END"""


@query("chat_errors", f"{MESSAGES} SELECT request_id, {ERROR} AS error_kind, {s.case(ERROR, {k: v for k, v in ty.ERROR_STATUS.items() if v}, '200')}::BIGINT AS status FROM requests")
def chat_errors(spark, d):
    rows = planted.load(spark, d, "requests").select("request_id", chat.body_error(F.col("body")).alias("error_kind"))
    return rows.withColumn("status", F.coalesce(ty.error_status(F.col("error_kind"), F.lit(None).cast("int")), F.lit(200)))


@query("chat_rebuild", f"""{MESSAGES} SELECT request_id, idx, upper(content) AS content, {VALID}->>'model' AS model FROM texts JOIN requests USING (request_id)""")
def chat_rebuild(spark, d):
    rows = planted.load(spark, d, "requests").withColumn("m", chat.messages(F.col("body"))).filter("m is not null")
    new = F.map_from_entries(F.transform("m", lambda m: F.struct(m["idx"], F.upper(m["content"]))))
    rows = rows.select("request_id", chat.rebuild_body(F.col("body"), new).alias("body"))
    return rows.select("request_id", F.get_json_object("body", "$.model").alias("model"), F.explode(chat.messages(F.col("body"))).alias("m")).select("request_id", "m.idx", "m.content", "model")


@query("api_format", "SELECT page_id, CASE WHEN rtrim(p, '/') = '/v1/chat/completions' THEN 'openai' ELSE 'anthropic' END AS format FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/v1/chat/completions//' WHEN 1 THEN '/v1/messages' ELSE '/v1/chat/completions' END AS p FROM pages)")
def api_format(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, "/v1/chat/completions//").when(F.col("page_id") % 3 == 1, "/v1/messages").otherwise("/v1/chat/completions")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", chat.api_format(path).alias("format"))


@query("chat_streams", f"{REQ} SELECT request_id, coalesce({VALID}->>'stream' = 'true', false) AS streams FROM requests")
def chat_streams(spark, d):
    return planted.load(spark, d, "requests").select("request_id", chat.streams(F.col("body")).alias("streams"))


@query("header_filter", "SELECT c_custkey AS id, list_sort(list_filter(['Accept', 'x-' || lower(c_mktsegment)], lambda k: true)) AS kept FROM (SELECT cast(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer)")
def header_filter(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    heads = F.create_map(F.lit("Accept"), F.lit("a"), F.lit("HOST"), F.lit("h"), F.lit("X-Api-Key"), F.lit("k"), F.concat(F.lit("x-"), F.lower("c_mktsegment")), F.lit("v"), F.lit("authorization"), F.lit("z"))
    return rows.select(F.col("c_custkey").cast("long").alias("id"), F.sort_array(F.map_keys(chat.pass_headers(heads))).alias("kept"))


EVENTS = """ev AS (SELECT cast(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS format,
  CASE WHEN c_custkey % 2 = 0 THEN '{"choices":[{"delta":{"content":"' || c_name || '"}}]}' ELSE '{"type":"d","delta":{"text":"' || c_name || '"}}' END AS event FROM customer)"""


def event_rows(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    even = F.col("c_custkey") % 2 == 0
    event = F.when(even, F.concat(F.lit('{"choices":[{"delta":{"content":"'), "c_name", F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"type":"d","delta":{"text":"'), "c_name", F.lit('"}}')))
    return rows.select(F.col("c_custkey").cast("long").alias("id"), F.when(even, "openai").otherwise("anthropic").alias("format"), event.alias("event"), "c_name")


@query("event_delta", f"WITH {EVENTS} SELECT id, CASE format WHEN 'openai' THEN json_extract_string(event, '$.choices[0].delta.content') ELSE json_extract_string(event, '$.delta.text') END AS delta, replace(event, 'Customer', 'Client') AS changed FROM ev")
def event_delta(spark, d):
    rows = event_rows(spark, d)
    return rows.select("id", chat.delta(F.col("event"), F.col("format")).alias("delta"), chat.set_delta(F.col("event"), F.col("format"), F.replace("c_name", F.lit("Customer"), F.lit("Client"))).alias("changed"))


@query("event_build", """SELECT cast(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 2 = 0 THEN '{"choices":[{"delta":{"content":"' || c_name || '"}}]}' ELSE '{"delta":{"text":"' || c_name || '"}}' END AS event FROM customer""")
def event_build(spark, d):
    return event_rows(spark, d).select("id", chat.build_delta(F.col("c_name"), F.col("format")).alias("event"))


def answers(spark, d):
    even = F.col("c_custkey") % 2 == 0
    body = F.when(even, F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":"to '), "c_name", F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"content":[{"type":"text","text":"to '), "c_name", F.lit('"}]}')))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.when(even, "openai").otherwise("anthropic").alias("format"), body.alias("body"), "c_name")


@query("response_content", "SELECT cast(c_custkey AS BIGINT) AS id, 'to ' || c_name AS content, 'new \"' || c_name || '\"' AS rebuilt FROM customer")
def response_content(spark, d):
    rows = answers(spark, d).withColumn("content", chat.response_content(F.col("body"), F.col("format")))
    new = chat.rebuild_response(F.col("body"), F.col("format"), F.concat(F.lit('new "'), "c_name", F.lit('"')))
    return rows.select("id", "content", chat.response_content(new, F.col("format")).alias("rebuilt"))


@query("response_rebuild", """SELECT id, format, CASE format WHEN 'openai' THEN '{"model":"to ' || c_name || '","choices":[{"index":0,"message":{"role":"assistant","content":"new \\"' || c_name || '\\""}}],"usage":{"n":1.5}}'
  WHEN 'anthropic' THEN '{"id":"to ' || c_name || '","content":[{"type":"text","text":"new \\"' || c_name || '\\""},{"type":"text","text":"to ' || c_name || '"}]}' ELSE '{"content":[{"text":7}]}' END AS rebuilt
  FROM (SELECT cast(c_custkey AS BIGINT) AS id, CASE c_custkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'other' END AS format, c_name FROM customer)""")
def response_rebuild(spark, d):
    """Bodies that hold the content's text elsewhere too, and write it with an escape; and one without a text."""
    third = F.col("c_custkey") % 3
    openai = F.concat(F.lit('{"model":"to '), "c_name", F.lit('","choices":[{"index":0,"message":{"role":"assistant","content":"\\u0074o '), "c_name", F.lit('"}}],"usage":{"n":1.5}}'))
    other = F.concat(F.lit('{"id":"to '), "c_name", F.lit('","content":[{"type":"text","text":"\\u0074o '), "c_name", F.lit('"},{"type":"text","text":"to '), "c_name", F.lit('"}]}'))
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("format", F.when(third == 0, "openai").when(third == 1, "anthropic").otherwise("other"))
    rows = rows.withColumn("body", F.when(third == 0, openai).when(third == 1, other).otherwise('{"content":[{"text":7}]}'))
    new = chat.rebuild_response(F.col("body"), F.col("format"), F.concat(F.lit('new "'), "c_name", F.lit('"')))
    return rows.select(F.col("c_custkey").cast("long").alias("id"), "format", new.alias("rebuilt"))


@query("sse_reassemble", "SELECT cast(c_custkey AS BIGINT) AS stream_id, cast(i AS BIGINT) AS idx, CASE i WHEN 0 THEN 'data: {\"é\":\"' || c_name || E'\"}\\n\\n' ELSE E'data: [DONE]\\n\\n' END AS event FROM customer, range(0, 2) r(i)")
def sse_reassemble(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    whole = F.encode(F.concat(F.lit('data: {"é":"'), "c_name", F.lit('"}\n\ndata: [DONE]\n\ndata: unfinished')), "utf-8")
    cut = rows.select(F.col("c_custkey").cast("long").alias("stream_id"), whole.alias("b")).select("stream_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / 9).cast("int"))).alias("seq"), "b")
    return streams.reassemble(cut.select("stream_id", "seq", F.substring("b", F.col("seq") * 9 + 1, F.lit(9)).alias("chunk")))


@query("sse_lines", "SELECT cast(c_custkey AS BIGINT) AS id, line, kind FROM customer, (VALUES ('event: x', 'pass'), ('data: {\"a\":1}', 'delta'), ('data: [DONE]', 'done'), ('data: {bad', 'pass')) t(line, kind)")
def sse_lines(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.lit('event: x\ndata: {"a":1}\n\ndata: [DONE]\n\ndata: {bad\n').alias("event"))
    return streams.route_lines(rows).select("id", "line", "kind")


@query("stream_restore", f"WITH {s.planted_cte('planted')} SELECT cast(id AS VARCHAR) AS stream_id, text AS restored FROM planted")
def stream_restore(spark, d):
    rows = files.kept(anonymized(spark, d).select("id", "session_id", "redacted", "mappings"), "anonymized").withColumn("stream_id", F.col("id").cast("string"))
    tokens = rows.select("stream_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("redacted") / 5).cast("int"))).alias("seq"), "redacted")
    tokens = tokens.select("stream_id", "seq", F.substring("redacted", F.col("seq") * 5 + 1, F.lit(5)).alias("token")).filter("token != ''")
    tokens = tokens.unionByName(rows.select("stream_id", F.lit(1 << 30).alias("seq"), F.lit("[DONE]").alias("token")))
    originals = rows.select("stream_id", F.map_from_entries(F.transform("mappings", lambda m: F.struct(m["placeholder_text"], m["original_text"]))).alias("originals"))
    return streams.restore_streams(tokens, originals)


@query("anonymize_requests", f"""{MESSAGES}, planted AS (SELECT request_id * 10 + idx AS id, content AS text FROM texts), {s.found('planted')},
  base AS (SELECT request_id, {ERROR} AS error_kind FROM requests),
  sc AS (SELECT id // 10 AS request_id, count(*) AS n, cast(least(100, floor(greatest(0.0, 100.0 - sum(({s.WEIGHT}) * confidence)))) AS BIGINT) AS score FROM found GROUP BY 1)
  SELECT base.request_id, error_kind, CASE WHEN error_kind IS NULL THEN coalesce(n, 0) END AS n_spans, CASE WHEN error_kind IS NULL THEN coalesce(score, 100) END AS privacy_score,
    CASE WHEN error_kind IS NULL THEN CASE WHEN coalesce(score, 100) BETWEEN 90 AND 100 THEN 'direct' WHEN coalesce(score, 100) BETWEEN 50 AND 89 THEN 'primary' WHEN score <= 40 THEN 'cheap' END END AS route
  FROM base LEFT JOIN sc USING (request_id)""")
def anonymize_requests(spark, d):
    from cloakline.operators import routing

    out = requests.anonymize_requests(planted.load(spark, d, "requests"), spark.createDataFrame(ROUTES, routing.ROUTE_SCHEMA))
    return out.select("request_id", "error_kind", "n_spans", "privacy_score", "route")


@query("restore_responses", f"{DONE} SELECT p.id, p.text AS content FROM planted p")
def restore_responses(spark, d):
    rows = files.kept(anonymized(spark, d).select("id", "session_id", "redacted", "mappings"), "anonymized")
    body = F.concat(F.lit('{"content":[{"text":'), chat.quoted(F.col("redacted")), F.lit("}]}"))
    originals = rows.select("session_id", F.map_from_entries(F.transform("mappings", lambda m: F.struct(m["placeholder_text"], m["original_text"]))).alias("originals"))
    out = requests.restore_responses(rows.select("id", "session_id", body.alias("body"), F.lit("anthropic").alias("api_format")), originals)
    return out.select("id", chat.response_content(F.col("restored_body"), F.col("api_format")).alias("content"))


AUDIT_JSON = """'{"anchor_status":"not_yet_anchored","client_requested_model":"","detector_deep_model":"","detector_fast_model":"","hash_recipe":"' || hash_recipe
  || '","hmac_key_id":"","integrated_time":0,"log_index":-1,"pii_spans_detected":' || pii_spans_detected || ',"pii_types":null,"placeholders_generated":null,"prev_hash":"' || {prev}
  || '","privacy_score":' || privacy_score || ',"prompt_hmac":"","rekor_uuid":"","request_id":"' || request_id || '","response_hash_status":"pending","response_hmac":"","selected_route":"","session_id":"' || session_id
  || '","signature_alg":"","signing_key_id":"","timestamp":"' || "timestamp" || '","upstream_reported_model":"","upstream_requested_model":""}'"""


def entry_hash_sql(prev: str) -> str:
    return f"""CASE WHEN hash_recipe = 'audit-v1' THEN sha256(replace("timestamp", 'Z', '+00:00') || session_id || pii_spans_detected || privacy_score || {prev}) ELSE sha256({AUDIT_JSON.replace('{prev}', prev)}) END"""


GENESIS = f"'{audit.GENESIS}'"


@query("entry_hash", f"WITH {s.planted_cte('audit')} SELECT pos, {entry_hash_sql(GENESIS)} AS hash FROM audit")
def entry_hash(spark, d):
    return audit.with_defaults(planted.load(spark, d, "audit")).select("pos", audit.entry_hash().alias("hash"))


CHAIN = f"""WITH RECURSIVE {s.planted_cte('audit')}, n AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) AS k FROM audit),
  c AS (SELECT chain_id, pos, k, {GENESIS} AS prev_hash, {entry_hash_sql(GENESIS)} AS hash FROM n WHERE k = 1
    UNION ALL SELECT n.chain_id, n.pos, n.k, c.hash, {entry_hash_sql('c.hash')} FROM n JOIN c ON n.chain_id = c.chain_id AND n.k = c.k + 1)"""


def chains(spark, d):
    return audit.build_chains(planted.load(spark, d, "audit"))


@query("chain_build", f"{CHAIN} SELECT chain_id, pos, prev_hash, hash FROM c")
def chain_build(spark, d):
    return chains(spark, d).select("chain_id", "pos", "prev_hash", "hash")


@query("chain_verify", f"WITH {s.planted_cte('audit')} SELECT chain_id, count(*) AS entries, true AS valid, cast(NULL AS BIGINT) AS first_bad FROM audit GROUP BY 1")
def chain_verify(spark, d):
    return audit.verify_chains(chains(spark, d))


@query("chain_tamper", f"""WITH {s.planted_cte('audit')}, n AS (SELECT chain_id, pos, row_number() OVER (PARTITION BY chain_id ORDER BY pos) AS k FROM audit)
  SELECT chain_id, count(*) AS entries, min(CASE WHEN pos % 17 = 0 THEN k END) IS NULL AS valid, min(CASE WHEN pos % 17 = 0 THEN k END) AS first_bad FROM n GROUP BY 1""")
def chain_tamper(spark, d):
    forged = chains(spark, d).withColumn("privacy_score", F.when(F.col("pos") % 17 == 0, F.col("privacy_score") + 1).otherwise(F.col("privacy_score")))
    return audit.verify_chains(forged)


@query("chain_heads", f"""{CHAIN}, l AS (SELECT chain_id, arg_max(hash, pos) AS head, count(*) AS entries, arg_max(hash, pos) FILTER (WHERE pos % 3 = 0) AS anchored_head, max(pos) FILTER (WHERE pos % 3 = 0) AS li FROM c GROUP BY 1)
  SELECT chain_id, head, entries, anchored_head, coalesce(li, -1) AS log_index FROM l""")
def chain_heads(spark, d):
    rows = chains(spark, d)
    checkpoints = rows.filter("pos % 3 = 0").select("chain_id", F.col("hash").alias("last_head"), F.col("pos").alias("log_index"))
    return audit.chain_head(rows, checkpoints)


@query("last_hash", f"{CHAIN} SELECT chain_id, arg_max(hash, pos) AS head FROM c GROUP BY 1")
def last_hash(spark, d):
    return audit.last_hash(chains(spark, d))


@query("receipt_lookup", "SELECT cast(o_orderkey AS BIGINT) AS pos, 'r' || o_orderkey AS request_id FROM orders WHERE o_orderkey = 100 AND cast(o_orderdate AS DATE) IS NOT NULL")
def receipt_lookup(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("pos"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("r"), "o_orderkey").alias("request_id"))
    wanted = rows.filter("request_id = 'r100'").select("request_id", "day")
    return audit.receipts(rows, wanted).select("pos", "request_id")


@query("receipt_verify", f"WITH {s.planted_cte('audit')} SELECT pos, CASE WHEN pos % 5 = 0 THEN 'hash_mismatch' WHEN pos % 7 = 0 THEN 'key_mismatch' ELSE 'ok' END AS verdict FROM audit")
def receipt_verify(spark, d):
    rows = audit.with_defaults(planted.load(spark, d, "audit")).withColumn("hmac_key_id", F.when(F.col("pos") % 7 == 0, "old").otherwise("new"))
    rows = rows.withColumn("hash_recipe", F.lit(audit.V2)).withColumn("hash", F.lit(None).cast("string"))
    rows = rows.withColumn("hash", F.when(F.col("pos") % 5 == 0, "0").otherwise(audit.entry_hash()))
    return audit.verify_receipts(rows, "new").select("pos", "verdict")


KEY = bytes(range(32))
INNER, OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


def hmac_sql(message: str) -> str:
    """Digests of raw bytes: the pads are written as blobs."""
    blob = lambda b: "'" + "".join(f"\\x{c:02X}" for c in b) + "'::BLOB"
    return f"sha256({blob(OUTER)} || unhex(sha256({blob(INNER)} || encode({message}))))"


@query("hmac_digest", f"SELECT cast(c_custkey AS BIGINT) AS id, {hmac_sql('c_name')} AS digest FROM customer")
def hmac_digest(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), spans.hmac_sha256(KEY, F.col("c_name")).alias("digest"))


@query("rolling_hmac", f"WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole FROM conversations GROUP BY 1) SELECT conv_id, {hmac_sql('whole')} AS digest FROM t")
def rolling_hmac(spark, d):
    whole = streams.concatenated(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")
    return whole.select("conv_id", spans.hmac_sha256(KEY, F.col("text")).alias("digest"))


def merkle_sql(leaves: str) -> str:
    """leaves: k, i (from 0), h. Recursion over levels; an odd last node goes up unchanged."""
    return f"""WITH RECURSIVE leaf AS ({leaves}), t AS (SELECT k, 0 AS lvl, cast(i AS BIGINT) AS i, h, count(*) OVER (PARTITION BY k) AS n FROM leaf
    UNION ALL SELECT k, lvl + 1, i // 2, CASE WHEN bool_or(i % 2 = 1) THEN sha256(unhex(arg_min(h, i)) || unhex(arg_max(h, i))) ELSE min(h) END, any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY k, lvl, i // 2)"""


@query("merkle_root", f"{merkle_sql('SELECT o_custkey % 40 AS k, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS i, sha256(cast(o_orderkey AS VARCHAR)) AS h FROM orders')} SELECT cast(k AS BIGINT) AS batch, (SELECT count(*) FROM leaf WHERE leaf.k = t.k) AS n_heads, h AS merkle_root FROM t WHERE n = 1")
def merkle_root(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 40).cast("long").alias("batch"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("head"))
    return audit.merkle_roots(rows, "batch", "o_orderkey").select("batch", "n_heads", "merkle_root")


@query("anchor_batches", "SELECT event_id, CASE WHEN b < tot THEN b END AS batch FROM (SELECT event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS tot FROM events)")
def anchor_batches(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ok", F.col("event_type") == "purchase")
    return audit.anchor_batches(rows, "user_id", "event_id", "ok").select("event_id", "batch")


@query("anchor_windows", f"{merkle_sql('SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS k, row_number() OVER (PARTITION BY time_bucket(INTERVAL 15 MINUTE, ts) ORDER BY ts, event_id) - 1 AS i, sha256(cast(event_id AS VARCHAR)) AS h FROM events')} SELECT strftime(k, '%Y-%m-%d %H:%M:%S') AS window_start, (SELECT count(*) FROM leaf WHERE leaf.k = t.k) AS n_heads, h AS merkle_root FROM t WHERE n = 1")
def anchor_windows(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("event_id").alias("pos"), F.sha2(F.col("event_id").cast("string"), 256).alias("head"))
    out = streams.anchor_windows(rows)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_heads", "merkle_root")


@query("pending_heads", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def pending_heads(spark, d):
    return audit.pending_heads(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_id", "event_type").select("event_id", "event_type")


@query("publish_backoff", """WITH i AS (SELECT *, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM events),
  f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, isl ORDER BY event_id) AS fails FROM i)
  SELECT event_id, cast(least(30 * pow(2, least(fails, 20)), 3600) AS BIGINT) AS wait_seconds FROM f""")
def publish_backoff(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ok", F.col("event_type") != "error")
    return audit.publish_backoff(rows, "user_id", "event_id", "ok").select("event_id", "wait_seconds")


@query("record_body", """SELECT cast(c_custkey AS BIGINT) AS id, '{"apiVersion":"0.0.1","kind":"hashedrekord","spec":{"data":{"hash":{"algorithm":"sha256","value":"' || sha256(c_name) || '"}},"signature":{"content":"' || base64(encode(c_name)) || '","publicKey":{"content":"' || base64(encode('PEM')) || '"}}}}' AS body FROM customer""")
def record_body(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), audit.record_body(F.sha2("c_name", 256), F.col("c_name"), F.lit("PEM")).alias("body"))


@query("log_acceptance", """SELECT cast(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 4 < 3 THEN 'u' || c_custkey END AS uuid, CASE WHEN c_custkey % 4 < 3 THEN cast(c_custkey AS BIGINT) END AS log_index, CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 0 END::BIGINT AS integrated_time FROM customer""")
def log_acceptance(spark, d):
    k = F.col("c_custkey").cast("string")
    tail = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('"logIndex":'), k, F.lit(',"verification":{"integratedTime":5}'))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('"logIndex":'), k, F.lit(',"integratedTime":6'))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit('"logIndex":'), k)).otherwise(F.lit('"x":1'))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), audit.log_acceptance(F.concat(F.lit('{"u'), k, F.lit('":{'), tail, F.lit("}}"))).alias("a"))
    return rows.select("id", "a.uuid", "a.log_index", "a.integrated_time")


PROBES = f"WITH {s.planted_cte('probes')}"
BUCKET = "cast(length(bin(greatest({0}, 1))) - 1 AS BIGINT)"


def probe_rows(spark, d):
    rows = planted.load(spark, d, "probes")
    return rows.select("probe_id", "model", "ts", "prompt", canary.output_hash(F.col("output_text")).alias("output_hash"), canary.log2_bucket(F.col("length")).alias("length_bucket"), "stop_reason", canary.log2_bucket(F.col("latency_ms")).alias("latency_bucket"))


def baseline_rows(spark):
    return spark.range(5).select(F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"), F.sha2(F.concat(F.lit("answer "), F.col("id").cast("string")), 256).alias("output_hash"), F.lit(5).alias("length_bucket"), F.lit("end_turn").alias("stop_reason"), F.lit(8).alias("latency_bucket"))


SCORED = f"""{PROBES}, x AS (SELECT probe_id, model, ts, prompt, sha256(lower(trim(output_text))) AS oh, {BUCKET.format('length')} AS lb, stop_reason, {BUCKET.format('latency_ms')} AS tb FROM probes),
  scored AS (SELECT probe_id, model, ts, prompt, (CASE WHEN oh = sha256('answer ' || right(prompt, 1)) THEN 1.0 ELSE 0 END + CASE abs(lb - 5) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END
    + CASE WHEN stop_reason = 'end_turn' THEN 1.0 ELSE 0 END + CASE abs(tb - 8) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0 END)::DOUBLE / 4 AS composite FROM x WHERE prompt <> 'prompt 5')"""


@query("probe_features", f"{SCORED} SELECT probe_id, oh AS output_hash, lb AS length_bucket, tb AS latency_bucket FROM x")
def probe_features(spark, d):
    return probe_rows(spark, d).select("probe_id", "output_hash", "length_bucket", "latency_bucket")


@query("probe_scores", f"{SCORED} SELECT probe_id, composite FROM scored")
def probe_scores(spark, d):
    return canary.score_probes(probe_rows(spark, d), baseline_rows(spark)).select("probe_id", F.round("composite", 9).alias("composite"))


@query("probe_errors", f"{PROBES} SELECT probe_id FROM probes WHERE prompt = 'prompt 5'")
def probe_errors(spark, d):
    return canary.unknown_prompts(probe_rows(spark, d), baseline_rows(spark)).select("probe_id")


HEALTH = "CASE WHEN {0} >= 0.8 THEN 'healthy' WHEN {0} < 0.5 THEN 'degraded' ELSE 'unknown' END"


@query("canary_health", f"{SCORED}, w AS (SELECT probe_id, avg(composite) OVER (PARTITION BY model ORDER BY ts, probe_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM scored) SELECT probe_id, round(m, 6) AS mean_score, {HEALTH.format('round(m, 9)')} AS health FROM w")
def canary_health(spark, d):
    scored = canary.score_probes(probe_rows(spark, d), baseline_rows(spark))
    out = canary.rolling_health(scored, "model", ("ts", "probe_id"))
    return out.select("probe_id", F.round("mean_score", 6).alias("mean_score"), canary.health(F.round("mean_score", 9)).alias("health"))


@query("canary_status", f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, probe_id DESC) AS n FROM scored) SELECT model, {HEALTH.format('avg(composite)')} AS health, count(*) AS probes_in_window, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_probe_at FROM r WHERE n <= 8 GROUP BY 1")
def canary_status(spark, d):
    out = canary.status(canary.score_probes(probe_rows(spark, d), baseline_rows(spark)), "model", ("ts", "probe_id"), "ts")
    return out.withColumn("last_probe_at", F.date_format("last_probe_at", "yyyy-MM-dd HH:mm:ss"))


@query("prompt_rotation", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, p AS prompt, cast(row_number() OVER (PARTITION BY d ORDER BY sha256(strftime(d, '%Y-%m-%d') || p)) - 1 AS BIGINT) AS turn, date_diff('day', DATE '0001-01-01', d) + 1 AS seed FROM (SELECT DISTINCT cast(ts AS DATE) AS d, cast(ts AS DATE) AS ts FROM events), (SELECT 'prompt ' || i AS p FROM range(5) r(i))")
def prompt_rotation(spark, d):
    days = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day"))
    out = canary.rotation(days, baseline_rows(spark))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "prompt", "turn", canary.daily_seed(F.col("day")).cast("long").alias("seed"))


@query("log2_bucket", "SELECT event_id, cast(length(bin(greatest(event_id * event_id * 1000003 - 5, 1))) - 1 AS BIGINT) AS bucket FROM events")
def log2_bucket(spark, d):
    whole = F.col("event_id").cast("decimal(19,0)")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", canary.log2_scaled(whole * whole, 1000003, -5).alias("bucket"))


@query("metrics_counters", "SELECT 'cloakline_requests_total' AS metric, event_type AS label, count(*)::DOUBLE AS value, 'cloakline_requests_total{status=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_counters(spark, d):
    one = metrics.counters(spark.read.parquet(f"{d}/events.parquet"), "cloakline_requests_total", "event_type")
    return one.join(metrics.exposition(one, "status").select("line", F.regexp_extract("line", '"(.*)"', 1).alias("label")), "label").select("metric", "label", "value", "line")


LE = ", ".join(f"({b!r}, '{b}')" for b in metrics.DEEP_BUCKETS)


@query("latency_histogram", f"SELECT event_type, t.le, count(*) FILTER (WHERE abs(value) <= b) AS cumulative, count(*) AS count FROM events, (VALUES {LE}, ('infinity'::DOUBLE, '+Inf')) t(b, le) GROUP BY 1, 2")
def latency_histogram(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("s", F.abs("value"))
    return metrics.histogram(rows, "s", metrics.DEEP_BUCKETS, ("event_type",)).drop("sum")


@query("metrics_gauge", "SELECT 'active' AS metric, arg_max(value, event_id) AS value FROM events")
def metrics_gauge(spark, d):
    return metrics.gauge(spark.read.parquet(f"{d}/events.parquet"), "active", "value", ("event_id",))


@query("silent_fallback", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS attempted, count(*) FILTER (WHERE event_type = 'click') AS succeeded, count(*) FILTER (WHERE event_type <> 'view') - count(*) FILTER (WHERE event_type = 'click') AS silent FROM events GROUP BY 1")
def silent_fallback(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("a", F.col("event_type") != "view").withColumn("u", F.col("event_type") == "click")
    return metrics.silent_fallback(rows, "a", "u", ("user_id",))


def labelled_pairs(spark, d):
    """Detected spans against labels: shifted, mistyped, missing and extra ones."""
    rows = planted.load(spark, d, "eval_labels")

    def of(type_, start, end, implicit):
        return ty.span(F.lit(type_), start, end, F.lit(""), F.lit(1.0), F.lit(implicit))

    zero = F.lit(0)
    expected = F.array(of("EMAIL", zero, F.lit(10), False), of("EMAIL", F.lit(10), F.lit(20), False), of("PERSON", F.lit(30), F.lit(40), True))
    detected = F.array(of("EMAIL", F.col("shift"), F.col("shift") + 11, False), of("EMAIL", F.lit(5), F.lit(15), False), F.when(F.col("kind") == 0, of("PHONE", F.lit(30), F.lit(40), True)).otherwise(of("PERSON", F.col("kind") * 10, F.col("kind") * 10 + 5, True)))
    return rows.select("id", expected.alias("expected"), detected.alias("detected"))


EVAL = f"""WITH RECURSIVE {s.planted_cte('eval_labels')},
  e AS (SELECT id, j, t, a, b, imp FROM eval_labels, (VALUES (0, 'EMAIL', 0, 10, false), (1, 'EMAIL', 10, 20, false), (2, 'PERSON', 30, 40, true)) v(j, t, a, b, imp)),
  dd AS (SELECT id, 0 AS i, 'EMAIL' AS t, shift AS a, shift + 11 AS b, false AS imp FROM eval_labels UNION ALL SELECT id, 1, 'EMAIL', 5, 15, false FROM eval_labels
    UNION ALL SELECT id, 2, CASE WHEN kind = 0 THEN 'PHONE' ELSE 'PERSON' END, CASE WHEN kind = 0 THEN 30 ELSE kind * 10 END, CASE WHEN kind = 0 THEN 40 ELSE kind * 10 + 5 END, true FROM eval_labels),
  sp AS (SELECT id, split FROM eval_labels, (VALUES ('overall'), ('explicit'), ('implicit')) v(split)),
  f AS (SELECT id, split, 0 AS i, CAST([] AS INTEGER[]) AS taken FROM sp
    UNION ALL SELECT f.id, f.split, f.i + 1, CASE WHEN x.j IS NULL THEN f.taken ELSE list_append(f.taken, x.j) END FROM f JOIN dd ON dd.id = f.id AND dd.i = f.i
      LEFT JOIN LATERAL (SELECT min(e.j) AS j FROM e WHERE e.id = f.id AND e.t = dd.t AND e.a < dd.b AND dd.a < e.b AND NOT list_contains(f.taken, e.j)
        AND (f.split = 'overall' OR (f.split = 'implicit') = e.imp) AND (f.split = 'overall' OR (f.split = 'implicit') = dd.imp)) x ON true),
  cnt AS (SELECT id, split, cast(len(taken) AS BIGINT) AS tp, CASE split WHEN 'overall' THEN 3 WHEN 'explicit' THEN 2 ELSE 1 END - len(taken) AS fp FROM f WHERE i = 3)"""


@query("eval_match", f"{EVAL} SELECT id, split, tp, cast(fp AS BIGINT) AS fp, cast(fp AS BIGINT) AS fn FROM cnt")
def eval_match(spark, d):
    return evaluate.entry_counts(labelled_pairs(spark, d))


REPORT = f"""{EVAL}, rep AS (SELECT split, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fp)::BIGINT AS fn FROM cnt GROUP BY 1),
  pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS p FROM rep)"""


@query("eval_report", f"{REPORT} SELECT split, tp, fp, fn, round(p, 6) AS precision, round(p, 6) AS recall, round(CASE WHEN p = 0 THEN 0.0 ELSE p END, 6) AS f1 FROM pr")
def eval_report(spark, d):
    out = evaluate.report(evaluate.entry_counts(labelled_pairs(spark, d)))
    return out.select("split", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("target_gate", f"{REPORT} SELECT split, round(p, 6) AS recall, CASE WHEN p < 0.6 THEN 'kill' WHEN p >= CASE split WHEN 'explicit' THEN 0.9 ELSE 0.7 END THEN 'pass' ELSE 'miss' END AS verdict FROM pr WHERE split <> 'overall'")
def target_gate(spark, d):
    return evaluate.targets(evaluate.report(evaluate.entry_counts(labelled_pairs(spark, d)))).withColumn("recall", F.round("recall", 6))


@query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def latency_summary(spark, d):
    out = evaluate.latency_summary(spark.read.parquet(f"{d}/events.parquet"), "value", by=("event_type",))
    return out.withColumn("mean", F.round("mean", 6))


@query("dataset_totals", f"WITH {s.planted_cte('eval_labels')} SELECT count(*) AS entries, 3 * count(*) AS spans, 2 * count(*) AS explicit, count(*) AS implicit FROM eval_labels")
def dataset_totals(spark, d):
    return evaluate.dataset_totals(labelled_pairs(spark, d), "expected")


@query("locate_spans", "SELECT cast(c_custkey AS BIGINT) AS id, cast(instr(t, c_name) + length(c_name) + 4 AS BIGINT) AS start FROM (SELECT c_custkey, c_name, c_name || ' and ' || c_name AS t FROM customer)")
def locate_spans(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.concat("c_name", F.lit(" and "), "c_name").alias("t"), "c_name")
    wanted = F.array(F.struct(F.col("c_name").alias("text"), F.lit("PERSON").alias("type"), F.lit(2).alias("occurrence"), F.lit(False).alias("implicit")))
    return rows.select("id", F.explode(files.locate_spans(F.col("t"), wanted)).alias("s")).select("id", "s.start")


ENDPOINTS = """known AS (SELECT 'h' || n_nationkey % 5 AS host, '10.0.0.' || n_nationkey AS ip, 443 AS port FROM nation), fresh AS (SELECT 'h' || n_nationkey % 4 AS host, '10.0.0.' || n_nationkey AS ip, 443 AS port FROM nation WHERE n_nationkey % 3 = 0)"""


def endpoints(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    of = lambda k: (F.concat(F.lit("h"), (F.col("n_nationkey") % k).cast("string")).alias("host"), F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip"), F.lit(443).alias("port"))
    return n.select(*of(5)), n.filter("n_nationkey % 3 = 0").select(*of(4))


@query("endpoint_diff", f"WITH {ENDPOINTS} SELECT host, ip, cast(port AS BIGINT) AS port FROM known WHERE host IN (SELECT host FROM fresh) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.host = known.host AND f.ip = known.ip)")
def endpoint_diff(spark, d):
    return network.stale(*endpoints(spark, d))


@query("endpoint_refresh", f"WITH {ENDPOINTS}, gone AS (SELECT host, ip FROM known WHERE host IN (SELECT host FROM fresh) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.host = known.host AND f.ip = known.ip)) SELECT DISTINCT host, ip, 443::BIGINT AS port, (167772160 + cast(split_part(ip, '.', 4) AS BIGINT)) AS number FROM (SELECT host, ip FROM known UNION SELECT host, ip FROM fresh) a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.host = a.host AND g.ip = a.ip)")
def endpoint_refresh(spark, d):
    return network.refreshed(*endpoints(spark, d)).withColumn("number", network.ipv4_number(F.col("ip")))


@query("label_maps", f"SELECT t AS name, CASE WHEN upper(t) = 'ORG' THEN 'ORGANIZATION' WHEN upper(t) IN ('PERSON', 'EMAIL') THEN upper(t) ELSE 'PERSON' END AS rule_type, CASE WHEN upper(t) IN ('PERSON', 'EMAIL') THEN upper(t) END AS model_type, CASE WHEN t IN ('PERSON', 'EMAIL') THEN t END AS label_type FROM (VALUES ('org'), ('PERSON'), ('Email'), ('planet'), ('EMAIL')) v(t)")
def label_maps(spark, d):
    rows = spark.createDataFrame([("org",), ("PERSON",), ("Email",), ("planet",), ("EMAIL",)], "name string")
    return rows.select("name", ty.parse_rule_type(F.col("name")).alias("rule_type"), ty.parse_model_type(F.col("name")).alias("model_type"), ty.parse_label_type(F.col("name")).alias("label_type"))


@query("small_functions", "SELECT cast(c_custkey AS BIGINT) AS id, left(h, 8) || '...' || right(h, 8) AS short, CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END AS excerpt, CASE c_custkey % 3 WHEN 0 THEN 7200 WHEN 1 THEN 172800 ELSE 45 END::BIGINT AS seconds FROM (SELECT c_custkey, sha256(c_name) AS h, repeat(c_name || ' ', 1 + c_custkey % 5) AS t FROM customer)")
def small_functions(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    duration = F.when(F.col("c_custkey") % 3 == 0, "2h").when(F.col("c_custkey") % 3 == 1, "2d").otherwise("45")
    text = F.expr("repeat(c_name || ' ', 1 + cast(c_custkey % 5 as int))")
    return rows.select(F.col("c_custkey").cast("long").alias("id"), tx.short_hash(F.sha2("c_name", 256)).alias("short"), tx.excerpt(text).alias("excerpt"), files.duration_seconds(duration).alias("seconds"))


