"""Texts with known personal data, built from the driver's tables by the same SQL text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "cast(c_custkey as string)"
PHONE = "'555-' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-' || lpad(cast(c_custkey % 10000 as string), 4, '0')"
#: name -> (tables, SQL)
SETS = {
    "planted": (
        ("customer",),
        f"""select cast(c_custkey as bigint) as id, case c_custkey % 9
          when 0 then 'Nothing to see about ' || c_mktsegment || ' today.'
          when 1 then 'Write to user' || {KEY} || '@mail' || cast(c_custkey % 5 as string) || '.example.com or call ' || {PHONE} || '.'
          when 2 then 'SSN ' || lpad(cast(c_custkey % 900 as string), 3, '0') || '-' || lpad(cast(c_custkey % 90 as string), 2, '0') || '-' || lpad(cast(c_custkey as string), 4, '0') || ' and again user' || {KEY} || '@a.org, user' || {KEY} || '@a.org'
          when 3 then 'fetch https://u' || {KEY} || ':p' || {KEY} || '@host' || {KEY} || '.example.com/x?y=1 now'
          when 4 then 'use sk-' || lpad({KEY}, 12, 'a') || ' or token_' || lpad({KEY}, 9, 'Z') || '; call (555) 867-' || lpad(cast(c_custkey % 10000 as string), 4, '0')
          when 5 then 'call ' || {PHONE} || '.foo@x.com now, or ' || {PHONE}
          when 6 then 'code ```x = "user' || {KEY} || '@in.code"``` then user' || {KEY} || '@out.org and an open ``` fence'
          when 7 then repeat('long words go on and on ', 36) || c_name
          else c_name || ' of ' || c_mktsegment || ' met Project Heron at Campus North; Project  Heron, not Campus Northern' end as text
        from customer""",
    ),
    "model_spans": (
        ("customer",),
        f"""select cast(c_custkey as bigint) as id, c_name || ' lives in Oslo' as text, case c_custkey % 8
          when 0 then '[{{"type":"PERSON","start":0,"end":18,"text":"' || c_name || '","confidence":0.9}},{{"type":"location","start":28,"end":32,"text":"Oslo","confidence":0.5,"implicit":true}}]'
          when 1 then '```json\n[{{"type":"person","start":0,"end":18,"text":"' || c_name || '","confidence":0.75}}]\n```'
          when 2 then ''
          when 3 then '[{{"type":"PERSON","start":1,"end":19,"text":"' || c_name || '","confidence":0.65}}]'
          when 4 then '[{{"type":"PLANET","start":0,"end":4,"text":"Mars","confidence":1.0}}]'
          when 5 then 'not json at all'
          when 6 then '[{{"type":"PERSON","start":0}}]'
          else '  []  ' end as reply
        from customer""",
    ),
    "requests": (
        ("orders",),
        """select cast(o_orderkey as bigint) as request_id, 's' || cast(o_custkey % 50 as string) as session_id, case o_orderkey % 7
          when 0 then ''
          when 1 then '{"model":"m","messages":[{"role":"user","content":"call 555-' || lpad(cast(o_custkey % 1000 as string), 3, '0') || '-1234 or mail o' || cast(o_orderkey as string) || '@x.com"}],"stream":true}'
          when 2 then '{"messages":[{"role":"system","content":"be brief"},{"role":"user","content":"key sk-' || lpad(cast(o_orderkey as string), 16, 'b') || ' and sk-' || lpad(cast(o_orderkey as string), 17, 'c') || '"}]}'
          when 3 then '{"model":"m"}'
          when 4 then '{"messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}]}'
          when 5 then 'oops'
          else '{"messages":[{"role":"user","content":"plain"},{"role":"assistant","content":"answer"}]}' end as body
        from orders""",
    ),
    "probes": (
        ("events",),
        """select event_id as probe_id, cast(user_id % 20 as bigint) as model, ts, 'prompt ' || cast(event_id % 6 as string) as prompt,
          case when event_id % 11 = 0 then 'other' else 'answer ' || cast(event_id % 6 as string) end as output_text,
          cast(floor(abs(value)) as bigint) as length, case event_type when 'error' then 'max_tokens' else 'end_turn' end as stop_reason,
          cast(floor(abs(value) * 10) as bigint) as latency_ms from events""",
    ),
    "audit": (
        ("orders",),
        """select cast(o_custkey % 200 as bigint) as chain_id, cast(o_orderkey as bigint) as pos, 'c' || cast(o_custkey as string) as session_id,
          '2024-01-01T00:00:' || lpad(cast(o_orderkey % 60 as string), 2, '0') || 'Z' as "timestamp",
          cast(o_orderkey % 5 as bigint) as pii_spans_detected, cast(100 - o_orderkey % 80 as bigint) as privacy_score, 'r' || cast(o_orderkey as string) as request_id,
          case when o_orderkey % 4 = 0 then 'audit-v1' else 'audit-v2-canonical-json' end as hash_recipe
        from orders""",
    ),
    "eval_labels": (
        ("customer",),
        """select cast(c_custkey as bigint) as id, cast(10 * (c_custkey % 3) as bigint) as shift, cast(c_custkey % 5 as bigint) as kind from customer""",
    ),
}


def spark_sql(name: str) -> str:
    return SETS[name][1].replace('"timestamp"', "`timestamp`").replace("\\n", "\\n")


def duck_sql(name: str) -> str:
    return SETS[name][1].replace("\n[{", "\n[{")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, _ = SETS[name]
    sql = spark_sql(name).replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"from {t}", "from {" + t + "}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
