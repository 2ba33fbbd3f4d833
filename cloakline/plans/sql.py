"""SQL building blocks of the oracles: what the operators compute, written for a relational engine."""

from __future__ import annotations

from cloakline.functions import types as ty
from cloakline.operators.detect import PATTERNS
from cloakline.operators.spans import TOKEN
from cloakline.plans import planted


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(value: str, cases: dict, default: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in cases.items()) + f" ELSE {default} END"


PREFIX = {t: p for t, p, *_ in ty.PII_TYPES}
EXPLICIT = {t: e for t, _, e, _ in ty.PII_TYPES}
IMPLICIT = {t: i for t, _, _, i in ty.PII_TYPES}
WEIGHT = f"CASE WHEN implicit THEN {case('type', IMPLICIT)} ELSE {case('type', EXPLICIT)} END"
CLASS = "CASE WHEN {0} >= 90 THEN 'LOW' WHEN {0} >= 50 THEN 'MEDIUM' ELSE 'HIGH' END"


def matches(source: str, pattern: str, keep: str = "id") -> str:
    """keep, i, start, "end", text of all matches of a pattern in source's text."""
    return f"""
      SELECT {keep}, i, start, start + length(hit) AS "end", hit AS text FROM (
        SELECT {keep}, i, h[i] AS hit,
          cast(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
          SELECT {keep}, regexp_extract_all(text, {quote(pattern)}) AS h, string_split_regex(text, {quote(pattern)}) AS g FROM {source})))"""


def found(source: str, keep: str = "id") -> str:
    """CTE raw: every match of every pattern; found: sorted by start, contained ones dropped."""
    parts = " UNION ALL ".join(f"SELECT *, {n} AS pi, '{t}' AS type FROM ({matches(source, p, keep)})" for n, (t, p) in enumerate(PATTERNS.values()))
    return f"""
    raw AS ({parts}),
    found AS (SELECT r.*, 1.0::DOUBLE AS confidence, false AS implicit FROM raw r WHERE NOT EXISTS (
      SELECT 1 FROM raw e WHERE e.id = r.id AND (e.start, e.pi, e.i) < (r.start, r.pi, r.i) AND e.start <= r.start AND r."end" <= e."end"))"""


def clusters(spans: str = "found") -> str:
    """CTE cluster: partly overlapping spans joined, with the type of the longest."""
    return f"""
    marked AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY id ORDER BY start, pi, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {spans}),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start, pi, i ROWS UNBOUNDED PRECEDING) AS c FROM marked),
    cluster AS (SELECT id, c, min(start) AS start, max("end") AS "end", arg_max(type, ("end" - start) * 100000 - start) AS type FROM numbered GROUP BY id, c)"""


def redacted(source: str) -> str:
    """CTEs named and done: id, redacted text and the pieces, with session 's' and message 0."""
    return f"""
    piece AS (SELECT c.*, substr(p.text, cast(c.start + 1 AS BIGINT), cast(c."end" - c.start AS BIGINT)) AS original, p.text AS whole FROM cluster c JOIN {source} p USING (id)),
    named AS (SELECT *, '[' || {case("last_value(type) OVER (PARTITION BY id, original ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", PREFIX)}
        || '_' || left(sha256('s' || cast(id AS VARCHAR) || ':0:' || original), 8) || ']' AS token,
      coalesce(lag("end") OVER (PARTITION BY id ORDER BY start), 0) AS before,
      lead(start) OVER (PARTITION BY id ORDER BY start) AS after FROM piece),
    done AS (SELECT id, string_agg(substr(whole, cast(before + 1 AS BIGINT), cast(start - before AS BIGINT)) || token
        || CASE WHEN after IS NULL THEN substr(whole, cast("end" + 1 AS BIGINT)) ELSE '' END, '' ORDER BY start) AS redacted FROM named GROUP BY id)"""


def planted_cte(name: str, alias: str | None = None) -> str:
    return f"{alias or name} AS ({planted.duck_sql(name)})"


SCORE = f"cast(least(100, floor(greatest(0.0, 100.0 - coalesce(sum(({WEIGHT}) * confidence), 0.0)))) AS BIGINT)"
TOKEN_SQL = quote(TOKEN)
