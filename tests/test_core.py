"""Operators on literal rows, against plain Python."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakline.functions import chat
from cloakline.functions import text as tx
from cloakline.functions import types as ty
from cloakline.operators import audit, detect, evaluate, network, requests, sessions, spans
from cloakline.sources import files
from cloakline.streaming import streams

SPAN = ty.SPAN.simpleString()


def one(spark, value, expr, schema="text string"):
    return spark.createDataFrame([value], schema).select(expr.alias("x")).first().x


def test_offsets_with_unicode(spark):
    texts = ["日 a@b.co é c.d@e.org😀 555-123-4567", "", "٣٣٣-٢٢-١١١١ and 123-45-6789", "x" * 5000 + " u@v.io"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", detect.regex_detect(F.col("text")).alias("s")).collect()
    for r in rows:
        for s in r.s:
            assert texts[r.id][s.start : s.end] == s.text
    assert [s.type for s in rows[0].s] == ["EMAIL", "EMAIL", "PHONE"]
    assert [s.type for s in rows[2].s] == ["SSN", "SSN"]
    assert one(spark, (texts[0],), tx.byte_offset(F.col("text"), F.lit(4))) == len(texts[0][:4].encode())


def greedy(found, key):
    order = sorted(range(len(found)), key=lambda i: (key(found[i]), i))
    kept = []
    for i in order:
        s = found[i]
        if not any(k[0] <= s[0] and s[1] <= k[1] for _, k in kept):
            kept.append((i, s))
    return [s for _, s in sorted(kept, key=lambda x: (x[1][0], x[0]))]


def test_merge_is_greedy(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        found = []
        for _ in range(rng.randrange(0, 9)):
            a = rng.randrange(20)
            found.append((a, a + rng.randrange(1, 8)))
        rows.append((i, [("PERSON", a, b, "", 1.0, False) for a, b in found]))
    frame = spark.createDataFrame(rows, f"id int, s array<{SPAN}>")
    for r in frame.select("s", detect.merge(F.col("s")).alias("m")).collect():
        assert [(x.start, x.end) for x in r.m] == greedy([(x.start, x.end) for x in r.s], lambda s: s[0] - s[1])


def test_redact_and_restore(spark):
    rng = random.Random(2)
    names = ["Ann Bø", "$1\\E[x]", "日本", "a.b"]
    rows = []
    for i in range(60):
        text, found = "", []
        for _ in range(rng.randrange(5)):
            text += rng.choice(["", "pre ", "[EMAIL_zz] "])
            n = rng.choice(names)
            found.append((rng.choice(["PERSON", "ORGANIZATION"]), len(text), len(text) + len(n), n, 0.9, False))
            text += n + rng.choice(["", " and "])
        rows.append((i, "s", 0, text, found))
    frame = spark.createDataFrame(rows, f"id int, session_id string, message_idx int, text string, spans array<{SPAN}>")
    out = spans.anonymize(frame, key=b"k" * 32)
    originals = F.map_from_entries(F.transform("mappings", lambda m: F.struct(m["placeholder_text"], m["original_text"])))
    for r in out.select("text", "spans", "redacted", "mappings", spans.restore(F.col("redacted"), originals).alias("back")).collect():
        assert r.back == r.text
        assert {m.original_text for m in r.mappings} == {s.text for s in r.spans}
        assert not any(s.text in r.redacted for s in r.spans if len(s.text) > 3)


def test_overlap_becomes_one_placeholder(spark):
    text = "call (555) 123-4567.foo@x.com now"
    rows = spark.createDataFrame([("s", 0, text)], "session_id string, message_idx int, text string").withColumn("spans", detect.regex_detect(F.col("text")))
    r = spans.anonymize(rows).first()
    assert re.fullmatch(r"call \(\[(PHONE|EMAIL)_[0-9a-f]{8}\] now", r.redacted) and len(r.mappings) == 1


def test_relocation_claims_ranges(spark):
    text = "ab ab ab"
    found = [("PERSON", 0, 2, "ab", 1.0, False), ("PERSON", 99, 101, "ab", 1.0, False), ("PERSON", 1, 3, "ab", 1.0, False), ("PERSON", 5, 6, "zz", 1.0, False), ("PERSON", 0, 2, "ab", 1.0, True)]
    got = one(spark, (text, found), spans.relocate(F.col("text"), F.col("s")), f"text string, s array<{SPAN}>")
    assert [(s.start, s.end) for s in got] == [(0, 2), (3, 5), (6, 8), (0, 2)]


def test_code_blocks(spark):
    for text in ["a```b```c", "```x```foo@bar.com", "a```b", "``````", "none", "```a``` ```b``` ```"]:
        c = one(spark, (text,), tx.strip_code(F.col("text")))
        assert one(spark, (c.text, c.blocks), tx.restore_code(F.col("t"), F.col("b")), "t string, b array<string>") == text
    got = one(spark, ("```x@y.zz```foo@bar.com",), spans.detect_outside_code(F.col("text"), detect.regex_detect))
    assert [s.text for s in got] == ["foo@bar.com"] and got[0].start == 12


def test_score_and_labels(spark):
    found = [("PERSON", 0, 1, "x", 0.9, True), ("CREDENTIAL", 2, 3, "y", 1.0, False)]
    assert one(spark, (found,), spans.privacy_score(F.col("s")), f"s array<{SPAN}>") == int(100 - 13.5 - 20)
    assert one(spark, (found * 9,), spans.privacy_score(F.col("s")), f"s array<{SPAN}>") == 0
    assert one(spark, (90,), ty.score_header(F.col("n")), "n int") == "90 (LOW)"
    with pytest.raises(Exception, match="unknown stored type"):
        one(spark, ("ORGANIZATION",), ty.parse_stored_type(F.col("text")))


def test_hmac_and_merkle(spark):
    key = b"0123456789abcdef" * 2
    assert one(spark, ("mé",), spans.hmac_sha256(key, F.col("text"))) == hmac.new(key, "mé".encode(), "sha256").hexdigest()
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        level = leaves
        while len(level) > 1:
            level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert one(spark, ([x.hex() for x in leaves],), audit.merkle_root(F.col("h")), "h array<string>") == level[0].hex()


def test_tampering_any_field_breaks_a_chain(spark):
    rows = [("c", i, f"2024-01-0{i + 1}T00:00:00Z", "s", i, 90) for i in range(4)]
    built = audit.build_chains(spark.createDataFrame(rows, "chain_id string, pos long, timestamp string, session_id string, pii_spans_detected long, privacy_score long").withColumn("hash_recipe", F.lit(audit.V2)))
    assert audit.verify_chains(built).first().valid
    first = built.orderBy("pos").first().asDict()
    want = {k: v for k, v in first.items() if k in {n for n, *_ in audit.FIELDS} and k != "hash"}
    assert first["hash"] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for name, value in [("session_id", "x"), ("privacy_score", 1), ("timestamp", "z"), ("prev_hash", "0" * 63 + "1"), ("hash", "0" * 64), ("rekor_uuid", "u"), ("hash_recipe", "audit-v1"), ("hash_recipe", "other")]:
        forged = built.withColumn(name, F.when(F.col("pos") == 2, F.lit(value)).otherwise(F.col(name)))
        r = audit.verify_chains(forged).first()
        assert not r.valid and r.first_bad == 3, name


def test_greedy_matching(spark):
    rng = random.Random(4)

    def spans_of(n):
        out = []
        for _ in range(n):
            a = rng.randrange(15)
            out.append((rng.choice(["PERSON", "EMAIL"]), a, a + rng.randrange(1, 6), "", 1.0, rng.random() < 0.3))
        return out

    rows = [(i, spans_of(rng.randrange(5)), spans_of(rng.randrange(5))) for i in range(120)]
    frame = spark.createDataFrame(rows, f"id int, detected array<{SPAN}>, expected array<{SPAN}>")
    for r in frame.select("detected", "expected", evaluate.matches(F.col("detected"), F.col("expected")).alias("tp")).collect():
        taken = set()
        for d in r.detected:
            for j, e in enumerate(r.expected):
                if j not in taken and e.type == d.type and e.start < d.end and d.start < e.end:
                    taken.add(j)
                    break
        assert r.tp == len(taken)


def test_request_flow(spark):
    body = json.dumps({"model": "m", "n": 1.5, "messages": [{"role": "user", "content": 'mail "a@b.co"\nnow', "x": [1]}, {"role": "user", "content": "plain"}]})
    rows = spark.createDataFrame([(1, "s", body), (2, "s", "{}"), (3, "s", '{"messages":[{"content":[1]}]}')], "request_id long, session_id string, body string")
    out = {r.request_id: r for r in requests.anonymize_requests(rows).collect()}
    new = json.loads(out[1].new_body)
    token = re.search(r"\[EMAIL_[0-9a-f]{8}\]", new["messages"][0]["content"])[0]
    assert new["messages"][0]["content"] == f'mail "{token}"\nnow' and new["messages"][0]["x"] == [1] and new["n"] == 1.5 and new["messages"][1]["content"] == "plain"
    assert (out[1].privacy_score, out[2].error_kind, out[2].status, out[3].status) == (88, "bad_request", 400, 415)
    assert requests.anonymize_requests(rows, strict=False).filter("request_id = 3").first().status == 200


def test_replies(spark):
    good = '[{"type":"Person","start":0,"end":1,"text":"x","confidence":0.5}]'
    for reply, error, n in [(good, None, 1), ("```json\n" + good + "\n```", None, 1), ("  ", "EmptyModelResponse", None), ("{}", "ModelOutputParseError", None), ("[1]", "ModelOutputParseError", None), ("[]", None, 0)]:
        got = one(spark, (reply,), detect.parse_reply(F.col("text")))
        assert got.error == error and (None if got.spans is None else len(got.spans)) == n, reply
    assert len(one(spark, ('noise [{"type":"PERSON","start":"1","end":2},{"type":"x"},3] tail',), detect.parse_reply_leniently(F.col("text")))) == 1


def test_model_is_asked_only_for_escalated_rows(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "word " * 300)], "id long, text string")
    need = detect.escalated(rows, fast_reply=None)
    assert [r.id for r in need.collect()] == [2]
    out = detect.with_model(rows, lambda texts: ["[]"] * len(texts), reply="deep_reply", only=F.col("id") == 2)
    done = {r.id: r for r in detect.tiers(out, "auto", fast_reply=None, deep_reply="deep_reply").collect()}
    assert done[2].deep_scan_used and not done[1].deep_attempted


def test_sessions_and_collisions(spark):
    store = spark.createDataFrame([("s", "[ORG_0000000a]", "x", "ORG"), ("s", "[ORG_0000000a]", "y", "ORG"), ("t", "[ORG_0000000a]", "z", "ORG")], "session_id string, placeholder_text string, original_text string, pii_type string")
    assert [r.session_id for r in sessions.collisions(store).collect()] == ["s"]
    rows = spark.createDataFrame([("t", "a [ORG_0000000a] [ORG_0000000b]"), ("u", "[ORG_0000000a]")], "session_id string, text string")
    got = {r.session_id: r for r in sessions.deanonymize(rows, store).collect()}
    assert got["t"].restored == "a z [ORG_0000000b]" and got["t"].placeholders_replaced == 1 and not got["u"].found


def test_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"prompt":"p","spans":[{"type":"EMAIL","start":0,"end":1,"text":"p","confidence":1.0}]}\n\n')
    assert files.labelled(spark, str(tmp_path / "b.jsonl")).first().spans[0].implicit is False
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        files.labelled(spark, str(tmp_path / "bad.jsonl")).collect()
    rules = files.rules_from_text('{"rules":[{"name":"a","type":"org","patterns":["x+","("],"keywords":["","k"]},{"name":"b","type":"planet"}]}')
    assert [(r.type, r.patterns, r.keywords, r.confidence) for r in rules] == [("ORGANIZATION", ["x+"], ["k"], 0.8), ("PERSON", [], [], 0.8)]
    assert files.routes_from_text(spark, "{nonsense").count() == 0
    entries = spark.createDataFrame([("c", i, f"2024-01-0{i // 2 + 1}T00:00:0{i}Z", "s", 0, 100) for i in range(4)], "chain_id string, pos long, timestamp string, session_id string, pii_spans_detected long, privacy_score long")
    files.write_audit(audit.build_chains(entries).withColumn("day", F.substring("timestamp", 1, 10)), str(tmp_path / "log"))
    back = spark.read.schema(audit.DDL).json(str(tmp_path / "log"))
    assert audit.verify_chains(back.withColumn("chain_id", F.lit(1)), order=("timestamp",)).first().valid
    with pytest.raises(ValueError):
        files.Options.from_env({"CLOAKLINE_SCAN_MODE": "odd"})
    assert files.Options.from_env({"CLOAKLINE_SESSION_TTL_SECONDS": "2h"}).session_ttl_seconds == 7200


def test_baseline_round_trip(spark, tmp_path):
    prints = spark.createDataFrame([("m", "t", "v", "p1", "h", 1, "end_turn", 8)], "model_label string, created_at string, engine_version string, prompt string, output_hash string, length_bucket int, stop_reason string, latency_bucket int")
    files.write_baseline(prints, str(tmp_path / "base"))
    assert files.baseline(spark, str(tmp_path / "base")).first().asDict() == {"model_label": "m", "prompt": "p1", "output_hash": "h", "length_bucket": 1, "stop_reason": "end_turn", "latency_bucket": 8}


def test_addresses(spark):
    assert one(spark, ("10.0.0.1",), network.ipv4_number(F.col("text"))) == 167772161
    assert one(spark, ("300.0.0.1",), network.ipv4_number(F.col("text"))) is None
    assert one(spark, ("2001:db8::1",), network.ipv6_words(F.col("text"))) == [0x20010DB8, 0, 0, 1]


def test_events_split_inside_characters(spark):
    data = 'data: {"é":1}\n\ndata: ü'.encode()
    rows = [("a", i, bytes([b])) for i, b in enumerate(data)] + [("b", 0, b"\xff\n\n")]
    frame = spark.createDataFrame(rows, "stream_id string, seq int, chunk binary")
    got = {(r.stream_id, r.idx): r.event for r in streams.reassemble(frame, with_tail=True).collect()}
    assert got == {("a", 0): 'data: {"é":1}\n\n', ("a", 1): "data: ü", ("b", 0): "�\n\n"}
    assert one(spark, ("data: [DONE]",), chat.event_line_kind(F.col("text"))) == "done"
