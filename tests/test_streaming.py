"""Streaming operators over several micro-batches give their batch twins' rows."""

import json
import time

from pyspark.sql import functions as F

from cloakline.streaming import streams


def write(path, n, rows):
    (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, source, schema, build, tmp_path, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def run_until(spark, source, schema, build, tmp_path, name, done, seconds=90):
    """For queries with processing-time timeouts, which have batches without end: stop once done(rows)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    try:
        until = time.time() + seconds
        while time.time() < until and not done(rows := spark.table(name).collect()):
            time.sleep(0.5)
        return rows
    finally:
        q.stop()


def test_restore_across_batches(spark, tmp_path):
    source = tmp_path / "tokens"
    source.mkdir()
    known = {"[PERSON_0000000a]": "Ann", "[ORG_0000000b]": "Böe"}
    texts = {"s1": "hi [PERSON_0000000a], [x] [ORG_0000000b]!", "s2": "[PERSON_0000000a][PERSON_ffffffff] [unfinished é"}
    pieces = {k: [t[i : i + 4] for i in range(0, len(t), 4)] for k, t in texts.items()}
    for n in range(max(map(len, pieces.values())) + 1):
        rows = [{"stream_id": k, "seq": n, "token": p[n], "originals": known} for k, p in pieces.items() if n < len(p)]
        write(source, n, rows + ([{"stream_id": k, "seq": 99, "token": "[DONE]", "originals": {}} for k in pieces] if n == max(map(len, pieces.values())) else []))
    want = {k: streams.restore_text(t, known) for k, t in texts.items()}
    joined = lambda rows: {k: "".join(r.text for r in sorted((r for r in rows if r.stream_id == k), key=lambda r: r.seq)) for k in texts}
    got = run_until(spark, source, "stream_id string, seq long, token string, originals map<string,string>", lambda s: streams.restore_stream(s, 3600), tmp_path, "restored", lambda rows: joined(rows) == want)
    assert joined(got) == want


def test_events_across_batches(spark, tmp_path):
    source = tmp_path / "chunks"
    source.mkdir()
    data = 'data: "é"\n\nevent: x\n\ndata: tail'.encode()
    for n in range(0, len(data), 5):
        write(source, n, [{"stream_id": "a", "seq": n, "hex": data[n : n + 5].hex()}])
    got = run(spark, source, "stream_id string, seq long, hex string", lambda s: streams.reassemble_stream(s.select("stream_id", "seq", F.unhex("hex").alias("chunk"))), tmp_path, "events")
    assert [r.text for r in sorted(got, key=lambda r: r.seq)] == ['data: "é"\n\n', "event: x\n\n"]


def test_hold_point():
    assert streams.split_point("abc [PER") == 4
    assert streams.split_point("abc [PER] x") == 11
    assert streams.split_point("[" + "A" * 40) == 41
    assert streams.split_point("[é") == 2


def test_windows_and_expiry_stream(spark, tmp_path):
    source = tmp_path / "heads"
    source.mkdir()
    for n in range(4):
        write(source, n, [{"ts": f"2024-01-01 0{n}:0{k}:00", "pos": n * 10 + k, "head": "%064x" % (n * 10 + k)} for k in range(3)])
    schema = "ts timestamp, pos long, head string"
    got = run(spark, source, schema, lambda s: streams.anchor_windows(s, late="10 minutes"), tmp_path, "anchors")
    want = {r.window_start: r.merkle_root for r in streams.anchor_windows(spark.read.schema(schema).json(str(source))).collect()}
    assert len(got) >= 3 and all(want[r.window_start] == r.merkle_root for r in got)
    maps = tmp_path / "maps"
    maps.mkdir()
    for n in range(3):
        write(maps, n, [{"created_at": "2024-01-01 00:00:00", "session_id": "s", "placeholder_text": "p"}])
    assert len(run(spark, maps, "created_at timestamp, session_id string, placeholder_text string", streams.expiring_mappings, tmp_path, "maps")) == 1


def test_files_in_any_order(spark, tmp_path):
    """Tokens and chunks whose files come shuffled, one of them twice; nothing is lost, and nothing taken twice."""
    import random

    source, chunks = tmp_path / "tokens", tmp_path / "chunks"
    source.mkdir()
    chunks.mkdir()
    known = {"[PERSON_0000000a]": "Ann", "[ORG_0000000b]": "Bo"}
    text = "to [PERSON_0000000a] of [ORG_0000000b], [x] and [PERSON_0000000a]; [open"
    tokens = [text[i : i + 3] for i in range(0, len(text), 3)] + ["[DONE]"]
    order = [*range(len(tokens)), 4]
    random.Random(2).shuffle(order)
    for n, seq in enumerate(order):
        write(source, n, [{"stream_id": "s", "seq": seq, "token": tokens[seq], "originals": known}])
    want = streams.restore_text(text, known)
    joined = lambda rows: "".join(r.text for r in sorted(rows, key=lambda r: r.seq))
    got = run_until(spark, source, "stream_id string, seq long, token string, originals map<string,string>", lambda s: streams.restore_stream(s, 3600), tmp_path, "any_order", lambda rows: joined(rows) == want)
    assert joined(got) == want
    data = "".join(f"data: {i} é\n\n" for i in range(12)).encode() + b"rest"
    starts = list(range(0, len(data), 7))
    random.Random(3).shuffle(starts)
    for n, at in enumerate(starts):
        write(chunks, n, [{"stream_id": "a", "seq": at, "hex": data[at : at + 7].hex()}])
    got = run(spark, chunks, "stream_id string, seq long, hex string", lambda s: streams.reassemble_stream(s.select("stream_id", "seq", F.unhex("hex").alias("chunk"))), tmp_path, "any_chunks")
    assert [r.text for r in sorted(got, key=lambda r: r.seq)] == [f"data: {i} é\n\n" for i in range(12)]


def test_a_gap_is_given_up_after_the_quiet_spell(spark, tmp_path):
    source = tmp_path / "gap"
    source.mkdir()
    for seq in (0, 1, 3, 4):
        write(source, seq, [{"stream_id": "s", "seq": seq, "token": f"t{seq} ", "originals": {}}])
    got = run_until(spark, source, "stream_id string, seq long, token string, originals map<string,string>", lambda s: streams.restore_stream(s, 1), tmp_path, "gap", lambda rows: sum(len(r.text) for r in rows) == 12)
    assert "".join(r.text for r in sorted(got, key=lambda r: r.seq)) == "t0 t1 t3 t4 "


def test_windows_and_health_outlive_micro_batches(spark, tmp_path):
    import random

    source, scores = tmp_path / "heads", tmp_path / "scores"
    source.mkdir()
    scores.mkdir()
    rows = [{"ts": f"2024-01-01 {h:02d}:{m:02d}:00", "pos": h * 60 + m, "head": "%064x" % (h * 60 + m)} for h in range(3) for m in range(0, 60, 4)]
    random.Random(4).shuffle(rows)
    for n in range(0, len(rows), 5):
        write(source, n, rows[n : n + 5])
    schema = "ts timestamp, pos long, head string"
    got = run(spark, source, schema, lambda s: streams.anchor_windows(s, late="3 hours"), tmp_path, "no_late")
    assert got == []
    got = run(spark, source, schema, lambda s: streams.anchor_windows(s, late="0 minutes"), tmp_path, "late")
    heads = sum(r.n_heads for r in got)
    whole = {r.window_start: r for r in streams.anchor_windows(spark.read.schema(schema).json(str(source))).collect()}
    last = max(whole)
    assert heads >= len(rows) - whole[last].n_heads  # late heads come in rows of their own; only open windows are held
    for n in range(6):
        write(scores, n, [{"series": "m", "seq": n * 3 + k, "composite": (n * 3 + k) / 18} for k in range(3)])
    got = run(spark, scores, "series string, seq long, composite double", streams.health_stream, tmp_path, "health")
    end = max(got, key=lambda r: r.seq)
    assert end.seq == 17 and abs(end.mean_score - sum(k / 18 for k in range(10, 18)) / 8) < 1e-9 and end.health == "unknown"
