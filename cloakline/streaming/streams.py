"""Streams: event reassembly, restoration token by token, anchoring windows, expiry, health probes.

Each streaming operator has a batch twin with the same rows, which is how it is tested. Rows may come in any order, in
a micro-batch and across micro-batches: what comes too early waits in the state until its turn.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakline.functions import chat
from cloakline.operators import audit, canary
from cloakline.operators.spans import TOKEN, restore

#: Characters of the longest placeholder that may be held back, and how long.
LONGEST, HOLD_SECONDS = 32, 0.5


def concatenated(rows: DataFrame, stream: str = "stream_id", order: str = "seq", part: str = "token") -> DataFrame:
    """One text for each stream. A stream is one answer of a model, so its size is bounded."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p"))))
    return rows.groupBy(stream).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("text"))


def reassemble(chunks: DataFrame, stream: str = "stream_id", order: str = "seq", chunk: str = "chunk", with_tail: bool = False) -> DataFrame:
    """stream, idx, event of each complete event of binary chunks; invalid UTF-8 becomes the replacement character."""
    joined = chunks.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(chunk).alias("p")))).alias("x"))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform("x", lambda x: x["p"]), "")).cast("string"))
    rows = joined.select(stream, text.alias("text"))
    events = chat.complete_events(F.col("text"))
    if with_tail:
        events = F.concat(events, F.filter(F.array(chat.unfinished(F.col("text"))), lambda t: t != ""))
    return rows.select(stream, F.posexplode(events).alias("idx", "event"))


def restore_streams(tokens: DataFrame, originals: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Batch twin: stream, restored text of all its tokens. originals: stream, originals (a map)."""
    rows = concatenated(tokens.filter("token != '[DONE]'"), stream).join(originals, stream, "left")
    return rows.select(stream, restore(F.col("text"), F.coalesce("originals", F.expr("cast(map() as map<string,string>)"))).alias("restored"))


def split_point(text: str) -> int:
    """Where text can be cut so that what follows may still grow into a placeholder, and what precedes can't."""
    at = text.rfind("[")
    if at < 0:
        return len(text)
    tail = text[at:]
    if "]" in tail or len(tail) > LONGEST or not tail.isascii():
        return len(text)
    return at


def restore_text(text: str, originals: dict[str, str]) -> str:
    return re.sub(TOKEN, lambda m: originals.get(m[0], m[0]), text)


STATE = "tail string, originals map<string,string>, next long, due long, waiting string, skipped string"
OUT = "stream_id string, seq long, text string"


def in_turn(due: int, waiting: dict[int, str], size=lambda x: 1) -> tuple[list[str], int]:
    """Items of waiting whose turn it is, taken out of it, and the place that is due after them."""
    out = []
    while due in waiting:
        item = waiting.pop(due)
        out.append(item)
        due += max(size(item), 1)
    return out, due


def restore_stream(tokens: DataFrame, hold_seconds: float = HOLD_SECONDS) -> DataFrame:
    """Streaming restoration. tokens: stream_id string, seq long (0, 1, ...), token string, originals map<string,string>.

    A token that comes before its turn waits for those before it; one that comes twice is taken once. The token [DONE]
    gives out the tail after the last open bracket when its turn comes. After a quiet spell of hold_seconds all that
    waits is given out, in order, over the gaps; a token of a gap that comes later still is given out as it comes, so
    nothing is lost if a stream never ends properly.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, originals, number, due, waiting, skipped = state.get if state.exists else ("", {}, 0, 0, "{}", "[]")
        originals, waiting, skipped = dict(originals or {}), {int(k): v for k, v in json.loads(waiting).items()}, set(json.loads(skipped))
        out = []

        def take(token: str) -> None:
            nonlocal tail
            if token == "[DONE]":
                out.append(restore_text(tail, originals))
                tail = ""
                return
            tail += token
            cut = split_point(tail)
            out.append(restore_text(tail[:cut], originals))
            tail = tail[cut:]

        if state.hasTimedOut:
            for seq in sorted(waiting):
                skipped.update(range(due, seq))
                take(waiting[seq])
                due = seq + 1
            out.append(restore_text(tail, originals))
            tail, waiting = "", {}
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for seq, token, known in zip(rows["seq"].tolist(), rows["token"], rows["originals"], strict=True):
                originals.update(known if isinstance(known, dict) else dict(known) if known is not None else {})
                if seq >= due:
                    waiting.setdefault(seq, token)
                elif seq in skipped:
                    skipped.remove(seq)
                    take(token)
            ready, due = in_turn(due, waiting)
            for token in ready:
                take(token)
            state.setTimeoutDuration(max(int(hold_seconds * 1000), 1))
        out = [x for x in out if x]
        state.update((tail, originals, number + len(out), due, json.dumps(waiting), json.dumps(sorted(skipped))))
        if out:
            yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": range(number, number + len(out)), "text": out})

    return tokens.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def reassemble_stream(chunks: DataFrame) -> DataFrame:
    """Streaming event reassembly. chunks: stream_id string, seq long, chunk binary.

    seq is the place of the chunk's first byte in its stream. The state holds the unfinished bytes, and chunks that
    came before their turn. A chunk that comes twice is taken once.
    """

    def step(key, batches, state):
        held, number, due, waiting = state.get if state.exists else ("", 0, 0, "{}")
        held, waiting = bytes.fromhex(held), {int(k): v for k, v in json.loads(waiting).items()}
        rows = pd.concat(list(batches))
        for seq, chunk in zip(rows["seq"].tolist(), rows["chunk"], strict=True):
            if seq >= due and len(chunk):
                waiting.setdefault(seq, bytes(chunk).hex())
        ready, due = in_turn(due, waiting, lambda x: len(x) // 2)
        *events, held = (held + b"".join(map(bytes.fromhex, ready))).split(b"\n\n")
        state.update((held.hex(), number + len(events), due, json.dumps(waiting)))
        if events:
            yield pd.DataFrame({"stream_id": [key[0]] * len(events), "seq": range(number, number + len(events)), "text": [e.decode("utf-8", "replace") + "\n\n" for e in events]})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, "held string, next long, due long, waiting string", "append", GroupStateTimeout.NoTimeout)


def route_lines(events: DataFrame, event: str = "event") -> DataFrame:
    """Lines of events with their kind (delta, done, pass) and, for deltas, the JSON."""
    lines = events.select("*", F.posexplode(F.filter(F.split(event, "\n"), lambda x: x != "")).alias("line_no", "line"))
    kind = chat.event_line_kind(F.col("line"))
    return lines.withColumn("kind", kind).withColumn("json", F.when(F.col("kind") == "delta", F.substring("line", 7, 1 << 30)))


ANCHORED = "window_start timestamp, n_heads int, first_head string, last_head string, merkle_root string"


def anchor_windows(heads: DataFrame, time: str = "ts", minutes: int = 15, late: str | None = None) -> DataFrame:
    """window_start, n_heads, first_head, last_head, merkle_root of tumbling windows; a stream needs late."""
    rows = heads.filter("head != ''").select(F.col(time).alias("ts"), "pos", "head")
    if late:
        return _anchor_stream(rows, minutes, late)
    placed = rows.select(F.window("ts", f"{minutes} minutes")["start"].alias("window_start"), F.struct("ts", "pos").alias("order"), "head")
    return audit.merkle_roots(placed, "window_start", "order")


def _anchor_stream(heads: DataFrame, minutes: int, late: str) -> DataFrame:
    """A log's open windows are its state. A window is given out once a head is late (an interval) past its end; heads
    that come even later give a further row of their window at once, so none is lost in whatever order they come."""
    number, unit = late.split()
    slack = timedelta(**{unit.rstrip("s") + "s": float(number)})
    width, epoch = timedelta(minutes=minutes), datetime(1970, 1, 1)

    def step(key, batches, state):
        newest, held = state.get if state.exists else ("", "{}")
        held, newest = json.loads(held), datetime.fromisoformat(newest) if newest else epoch
        rows = pd.concat(list(batches))
        for ts, pos, head in zip(rows["ts"], rows["pos"].tolist(), rows["head"], strict=True):
            at = ts.to_pydatetime().replace(tzinfo=None)
            newest = max(newest, at)
            held.setdefault((at - (at - epoch) % width).isoformat(), []).append([at.isoformat(timespec="microseconds"), pos, head])
        closed = sorted(w for w in held if datetime.fromisoformat(w) + width + slack <= newest)
        out = []
        for w in closed:
            ordered = [h for _, _, h in sorted(held.pop(w))]
            out.append((datetime.fromisoformat(w).replace(tzinfo=timezone.utc), len(ordered), ordered[0], ordered[-1], audit.merkle_root_of(ordered)))
        state.update((newest.isoformat(), json.dumps(held)))
        if out:
            frame = pd.DataFrame(out, columns=["window_start", "n_heads", "first_head", "last_head", "merkle_root"])
            yield frame.astype({"n_heads": "int32"})

    one_log = heads.withColumn("log", F.lit(0))
    return one_log.groupBy("log").applyInPandasWithState(step, ANCHORED, "newest string, held string", "append", GroupStateTimeout.NoTimeout)


def expiring_mappings(mappings: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Streaming store: distinct mappings; state older than ttl is dropped by the watermark."""
    return mappings.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["session_id", "placeholder_text"])


def health_of_batch(scored: DataFrame, series: str, order: tuple[str, ...]) -> DataFrame:
    """Batch twin: the health after each series' last score."""
    latest = canary.rolling_health(scored, series, order)
    rank = F.row_number().over(Window.partitionBy(series).orderBy(*[F.desc(c) for c in order]))
    return latest.withColumn("_n", rank).filter("_n = 1").drop("_n")


def health_stream(scored: DataFrame) -> DataFrame:
    """series, seq, mean_score, health after each micro-batch. scored: series string, seq long, composite double.

    The state is a series' last canary.WINDOW scores by seq, so the window outlives micro-batches and older scores that
    come late count if they still lie in it. A seq that comes again replaces its score.
    """

    def step(key, batches, state):
        recent = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        rows = pd.concat(list(batches))
        recent.update(zip(rows["seq"].tolist(), rows["composite"].tolist(), strict=True))
        recent = {k: recent[k] for k in sorted(recent)[-canary.WINDOW :]}
        state.update((json.dumps(recent),))
        mean = sum(recent.values()) / len(recent)
        yield pd.DataFrame({"series": [key[0]], "seq": [max(recent)], "mean_score": [mean], "health": [canary.health_of(mean)]})

    return scored.groupBy("series").applyInPandasWithState(step, "series string, seq long, mean_score double, health string", "recent string", "append", GroupStateTimeout.NoTimeout)
