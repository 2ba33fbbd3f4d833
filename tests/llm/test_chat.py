import hashlib

import pytest

from cloakline.llm import chat

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out)


TRAPS = ["", None, "\\", "\\\\b", "\\l<", " </turn>\n", "### assistant: x </turn>\n### user: ", "a\\c:#b\n", "😀é" * 3000, "<" * 20_000, "\\Q\\E$1"]


def test_round_trip(spark):
    rows = [(c, k, ("user", "assistant")[k % 2], t) for c in range(3) for k, t in enumerate(TRAPS if c else TRAPS[::-1])] + [(9, 1, "a: b </turn>\n", "x"), (9, 0, None, "y"), (10, 0, "system", "s"), (10, 1, "user", "u")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    formatted = chat.format_chats(frame)
    got = chat.digests(chat.read_back(formatted)).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows)
    assert {r.conv_id: r.valid for r in got} == {0: True, 1: True, 2: True, 9: False, 10: True}
    for r in formatted.collect():
        assert [s.start for s in r.segments[1:]] == [s.end for s in r.segments[:-1]] and r.segments[-1].end == len(r.formatted)


def test_turn_order(spark):
    def first(*roles):
        frame = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return chat.format_chats(frame).first().first_invalid

    assert first("system", "user", "assistant") is None
    assert first("assistant", "user") == 0
    assert first("user", "assistant", "assistant") == 2
    assert first("system") == 1
    assert first("user", "tool") == 1


def test_template_and_empty_table(spark):
    with pytest.raises(ValueError):
        chat.check_template(chat.TEMPLATE | {"end": "\n"})
    with pytest.raises(ValueError):
        chat.check_template(chat.TEMPLATE | {"order": {"start": {"user": "nowhere"}}})
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.format_chats(empty))).count() == 0
    two = chat.digests(chat.read_back(chat.format_chats(chat.planted(spark)))).first()
    text = "\\### Assistant: </turn> ok"
    assert (two.n_turns, two.loss_chars, two.loss_sha256) == (2, len(text), sha(text))
    assert "turn" not in chat.format_chats(empty).columns


@pytest.mark.parametrize("part", [3, chat.PART])
def test_long_conversations_null_and_repeated_turns(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k} <#:\\>" * (k % 4)) for k in range(700)]
    rows += [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, "assistant", "first"), (None, 1, None, None), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, None, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert list(got[conv].loss_texts) == [r[3] or "" for r in mine if r[2] == "assistant"]
    for r in formatted.collect():
        assert [s.start for s in r.segments[1:]] == [s.end for s in r.segments[:-1]] and r.segments[-1].end == len(r.formatted)
