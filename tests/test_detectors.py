"""Plugged-in detectors, tiers from options, and what a model is asked."""

import time

import pytest

from cloakline.operators import detect


def test_tiers_from_options(spark):
    rows = spark.createDataFrame([(1, "mail a@b.org about Heron", "[]", '[{"type":"PERSON","start":0,"end":4,"text":"mail","confidence":0.9}]')], "id long, text string, fast_reply string, deep_reply string")
    heron = lambda: [detect.Rule("r", "ORGANIZATION", keywords=["Heron"])]

    def broken():
        raise OSError("no such file")

    found = {}
    for mode, rules in (("fast", heron), ("deep", heron), ("auto", broken)):
        row = detect.Tiers.build(mode, rules).detect(rows).first()
        found[mode] = ([s.text for s in row.spans], row.deep_scan_used, row.rules_attempted)
    assert found["fast"] == (["a@b.org", "Heron"], False, True)
    assert found["deep"] == (["mail", "a@b.org", "Heron"], True, True)
    assert found["auto"] == (["a@b.org"], False, False)
    with pytest.raises(ValueError):
        detect.Tiers.build("slow")


def test_detectors_are_merged(spark):
    rows = spark.createDataFrame([(1, "mail a@b.org")], "id long, text string")
    row = detect.detect_with(rows, [detect.PatternDetector(), detect.RuleDetector([detect.Rule("r", "PERSON", keywords=["mail", "b.org"])])]).first()
    assert [(s.type, s.text) for s in row.spans] == [("PERSON", "mail"), ("EMAIL", "a@b.org")]
    assert not any((row.deep_scan_available, row.deep_attempted, row.deep_scan_used, row.rules_attempted))


def test_a_model_is_asked_with_a_prompt_and_a_limit():
    asked = []

    def complete(prompt, text, tokens):
        asked.append((prompt, text, tokens))
        if text == "slow":
            time.sleep(2)
        return "[]"

    assert detect.asking(complete, seconds=0.5)(["a", "slow"]) == ["[]", None]
    assert asked[0][2] == detect.TOKENS and "PERSON" in asked[0][0]
