"""Null and repeated doc_ids: rows are linked, kept and dropped by their own texts."""

import pytest

from cloakline.llm import near_dedup as nd

SCHEMA = "doc_id long, text string"


def text(name, n=60, change=None):
    words = [f"{name}{i}" for i in range(n)]
    if change is not None:
        words[change] = "other"
    return " ".join(words)


@pytest.mark.parametrize("shared", [None, 7])
def test_rows_of_one_id_with_different_texts(spark, shared):
    rows = [(shared, text("a")), (shared, text("a", change=59)), (shared, text("b")), (3, text("b", change=0)), (shared, text("c")), (shared, None), (9, text("d"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in nd.groups(docs, 80).collect())
    id_ = shared or 0
    assert found == sorted([(id_, id_, True), (id_, id_, False), (id_, 3, False), (3, 3, True), (id_, id_, True), (id_, id_, True), (9, 9, True)])
    kept = [r.text for r in nd.deduplicate(docs, 80).collect()]
    assert len(kept) == 5 and {text("b", change=0), text("c"), None, text("d")} <= set(kept)
    assert len({text("a"), text("a", change=59)} & set(kept)) == 1
