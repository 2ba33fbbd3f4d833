"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

#: Query name and its module; modules are imported when queries are listed.
QUERIES = {
    "op1_fingerprints": "cloakline.llm.fingerprint",
    "op2_token_files": "cloakline.llm.simple8b",
    "op3_exact_dedup": "cloakline.llm.exact_dedup",
    "op4_bpe": "cloakline.llm.bpe",
    "op5_secrets": "cloakline.llm.secrets",
    "op6_chat": "cloakline.llm.chat",
    "op7_near_dedup": "cloakline.llm.near_dedup",
    "op8_quality": "cloakline.llm.quality",
    "op9_warc": "cloakline.llm.warc",
    "op10_mixture": "cloakline.llm.mixture",
}
#: Modules that define ORACLE_SQL for their query.
WITH_SQL: tuple[str, ...] = ("op3_exact_dedup", "op6_chat", "op9_warc")


def queries() -> dict:
    return {name: importlib.import_module(module).query for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(QUERIES[name]).ORACLE_SQL for name in WITH_SQL}
