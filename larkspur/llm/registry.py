"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from larkspur.llm import bpe, kmeans_dedup, langid, licenses, mixing, quality, sharding, simhash, topk, toxicity

MODULES = [simhash, topk, licenses, langid, bpe, toxicity, kmeans_dedup, sharding, mixing, quality]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
