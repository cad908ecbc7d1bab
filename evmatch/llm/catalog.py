"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from evmatch.llm import collocations, decontamination, html, kdtree, media, mixing, packing, periodicity, quality, sharding, simhash, suffixes, toxicity

MODULES = (simhash, media, sharding, html, quality, toxicity, suffixes, mixing, kdtree, packing, periodicity, collocations, decontamination)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
