"""All queries of the core, by name."""

from __future__ import annotations

from strandflow.plans import catalogue_queries, data_problems, file_queries, sequence_queries

_MODULES = (sequence_queries, catalogue_queries, data_problems, file_queries)
ENTRY = sequence_queries.kmer_overview


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
