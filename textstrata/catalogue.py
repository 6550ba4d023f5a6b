"""The core engine's queries and their DuckDB SQL."""

from __future__ import annotations

from .plans import base, checks, computed, corpus, documents, golden, relations, retrieval, services, streams, transactions

__all__ = ["checks", "computed", "corpus", "documents", "golden", "oracle_sql", "queries", "relations", "retrieval", "services", "streams", "transactions"]


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
