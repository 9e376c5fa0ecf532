"""DuckDB SQL that reproduces the queries, for the correctness check."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import cv_queries, documents, history, matching

    return {**cv_queries.SQL, **matching.SQL, **history.SQL, **documents.SQL}
