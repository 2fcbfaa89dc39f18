"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from parasol.sources.views import VIEWS, Tables, duckdb_cte, references

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with DuckDB SQL for the same result."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def _needed(text: str) -> list[str]:
    found: list[str] = []

    def visit(name: str):
        if name in found:
            return
        for ref in references(name):
            if ref in VIEWS:
                visit(ref)
        found.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            visit(name)
    return found


def with_views(body: str) -> str:
    body = body.strip()
    if body in ORACLES.values() or body.startswith("WITH RECURSIVE zone_"):  # another check, or built from one, views already there
        return body
    ctes = [duckdb_cte(v) for v in _needed(body)]
    if not ctes:
        return body
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    match = re.match(r"WITH(\s+RECURSIVE)?\s+", body, flags=re.I)
    return f"{head},\n{body[match.end():]}" if match else f"{head}\n{body}"


# SQL spellings shared by the oracles.

def sql_round(expr: str, digits: int = 0) -> str:
    scale = f"{10 ** digits}::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def sql_date_key(ts: str) -> str:
    return f"CAST(year({ts})*10000 + month({ts})*100 + day({ts}) AS INT)"


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(12742::DOUBLE * asin(sqrt(sin(radians({lat2}-{lat1})/2)*sin(radians({lat2}-{lat1})/2)"
        f" + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*sin(radians({lon2}-{lon1})/2)*sin(radians({lon2}-{lon1})/2))))"
    )
