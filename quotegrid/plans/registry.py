"""Named queries with the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def compose(body: str) -> str:
    """Prefix ``body`` with the named subqueries it mentions, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered) + "\n" + body.strip()


def query(name: str, sql: str | None = None):
    """Register a Spark query; ``sql`` may mention any named subquery."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add
