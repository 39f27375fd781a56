"""Catalogue of runnable queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """Name a SQL subquery that oracle statements may refer to."""
    if name in VIEWS:
        raise ValueError(f"duplicate view {name}")
    VIEWS[name] = body.strip()


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def wrap(fn: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return wrap


def expand(sql: str) -> str:
    """Prefix the named views a statement uses, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"(?<![\w.]){name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    body = sql.strip()
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    heads = [f"{name} AS (\n{VIEWS[name]}\n)" for name in order]
    if own:
        body = body[own.end():]
        glue = ",\n" if heads else ""
        return "WITH RECURSIVE " + ",\n".join(heads) + glue + body
    return ("WITH RECURSIVE " + ",\n".join(heads) + "\n" if heads else "") + body
