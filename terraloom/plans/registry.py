"""Where queries register: a query under its name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query under its function's name, with SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(views)
            body = sql.strip()
            if head:
                body = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") if body.startswith("WITH ") else "| " + body
                body = f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (" " + body[2:] if body.startswith("| ") else ", " + body)
            SQL[f.__name__] = body
        return f

    return add
