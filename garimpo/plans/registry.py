"""How the modules of plans register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry():  # noqa: ANN201
    """``(queries, sqls, decorator)`` of one module; a query without SQL is checked by its rows only."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):  # noqa: ANN202
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query


def value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(value, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def rows(names: str, *data: tuple) -> str:
    """SQL of literal rows with known answers; ``names`` are its columns, separated by blanks, with ``:type`` where a cast is needed."""
    cols = [n.partition(":") for n in names.split()]
    body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in data)
    picks = ", ".join(f"CAST({n} AS {t}) AS {n}" if t else n for n, _, t in cols)
    return f"SELECT {picks} FROM (VALUES {body}) x({', '.join(n for n, _, _ in cols)})"
