"""Registration of queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "", with_sql: str = "") -> Callable[[Query], Query]:
    """Register a query under its function name.

    ``sql`` is the SQL with the same result, ``uses`` the names of the table
    definitions it needs and ``with_sql`` further definitions of its own.
    """

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = compose(sql, uses.split(), with_sql)
        return fn

    return add


def compose(sql: str, uses: list[str], with_sql: str = "") -> str:
    from catalog.definitions import DEFINITIONS

    needed: list[str] = []

    def need(name: str) -> None:
        deps, _ = DEFINITIONS[name]
        for d in deps.split():
            need(d)
        if name not in needed:
            needed.append(name)

    for name in uses:
        need(name)
    parts = [f"{n} AS ({DEFINITIONS[n][1].strip()})" for n in needed]
    if with_sql.strip():
        parts.append(with_sql.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
