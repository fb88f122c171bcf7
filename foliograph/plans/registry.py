"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        add(name, f, sql)
        return f

    return put


def columns(name: str, source: Query, key: list[str], made: Callable[[], dict[str, Column]], with_: str, frm: str, sql: dict[str, str], where: tuple[Callable[[], Column], str] | None = None) -> None:
    """A query that adds columns to the key of a source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        df = df.where(where[0]()) if where else df
        return df.select(*key, *(c.alias(n) for n, c in made().items()))

    said = ", ".join([*key, *(f"{s} AS {n}" for n, s in sql.items())])
    add(name, run, f"WITH {with_} SELECT {said} FROM {frm}" + (f" WHERE {where[1]}" if where else ""))
