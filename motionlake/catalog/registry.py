"""Registered queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, *, ctes: tuple[str, ...] = (), sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        text = None
        if sql is not None:
            text = (f"WITH {','.join(ctes)}\n{sql}" if ctes else sql).strip()
        ENTRIES[name] = Entry(fn, text)
        return fn

    return add
