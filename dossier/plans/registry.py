"""The table of registered queries: name, inventory row, Spark callable, SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dossier.operators.blocks import spread
from dossier.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    row: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, row: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, row, fn, sql)
        return fn

    return register


class Tables:
    """Attribute access to the tables of one folder: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load_table(self._spark, self._folder, name)

    @property
    def texts(self) -> DataFrame:
        """documents, over all cores when they are one small file."""
        return spread(self.documents, "doc_id")

    @property
    def markup(self) -> DataFrame:
        """pages, over all cores when they are one small file."""
        return spread(self.pages, "page_id")
