"""Query registry shared by the driver contract, the tests and the benchmark."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.views import Views, with_views


@dataclass(frozen=True)
class Entry:
    build: Callable[[Views], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views) -> DataFrame`` under ``name``; ``sql`` may use the derived views."""

    def wrap(build: Callable[[Views], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(build, with_views(sql) if sql else None)
        return build

    return wrap


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Views(spark, sf_dir))

    return run
