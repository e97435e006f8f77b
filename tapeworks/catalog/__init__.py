"""Named queries over the given tables, each with its SQL statement where SQL can express it."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

MODULES = ("core", "fractional", "enhanced", "mlfeatures", "tables", "screening", "regimes", "labelling", "datasets", "signalling",
           "trading", "risking", "monitoring", "learning", "streams", "jobs", "files")


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
