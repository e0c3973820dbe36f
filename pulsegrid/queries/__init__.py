"""Registered queries: one Spark callable per operator, with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import ship_package

FAMILIES = ("splits", "evaluation", "sampling", "signals", "filters", "augmentation", "fragments",
            "spectra", "features", "schedules", "cycles", "ingest", "streams", "models", "staged", "recorded")


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None):
    """Register a function under its own name as the query for the given survey ids."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        REGISTRY[fn.__name__] = Query(fn.__name__, ids, run, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return REGISTRY
