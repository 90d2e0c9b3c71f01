"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitloom.fixtures import duck_with, fixture
from pitloom.functions.quantity import QuantityContract
from pitloom.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Run parameters shared by the registered queries (a batch id is an order year).
CUTOFF = "2000-06-30 00:00:00"
SCORING_BATCH = "1997"
SCORING_CUTOFF = "1997-06-30 00:00:00"
TOLERANCE = "30 days"
SOURCE_DELAY = "1 hour"
LOOKBACK = "30 days"
MAPPING_VERSION = "quantity-v1"
CONTRACT = QuantityContract(MAPPING_VERSION, 0, 50)  # every fixture quantity in domain
NARROW_CONTRACT = QuantityContract(MAPPING_VERSION, 0, 20)  # many out of domain
MODEL_NAME = "quantity-classifier"
RUN_TS = "2026-03-01 00:00:00"


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = duck_with(oracle)
        return run

    return deco


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, name)
