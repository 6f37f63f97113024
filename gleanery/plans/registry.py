"""Registry of the queries this engine ships, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gleanery.schemas import TABLES
from gleanery.session import ROW_PIECE, TEXT_PIECE, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = ["urls", "texts", "documents", "records", "selection", "discovery", "matching", "publishing", "reporting", "streams"]


def register(sql: str | None = None, name: str | None = None):
    def wrap(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE[key] = sql
        return function

    return wrap


# Tables whose rows are whole texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str, costly: bool = False) -> DataFrame:
    """A given table; ``costly`` marks row-wise heavy use, which text tables always have."""
    df = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    return spread(df, df.columns[0], TEXT_PIECE if name in TEXTS else ROW_PIECE) if costly or name in TEXTS else df


def load_all() -> None:
    for module in MODULES:
        import_module(f"gleanery.plans.{module}")
