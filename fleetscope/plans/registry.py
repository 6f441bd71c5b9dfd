"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the semantics are SQL-expressible, an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    headline: bool


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, headline)
        return fn
    return deco
