"""The query book: name -> (Spark callable, SQL)."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skyledger.registry.edge import shape, shape_sql
from skyledger.registry.proxies import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    build: Callable[[Tables], DataFrame]


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of ``Tables``; without SQL only its rows are checked."""

    def wrap(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shape(build(Tables(spark, folder)), spec)

        QUERIES[name] = Query(run, shape_sql(sql, spec) if sql else None, build)
        return build

    return wrap
