"""The catalog of named queries: each a function of the session and a folder of tables, some beside SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_DOC: dict[str, str] = {}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt evenly by key before work that is heavy against their bytes, by which alone Spark cuts its input into tasks."""
    spark = rows.sparkSession
    few = 4 * spark.sparkContext.defaultParallelism  # a task's start costs as much as thousands of rows where rules are many
    return rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), few), key)


def query(sql: str | None = None):
    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)

        _QUERIES[name] = run
        _DOC[name] = f.__doc__ or ""
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def documentation() -> dict[str, str]:
    """What each query covers."""
    return dict(_DOC)
