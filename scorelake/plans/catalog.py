"""Registry of the engine's queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .fixtures import shape, with_shapes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the shapes that its parameters name, with the SQL that gives the same rows where there is one."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        names = build.__code__.co_varnames[: build.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = {"spark": spark, "sf_dir": sf_dir}
            return build(**{n: given[n] if n in given else shape(spark, sf_dir, n) for n in names})

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_shapes(sql)
        return build

    return add


def _load() -> None:
    for suite in ("scoring", "relational", "texts", "answers", "trials", "vectors", "runs", "files"):
        import_module(f"{__package__}.{suite}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean task score of each criterion dimension."""
    _load()
    return _QUERIES["a5_pooled_score"](spark, sf_dir)
