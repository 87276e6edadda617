"""Registered queries and their SQL oracles.

An *input* is a drawing-shaped relation derived from the driver tables.  Its SQL is written once in
the dialect common to Spark and DuckDB, with ``{name}`` standing for a driver table or another
input, so both engines see the same rows.  A *query* is a function of ``Inputs``; its oracle is SQL
over the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_inputs: dict[str, tuple[str, str]] = {}
_queries: dict[str, Callable[["Inputs"], DataFrame]] = {}
_oracles: dict[str, str] = {}


def define_input(name: str, sql: str, duck: str | None = None) -> None:
    """Register a derived relation; ``duck`` is given only where the dialects differ."""
    _inputs[name] = (sql, duck or sql)


def _names(sql: str) -> list[str]:
    seen: dict[str, None] = {}
    for _, field, _, _ in Formatter().parse(sql):
        if field:
            seen[field] = None
    return list(seen)


class Inputs:
    """Driver tables and derived relations of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(_inputs[name][0])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: self(name) for name in _names(text)})


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in _queries:
            raise ValueError(f"duplicate query {name}")
        _queries[name] = build
        if oracle is not None:
            _oracles[name] = oracle
        return build

    return register


def _expand(sql: str) -> str:
    """Prefix the oracle with the derived relations it names, dependencies first."""
    ordered: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _names(text):
            if name in TABLES or name in ordered:
                continue
            duck = _inputs[name][1]
            visit(duck)
            ordered[name] = duck

    visit(sql)
    names = {name: name for name in [*TABLES, *ordered]}
    body = sql.format(**names)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({text.format(**names)})" for name, text in ordered.items())
    return f"WITH {ctes}\nSELECT * FROM ({body}) AS answer"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))

    return {name: bind(build) for name, build in _queries.items()}


def oracle_queries() -> dict[str, str]:
    return {name: _expand(sql) for name, sql in _oracles.items()}
