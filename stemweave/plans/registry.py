"""Registration of queries: name -> (callable, DuckDB oracle)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``f(t)``, where ``t(table)`` reads a driver table, as a query of (spark, sf_dir)."""

    def register(f):
        def run(spark, sf_dir):
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register
