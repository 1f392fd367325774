"""Registry of the queries that run over the given tables, each with its check where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.plans.bindings import Inputs, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *bindings: str, sql: str | None = None):
    """Register fn(inputs) under a name; `sql` continues a WITH clause over the bindings."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            head = ctes(*bindings) if bindings else ""
            if head and text.split(None, 1)[0] == "WITH":
                text = head + ",\n" + text[4:]
            elif head:
                text = head + "\n" + text
            ORACLES[name] = text
        return fn

    return register
