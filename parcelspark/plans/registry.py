"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelspark import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Named parts that oracles may use before their own SELECT.
PARTS = {"P": fx.PARCELS, "C13": fx.COMMUNES_2013, "C26": fx.COMMUNES_2026, "L": fx.LABELS, "W": fx.SHAPED, "W13": fx.SHAPED_2013, "W26": fx.SHAPED_2026, "E": fx.LAYERS}


def query(oracle: str | None = None, parts: str = "", more: str = ""):
    """Registers a function under its name. parts: names from PARTS that the oracle reads; more: further WITH parts."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            given = ", ".join([f"{k} AS ({PARTS[k]})" for k in parts.split()] + ([more] if more else []))
            ORACLES[f.__name__] = (f"WITH {given} " if given else "") + oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
