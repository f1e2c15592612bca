"""Registered queries: each operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetwitness.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read lazily; wall-clock columns become UTC timestamps."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        shared_dir(spark)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({s: F.col(s).cast("timestamp") for s in stamps})

    def rows(self, ddl: str, *rows: tuple) -> DataFrame:
        """A literal catalogue (rules, profiles) that a query joins its tables with."""
        schema = StructType.fromDDL(ddl)
        columns = list(zip(*rows, strict=True))
        arrow = to_arrow_schema(schema)
        return self.spark.createDataFrame(
            pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema
        )


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is the same question for the oracle."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
