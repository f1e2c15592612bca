"""File streams, and running a stream until its input is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwitness.session import scratch_path, share_package

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
STORES = "org.apache.spark.sql.execution.streaming.state."


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A file stream; ``maxFilesPerTrigger`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    df = reader.load(path)
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({s: F.col(s).cast("timestamp") for s in stamps}) if stamps else df


def use_state_store(spark: SparkSession, keyed: bool = True) -> None:
    """Where state is held: ``keyed`` state and timers need RocksDB, of which every partition opens one
    for every table; joins and aggregations have the plain store, whose few files suit short
    windows. Workers find this package."""
    spark.conf.set(STATE_STORE, f"{STORES}{'RocksDB' if keyed else 'HDFSBacked'}StateStoreProvider")
    share_package(spark)


def run_to_table(stream: DataFrame, name: str, folder: str | None = None, keyed: bool = True) -> DataFrame:
    """Process what is there, append to Parquet, and return the written rows."""
    spark = stream.sparkSession
    use_state_store(spark, keyed)
    folder = folder or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
