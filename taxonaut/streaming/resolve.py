"""Resolution and counts over streams.

Resolution is stateless but for its registry, so the batch operators run on streams as they are;
keep-first needs state and is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxonaut.operators import resolve
from taxonaut.operators.resolve import DatasetConfig


def read_events(spark: SparkSession, path: str, time: str = "ts", **options: str) -> DataFrame:
    """A folder of Parquet files as a stream, its time column as a timestamp (watermarks refuse timestamps without a zone)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def resolve_stream(records: DataFrame, config: DatasetConfig, registry: DataFrame) -> DataFrame:
    """Streamed records against a static registry."""
    return resolve.with_target(resolve.constrain(resolve.resolve(records, config), registry), config)


def windowed_counts(rows: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows a window and key; rows later than the watermark are dropped, windows come out once they are closed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def keep_first_stream(rows: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row seen of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
