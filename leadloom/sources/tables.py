"""Parquet tables by name. Zone-less timestamps are read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads ``{folder}/{name}.parquet``; ``timestamp_ntz`` columns become UTC timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    if not naive:
        return df
    return df.select(*[F.col(f"`{c}`").cast("timestamp").alias(c) if c in naive else F.col(f"`{c}`") for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """df with a partition per core at least, before work that costs far more
    than moving the rows. A scan that already fills the cores is left alone, so
    large inputs are never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
