"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Rebalance rows ahead of per-row Python work when the scan has fewer splits than cores can use.

    Large inputs already have many splits and pass through without a shuffle, and so does what a shuffle has made,
    since asking for its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)
