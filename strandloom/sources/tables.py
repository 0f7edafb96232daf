"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` on at least as many partitions as the cluster has cores.

    For CPU-heavy Python stages over a scan that came as a few files. A table that already has enough partitions is
    returned as it is, without a shuffle. Use it on scans only: it asks for the partitions of the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fanned(df: DataFrame, *keys: str) -> DataFrame:
    """`df` on a fixed number of partitions by `keys`, for stages that make many rows of each row (words of sequences).

    Adaptive execution would merge such small inputs into few partitions, before it can know what they grow to.
    """
    return df.repartition(partitions(df.sparkSession), *keys)


def partitions(spark: SparkSession) -> int:
    """As many as a shuffle has, and as the cluster has cores at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
