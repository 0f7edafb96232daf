"""Cutting lineage so that the loss of executors does no harm."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for eager work within the block; the former ones come back afterwards."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Only a local session (tests) may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
    return at


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read from the shared folder afterwards; a lost executor loses nothing of it.

    What Spark infers about the columns is not carried on: over the rounds of a loop it would grow without bound.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    with settings(spark, spark__sql__constraintPropagation__enabled="false"):
        return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files (and, if the session says so, checkpoints) of work that nothing refers to any more.

    It does so by itself only when the driver's heap fills up, which with small plans over large tables is late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
