"""Stateless ingest of arriving reads: the batch views on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.functions.seq import plain


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Reads that arrive as Parquet files of the columns of `read_pairs`, with clean bases; rows without bases are left out."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select("lib_no", "pair_id", "mate", "tag", F.col("loaded_at").cast("timestamp").alias("loaded_at"), plain("seq").alias("bases")).where("bases <> ''")


def deduplicated(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (library, pair, mate) once; repeats that arrive within `late` of event time are dropped, state older than it is freed."""
    return stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["lib_no", "pair_id", "mate"])


def daily_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Reads and bases per library and day of arrival."""
    day = F.window("loaded_at", "1 day")
    return stream.withWatermark("loaded_at", late).groupBy(day.alias("day"), "lib_no").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("bases")).alias("bases"))


def write_stream(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Append to a Parquet folder, exactly once by the state folder, until the files present are read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
