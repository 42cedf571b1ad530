"""Metrics of replicates that arrive as a stream: each micro-batch adds its sums, which merge exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sums(e: DataFrame) -> DataFrame:
    """(n, s1, s2): what errors (column e) add to mse and absme."""
    return e.agg(F.count("*").alias("n"), F.sum("e").alias("s1"), F.sum(F.col("e") * F.col("e")).alias("s2"))


def accumulate(errors: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the sums of each micro-batch to its own folder, so that a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        sums(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return errors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(n, mse, absme) of all batches so far."""
    s = spark.read.parquet(path).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return s.select("n", (F.col("s2") / F.col("n")).alias("mse"), F.abs(F.col("s1") / F.col("n")).alias("absme"))
