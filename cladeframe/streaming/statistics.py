"""Group statistics of a matrix kept up by a stream of ledger rows.

n, sum and sum of squares are mergeable, so a stream adds each micro-batch's
partial statistics as a table; reading sums the parts.  A batch that is run again after a
failure replaces its own part, so every row counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partial_statistics(rows: DataFrame) -> DataFrame:
    """Per study and gene: n, sum, sum of squares, least and greatest of the finite available values."""
    v = F.col("numeric_value")
    good = rows.where(F.col("numeric_available") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return good.groupBy("study_id", "gene_id").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("least"), F.max(v).alias("most"))


def merge_statistics(parts: DataFrame) -> DataFrame:
    return parts.groupBy("study_id", "gene_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("least").alias("least"), F.max("most").alias("most"))


def keep_statistics(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Start a query that writes the statistics of each micro-batch of ``stream`` below ``folder``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        partial_statistics(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return merge_statistics(spark.read.parquet(folder))


def windowed_counts(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and available values per study in windows of ``loaded_at``; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "study_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("numeric_available").alias("n_available"))
