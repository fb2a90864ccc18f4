"""Counts over a stream of reads: the batch plan with a running state per k-mer (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.counting import count_windows
from helixframe.operators.windows import windows


def stream_plain(spark: SparkSession, folder: str) -> DataFrame:
    """New files of one read per line, as they come."""
    return spark.readStream.text(folder).select(F.col("value").alias("seq"))


def stream_counts(reads: DataFrame, column: str = "seq", k: int = 21, min_abundance: int = 1) -> DataFrame:
    """Running counts; write them with output mode update or complete."""
    return count_windows(windows(reads, column, k), min_abundance)
