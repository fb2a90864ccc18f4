"""Point queries on a count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna


def lookup(queries: DataFrame, counts: DataFrame, k: int, column: str = "q") -> DataFrame:
    """(q, count): the count of either strand, 0 if absent, -1 if the query has another length or another symbol.

    No side is forced to be broadcast; Spark does so when the queries' measured size is under its threshold.
    """
    valid = (F.length(column) == k) & dna.is_clean(F.col(column))
    asked = queries.select(F.col(column).alias("q"), F.when(F.coalesce(valid, F.lit(False)), dna.canonical(F.col(column))).alias("_kmer"))
    have = counts.select(F.col("kmer").alias("_kmer"), F.col("count").alias("_n"))
    return asked.join(have, "_kmer", "left").select("q", F.when(F.col("_kmer").isNull(), F.lit(-1)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("count"))
