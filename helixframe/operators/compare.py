"""Differences between count tables, and their re-orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna


def compare_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kmer, left_count, right_count) where the tables differ; null on the side that lacks the k-mer.

    Tables are unioned and grouped, so each side is pre-aggregated and one shuffle serves both.
    """
    a = left.select("kmer", F.col("count").alias("_l"), F.lit(None).cast("bigint").alias("_r"))
    b = right.select("kmer", F.lit(None).cast("bigint").alias("_l"), F.col("count").alias("_r"))
    out = a.unionAll(b).groupBy("kmer").agg(F.max("_l").alias("left_count"), F.max("_r").alias("right_count"))
    return out.where(~F.col("left_count").eqNullSafe(F.col("right_count")))


def orient_counts(counts: DataFrame, k: int, min_abundance: int = 2) -> DataFrame:
    """Lines of at least min_abundance with canonical k-mers of length k; no re-aggregation, as strands stay two lines.

    A k-mer with anything but upper-case symbols becomes Z, so it goes unless k is 1.
    """
    kmer = F.when(F.col("kmer").rlike(r"\A[ACGT]*\z"), dna.canonical(F.col("kmer"))).otherwise(F.lit("Z"))
    return counts.where(F.col("count") >= min_abundance).select(kmer.alias("kmer"), "count").where(F.length("kmer") == k)
