"""Counting windows: partial sums in each task, one shuffle on the k-mer, final sums.

A k-mer that fills a third of the input costs nothing more, since each task sends it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators.windows import TILE, packed_windows, windows


def _shown(counted: DataFrame, kmer: Column, min_abundance: int, count_cap: int | None) -> DataFrame:
    if min_abundance > 1:
        counted = counted.where(F.col("count") >= min_abundance)
    shown = F.col("count") if count_cap is None else F.least(F.col("count"), F.lit(count_cap).cast("bigint"))
    return counted.select(kmer.alias("kmer"), shown.alias("count"))


def count_windows(w: DataFrame, min_abundance: int = 1, count_cap: int | None = None) -> DataFrame:
    """(kmer, count) of window rows."""
    out = w.groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
    return _shown(out, F.col("kmer").cast("string"), min_abundance, count_cap)


def count_kmers(df: DataFrame, column: str = "seq", k: int = 21, min_abundance: int = 2, count_cap: int | None = None, tile: int = TILE, spread: int | None = None, both_strands: bool = False) -> DataFrame:
    """(kmer, count) for canonical k-mers seen at least min_abundance times; count_cap saturates what is shown.

    both_strands counts each read and its reverse complement. They have the same canonical windows, so it doubles counts
    and reads nothing twice. Keys of up to dna.MAX_PACKED symbols are bigints until they are shown.
    """
    if min_abundance < 1:
        raise ValueError("min_abundance must be at least 1; only the text sink knows 0, for no output")
    if isinstance(k, int) and 1 <= k <= dna.MAX_PACKED:
        w, key, kmer = packed_windows(df, column, k, tile, spread), "code", dna.unpack(F.col("code"), k)
    else:
        w, key, kmer = windows(df, column, k, tile=tile, spread=spread), "kmer", F.col("kmer").cast("string")
    n = F.count(F.lit(1))
    return _shown(w.groupBy(key).agg((n * 2 if both_strands else n).alias("count")), kmer, min_abundance, count_cap)


def prefiltered_counts(df: DataFrame, column: str = "seq", k: int = 21, min_abundance: int = 2, count_cap: int | None = None) -> DataFrame:
    """Counts of k-mers that occur at least twice; singletons go even at abundance 1. Exact, and in one pass: windows are
    summed in each task before they are shuffled, and the filter is a floor on the sums."""
    if min_abundance < 1:
        raise ValueError("min_abundance must be at least 1; only the text sink knows 0, for no output")
    return count_kmers(df, column, k, max(2, min_abundance), count_cap)


def spectrum(counts: DataFrame) -> DataFrame:
    """(abundance, kmers): how many k-mers have each count."""
    return counts.groupBy(F.col("count").alias("abundance")).agg(F.count(F.lit(1)).alias("kmers"))


def abundance_summary(counts: DataFrame) -> DataFrame:
    """One row: k-mers seen exactly once, twice, three times, more; and at least once, twice, three times."""
    c = F.col("count")
    tests = {"eq1": c == 1, "eq2": c == 2, "eq3": c == 3, "gt3": c > 3, "ge1": c >= 1, "ge2": c >= 2, "ge3": c >= 3, "over3": c > 3}
    return counts.agg(*(F.count(F.when(t, 1)).alias(n) for n, t in tests.items()))


def totals(counts: DataFrame, min_abundance: int = 2) -> DataFrame:
    """One row: distinct k-mers, windows, and how many k-mers a sink with this floor writes and skips."""
    c = F.col("count")
    return counts.agg(
        F.count(F.lit(1)).alias("distinct_kmers"),
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("windows"),
        F.count(F.when(c >= min_abundance, 1)).alias("written"),
        F.count(F.when(c < min_abundance, 1)).alias("skipped"),
    )


def table_slots(counts: DataFrame) -> DataFrame:
    """One row, slots: what a counter with a table of fixed size would reserve, two for each k-mer seen at least twice.

    A hint for shuffle partitions, too; aggregates here need no size beforehand.
    """
    return counts.agg((F.count(F.when(F.col("count") >= 2, 1)) * 2).alias("slots"))
