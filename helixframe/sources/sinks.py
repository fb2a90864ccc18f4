"""Writers of count tables; every partition writes its own file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str, min_abundance: int = 2, mode: str = "error") -> None:
    """Text lines 'KMER COUNT' for counts of at least min_abundance, in no order; 0 writes no line at all."""
    keep = F.lit(False) if min_abundance == 0 else F.col("count") >= min_abundance
    counts.where(keep).select(F.concat_ws(" ", "kmer", F.col("count").cast("string")).alias("value")).write.mode(mode).text(path)


def write_counts_parquet(counts: DataFrame, path: str, mode: str = "error", buckets: int | None = None, table: str | None = None) -> None:
    """Parquet; with a table name and buckets, clustered by k-mer so that later lookups and comparisons need no shuffle."""
    if table and buckets:
        counts.write.mode(mode).option("path", path).bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(table)
    else:
        counts.write.mode(mode).parquet(path)
