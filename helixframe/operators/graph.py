"""Adjacency of k-mers: what precedes what inside a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators.windows import TILE, _both, _check_k, _tiles


def edges(df: DataFrame, column: str = "seq", k: int = 21, min_abundance: int = 1, tile: int = TILE) -> DataFrame:
    """(pred, kmer, count): consecutive canonical k-mers and how often they follow one another.

    Both windows are cut from the same k + 1 symbols, so no window function and no shuffle by read is needed.
    """
    _check_k(k)
    packed = k <= dna.MAX_PACKED
    t = _tiles(df, column, k + 1, tile, (), packed).select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - k)).alias("_i"))
    if packed:
        t = t.select(dna.packed_at(F.col("_f"), F.col("_i") - 1, k).alias("pred"), dna.packed_at(F.col("_f"), F.col("_i"), k).alias("kmer"))
        t, text = dna.with_canonical_code(dna.with_canonical_code(t, "pred", k), "kmer", k), lambda name: dna.unpack(F.col(name), k)
    else:
        first, second = _both(F.col("_n"), F.col("_i"), k), _both(F.col("_n"), F.col("_i") + 1, k)
        t, text = t.select(F.least(*first).alias("pred"), F.least(*second).alias("kmer")), lambda name: F.col(name).cast("string")
    out = t.groupBy("pred", "kmer").agg(F.count(F.lit(1)).alias("count"))
    return out.where(F.col("count") >= min_abundance).select(text("pred").alias("pred"), text("kmer").alias("kmer"), "count")


def predecessors(df: DataFrame, column: str, k: int, keep: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """One row per window that has one before it: keep columns, seg_id, pos, pred, kmer, both orientation flags, and the
    first and last symbol of the k-mer."""
    _check_k(k)
    t = _tiles(df, column, k + 1, tile, keep).select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - k)).alias("_i"))
    (f1, r1), (f2, r2) = _both(F.col("_n"), F.col("_i"), k), _both(F.col("_n"), F.col("_i") + 1, k)
    kmer = F.least(f2, r2).cast("string")
    return t.select(*keep, "seg_id", (F.col("_at") + F.col("_i") - 1).cast("bigint").alias("pos"), F.least(f1, r1).cast("string").alias("pred"), kmer.alias("kmer"), (f1 <= r1).alias("pred_is_forward"), (f2 <= r2).alias("is_forward"), F.left(kmer, F.lit(1)).alias("first"), F.right(kmer, F.lit(1)).alias("last"))


def run_lengths(df: DataFrame, column: str, k: int) -> DataFrame:
    """(run_length, runs): how many windows follow one another without a break, which is a segment's length - k + 1."""
    from helixframe.operators.windows import segments

    _check_k(k)
    n = (F.length("seg") - k + 1).cast("bigint")
    return segments(df, column).where(F.length("seg") >= k).groupBy(n.alias("run_length")).agg(F.count(F.lit(1)).alias("runs"))
