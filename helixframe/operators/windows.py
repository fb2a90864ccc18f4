"""From reads to windows: segments of valid symbols, tiles of bounded size, then one row per window.

Slices are taken from BINARY, where an offset is direct; a slice of a STRING counts characters from its start. The
reverse complement is made once per tile and sliced from the other end, so a window costs two slices and a comparison.
Windows that are only counted are packed where a bigint holds them: a tile becomes words of 31 symbols once, a window is a
shift of one word or two, and its reverse complement is made by swapping bits, inside generated code; keys are then 8 bytes
in every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna

#: Window starts per tile: what one row expands to at most, however long its segment.
TILE = 1 << 16


def _check_k(k: int) -> None:
    if not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")


def segments(df: DataFrame, column: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., seg_id, seg): the maximal runs of symbols, upper case. A null read has none."""
    runs = F.posexplode(F.split(F.col(column), dna.BREAK))
    return df.select(*keep, runs.alias("seg_id", "_run")).where(F.length("_run") > 0).select(*keep, "seg_id", dna.fold(F.col("_run")).alias("seg"))


def _tiles(df: DataFrame, column: str, size: int, tile: int, keep: tuple[str, ...], packed: bool = False) -> DataFrame:
    """Pieces of each segment that overlap by size - 1 symbols, so every window of that size has one piece.

    _f and _r are both strands as bytes, or _f is the read's own in packed words; _n is the number of symbols."""
    seg = segments(df, column, keep).where(F.length("seg") >= size)
    last = F.length("seg") - size + 1
    out = seg.select(*keep, "seg_id", F.col("seg").cast("binary").alias("_bytes"), F.explode(F.sequence(F.lit(1), last, F.lit(tile))).alias("_at"))
    piece = F.substring(F.col("_bytes"), F.col("_at"), F.lit(tile + size - 1))
    out = out.select(*keep, "seg_id", "_at", piece.alias("_f"))
    if packed:
        codes = F.translate(F.col("_f").cast("string"), dna.ALPHABET, "0123").cast("binary")
        return out.select(*keep, "seg_id", "_at", F.octet_length("_f").alias("_n"), codes.alias("_c")).select(*keep, "seg_id", "_at", "_n", dna.left_blocks(F.col("_c"), F.col("_n")).alias("_f"))
    return out.select("*", dna.reverse_complement(F.col("_f").cast("string")).cast("binary").alias("_r"), F.octet_length("_f").alias("_n"))


def _both(size: Column | int, at: Column, k: int) -> tuple[Column, Column]:
    """Forward slice and reverse complement of the window that begins at the 1-based offset."""
    k_ = F.lit(k)
    return F.substring(F.col("_f"), at, k_), F.substring(F.col("_r"), size - at - k_ + 2, k_)


def packed_windows(df: DataFrame, column: str = "seq", k: int = 21, tile: int = TILE, spread: int | None = None) -> DataFrame:
    """One row per window: code, the smaller strand in a bigint; for k up to dna.MAX_PACKED."""
    _check_k(k)
    t = _tiles(df, column, k, tile, (), packed=True)
    if spread:
        t = t.repartition(spread)
    t = t.select("_f", F.explode(F.sequence(F.lit(0), F.col("_n") - k)).alias("_i"))
    return dna.with_canonical_code(t.select(dna.packed_at(F.col("_f"), F.col("_i"), k).alias("code")), "code", k)


def windows(df: DataFrame, column: str = "seq", k: int = 21, keep: tuple[str, ...] = (), positions: bool = False, tile: int = TILE, spread: int | None = None) -> DataFrame:
    """One row per window of k symbols: kmer (bytes of the smaller strand), with keep columns.

    positions adds seg_id, pos (0-based in its segment), forward (the read's own strand, bytes), is_forward, and noncanonical
    (bytes of the larger strand). spread
    deals tiles over that many partitions first, for inputs of few very long reads.
    """
    _check_k(k)
    t = _tiles(df, column, k, tile, keep)
    if spread:
        t = t.repartition(spread)
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - k + 1)).alias("_i"))
    fwd, rev = _both(F.col("_n"), F.col("_i"), k)
    if not positions:
        return t.select(*keep, F.least(fwd, rev).alias("kmer"))
    out = t.select(*keep, "seg_id", (F.col("_at") + F.col("_i") - 2).cast("bigint").alias("pos"), fwd.alias("forward"), rev.alias("_b"))
    return out.select(*keep, "seg_id", "pos", "forward", F.least("forward", "_b").alias("kmer"), (F.col("forward") <= F.col("_b")).alias("is_forward"), F.greatest("forward", "_b").alias("noncanonical"))


def symbol_at(window: Column, i: int, backward: bool = False) -> Column:
    """The symbol at a 0-based position of a window's bytes, or of its reverse complement; empty beyond the end."""
    if i < 0:
        raise ValueError("positions begin at 0")
    if not backward:
        return F.substring(window, F.lit(i + 1), F.lit(1)).cast("string")
    at = F.octet_length(window) - i
    return F.translate(F.when(at > 0, F.substring(window, at, F.lit(1)).cast("string")).otherwise(F.lit("")), dna.ALPHABET, "TGCA")


def window_symbols(df: DataFrame, column: str = "seq", k: int = 21, keep: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """One row per window: keep columns, seg_id, pos, its leftmost and its rightmost (newest) symbol, and the symbol that the
    step to it pushed off, null for the first window of a segment."""
    _check_k(k)
    seg = segments(df, column, keep).where(F.length("seg") >= k)
    last = F.length("seg") - k + 1
    t = seg.select(*keep, "seg_id", F.col("seg").cast("binary").alias("_bytes"), F.explode(F.sequence(F.lit(1), last, F.lit(tile))).alias("_at"), last.alias("_last"))
    t = t.select("*", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + tile - 1, F.col("_last")))).alias("_i"))
    symbol = lambda i: F.substring(F.col("_bytes"), i, F.lit(1)).cast("string")
    off = F.when(F.col("_i") > 1, symbol(F.greatest(F.col("_i") - 1, F.lit(1))))
    return t.select(*keep, "seg_id", (F.col("_i") - 1).cast("bigint").alias("pos"), symbol(F.col("_i")).alias("leftmost"), symbol(F.col("_i") + k - 1).alias("rightmost"), off.alias("pushed_off"))


def with_reverse_strands(df: DataFrame, column: str = "seq") -> DataFrame:
    """The reads and the reverse complement of each; symbols other than ACGT stay as they are."""
    return df.select(column).unionAll(df.select(dna.reverse_complement(F.col(column)).alias(column)))


def read_stats(df: DataFrame, column: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., length, windows, too_short) per read, without making windows."""
    _check_k(k)
    n = F.aggregate(F.split(F.col(column), dna.BREAK), F.lit(0).cast("bigint"), lambda acc, s: acc + F.greatest(F.length(s) - k + 1, F.lit(0)))
    length = F.length(column).cast("bigint")
    return df.select(*keep, length.alias("length"), n.alias("windows"), (length < k).alias("too_short"))


def segment_stats(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., segments, longest) per read; the longest is 0 where there is none."""
    lengths = F.transform(F.filter(F.split(F.col(column), dna.BREAK), lambda s: F.length(s) > 0), lambda s: F.length(s))
    return df.select(*keep, F.size(lengths).cast("bigint").alias("segments"), F.coalesce(F.array_max(lengths), F.lit(0)).cast("bigint").alias("longest"))
