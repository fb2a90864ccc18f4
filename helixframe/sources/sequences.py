"""Readers of sequence files; each returns rows of one column, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FormatError(ValueError):
    """The file's first symbol doesn't fit its name, or its compression can't be read."""


def _first_bytes(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """Two raw bytes and the first decompressed one, through Hadoop's file systems, so that remote paths work."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        return b"", b""

    def read(stream, n: int) -> bytes:
        try:
            got = [stream.read() for _ in range(n)]
        finally:
            stream.close()
        return bytes(b for b in got if b >= 0)

    raw = read(fs.open(at), 2)
    return raw, read(jvm.java.util.zip.GZIPInputStream(fs.open(at)), 1) if raw == b"\x1f\x8b" else raw[:1]


def detect_format(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(format, gzipped) of a file: the format by its extension, gzip by its first two bytes.

    FASTA must begin with '>', FASTQ with '@', anything else with a symbol; FormatError otherwise, and for gzip content
    under a name without .gz, because the codec is chosen by name. An empty file is well formed.
    """
    raw, first = _first_bytes(spark, path)
    gz, name = raw == b"\x1f\x8b", path.lower().removesuffix(".gz")
    if gz and not path.lower().endswith(".gz"):
        raise FormatError(f"{path} is gzip data without .gz in its name")
    kind = "fasta" if name.endswith((".fasta", ".fa")) else "fastq" if name.endswith((".fastq", ".fq")) else "plain"
    allowed = {"fasta": b">", "fastq": b"@", "plain": b"acgtACGT"}[kind]
    if first and first not in [allowed[i : i + 1] for i in range(len(allowed))]:
        raise FormatError(f"{path} is ill-formed: a {kind} file can't begin with {first!r}")
    return kind, gz


def read_fasta(spark: SparkSession, path: str | list[str], strip_cr: bool = False) -> DataFrame:
    """A row per record. '>' outside a header begins a new record, the header runs to its newline, lines are joined.

    The reader splits at '>' itself, so large uncompressed files are cut over many tasks. A '>' inside a header leaves a
    piece without sequence, which changes nothing. strip_cr drops carriage returns, which otherwise break windows.
    """
    rows = spark.read.option("lineSep", ">").text(path)
    end = F.instr("value", "\n")
    body = F.when(end == 0, F.lit("")).otherwise(F.translate(F.substring(F.col("value"), end + 1, F.length("value")), "\n\r" if strip_cr else "\n", ""))
    return rows.select(body.alias("seq")).where(F.length("seq") > 0)


def read_plain(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per line."""
    return spark.read.text(path).select(F.col("value").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequence lines of four-line records.

    An extension. A record is found by its separator: a line that begins with '+' after a line of letters, which follows
    a line that begins with '@'. Splitting at "\\n@" could cut at a quality line, so a piece counts only if its third
    line begins with '+'.
    """
    rows = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split(F.translate("value", "\r", ""), "\n")
    return rows.select(lines.alias("l")).where((F.size("l") >= 3) & F.get("l", F.lit(2)).startswith("+")).select(F.get("l", F.lit(1)).alias("seq"))


def read_sequences(spark: SparkSession, path: str, strip_cr: bool = False, repartition: int | None = None) -> DataFrame:
    """Detects the format and reads. gzip files are one task each; repartition deals their rows out for the work after."""
    kind, gz = detect_format(spark, path)
    df = read_fasta(spark, path, strip_cr) if kind == "fasta" else read_fastq(spark, path) if kind == "fastq" else read_plain(spark, path)
    return df.repartition(repartition) if repartition and gz else df


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, count) of a text file of 'KMER COUNT' lines; lines of another shape are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("kmer"), F.get(parts, F.lit(1)).try_cast("bigint").alias("count")).where("count is not null")
