from helixframe.sources.sequences import FormatError, detect_format, read_counts, read_fasta, read_fastq, read_plain, read_sequences
from helixframe.sources.sinks import write_counts, write_counts_parquet

__all__ = ["FormatError", "detect_format", "read_counts", "read_fasta", "read_fastq", "read_plain", "read_sequences", "write_counts", "write_counts_parquet"]
