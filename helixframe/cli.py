"""Command line: python -m helixframe.cli INPUT K [-a N] [-o PATH]."""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from helixframe.operators.counting import count_kmers, prefiltered_counts, totals
from helixframe.session import local_session
from helixframe.sources import read_counts, read_sequences, write_counts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description="Count canonical k-mers.")
    p.add_argument("input")
    p.add_argument("k", type=int)
    p.add_argument("-a", "--min-abundance", type=int, default=2, help="0 writes nothing")
    p.add_argument("-o", "--output", help="folder; default: the input's name with .kmers")
    p.add_argument("-b", "--prefilter", action="store_true", help="drop k-mers seen once in a first pass")
    p.add_argument("-c", "--count-cap", type=int, help="show larger counts as this")
    p.add_argument("-t", "--threads", default="*", help="local cores")
    p.add_argument("-m", "--mode", type=int, choices=(0, 1, 2), help="table layout of other counters; accepted, without effect")
    sizes = p.add_mutually_exclusive_group()
    sizes.add_argument("-s", "--slots", type=int, help="table slots; accepted, without effect, as aggregates grow and spill")
    sizes.add_argument("-u", "--unique", type=int, help="expected distinct k-mers; accepted, without effect")
    p.add_argument("-f", "--fpr", type=float, help="filter's error rate; accepted, without effect, as the prefilter is exact")
    p.add_argument("--strip-cr", action="store_true", help="ignore carriage returns in FASTA")
    return p


def checked(argv: list[str] | None = None) -> argparse.Namespace:
    """The options, or an error message and exit."""
    p = parser()
    a = p.parse_args(argv)
    if a.k < 1 or a.min_abundance < 0:
        p.error("k must be positive and the abundance not negative")
    if a.threads != "*" and not (a.threads.isdigit() and 1 <= int(a.threads) <= 64):
        p.error("threads must be * or a number from 1 to 64")
    if a.prefilter != (a.unique is not None):
        p.error("the prefilter and the number of distinct k-mers go together")
    if a.fpr is not None and not (a.prefilter and 0.001 <= a.fpr <= 0.999):
        p.error("the error rate goes with the prefilter and must be from 0.001 to 0.999")
    if any(n is not None and n < 1 for n in (a.slots, a.unique, a.count_cap)):
        p.error("slots, distinct k-mers and the count cap must be positive")
    return a


def main(argv: list[str] | None = None) -> int:
    a = checked(argv)
    spark = local_session(a.threads)
    # a gzip file is read by one task, so its reads are dealt out before they expand to windows
    reads = read_sequences(spark, a.input, a.strip_cr, repartition=4 * spark.sparkContext.defaultParallelism)
    floor = max(a.min_abundance, 1)
    counts = (prefiltered_counts if a.prefilter else count_kmers)(reads, k=a.k, min_abundance=floor, count_cap=a.count_cap)
    out = a.output or f"{PurePosixPath(a.input).name.split('.')[0]}.kmers"
    write_counts(counts, out, a.min_abundance)
    # counts are made once: what was written is summed up, or nothing was written and they are made now
    print(totals(read_counts(spark, out) if a.min_abundance else counts, floor).first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
