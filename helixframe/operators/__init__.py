from helixframe.operators.compare import compare_counts, orient_counts
from helixframe.operators.counting import abundance_summary, count_kmers, count_windows, prefiltered_counts, spectrum, table_slots, totals
from helixframe.operators.graph import edges, predecessors, run_lengths
from helixframe.operators.lookup import lookup
from helixframe.operators.windows import read_stats, segments, segment_stats, symbol_at, window_symbols, windows, with_reverse_strands

__all__ = [
    "abundance_summary", "compare_counts", "count_kmers", "count_windows", "edges", "lookup", "orient_counts", "predecessors", "prefiltered_counts",
    "read_stats", "run_lengths", "segment_stats", "segments", "spectrum", "symbol_at", "table_slots", "totals", "window_symbols", "windows", "with_reverse_strands",
]
