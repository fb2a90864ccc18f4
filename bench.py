"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helixframe import plans  # noqa: E402
from helixframe.session import local_session  # noqa: E402

HEADLINE = ["kmer_count_reads_k11", "kmer_count_reads_k21", "kmer_count_reads_k31", "kmer_count_reads_k5", "kmer_count_docs_k4", "kmer_spectrum", "kmer_edges_reads_k15", "compare_counts", "union_strands", "fasta_roundtrip"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "8g", "bench")
    plans.QUERIES["kmer_count_docs_k3"](spark, sf).count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
