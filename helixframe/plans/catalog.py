"""Named queries over the test tables, each with equivalent SQL for another engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import operators as op
from helixframe.functions import dna, numbers
from helixframe.sources import FormatError, detect_format, read_fasta, read_fastq, read_plain, write_counts, read_counts

Query = Callable[[SparkSession, str], DataFrame]

#: 32-base reads made from the line items' keys.
READ = "translate(md5(concat_ws('|', l_orderkey, l_linenumber)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table in fewer splits than there are cores, dealt over all of them before they expand to windows.

    Rows go by their numbers: dealing them round robin would sort each split first, so that lost tasks repeat the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(cores, "_row").drop("_row")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("seq"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return dealt(df).select("l_linenumber", F.expr(READ).alias("seq"))


def _forward_counts(df: DataFrame, k: int) -> DataFrame:
    w = op.windows(df, "seq", k, positions=True).select(F.col("forward").alias("kmer"))
    return op.count_windows(w)


def _shared(spark: SparkSession) -> str:
    """A new folder that every executor can reach."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/reads-{uuid.uuid4().hex}"


def _through_files(kind: str) -> Query:
    """Writes the reads in a format, reads them back and counts."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path, df = _shared(spark), reads(spark, sf).select("seq")
        if kind == "counts":
            write_counts(op.count_kmers(df, k=11), path)
            return read_counts(spark, path)
        half = lambda at: F.substring("seq", 1 + 16 * at, 16)
        if kind == "fastq":
            line = F.concat_ws("\n", F.lit("@read"), "seq", F.lit("+"), F.lit("@" * 32))
        elif kind == "plain":
            line = F.col("seq")
        else:
            line = F.concat_ws("\n", F.lit(">read > of two lines"), half(0), half(1))
        w = df.select(line.alias("value")).write
        (w.option("compression", "gzip") if kind == "gzip" else w).text(path)
        read = {"plain": read_plain, "fastq": read_fastq}.get(kind, read_fasta)
        return op.count_kmers(read(spark, path), k=11)

    return run


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.sql("SELECT * FROM VALUES ('CAT'), ('ATG'), ('cat'), ('GGGG'), ('NNN'), ('AAC'), ('CCC') AS t(q)")
    return op.lookup(asked, op.count_kmers(docs(spark, sf), k=3, min_abundance=1), 3)


def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr(READ).alias("s"))
    s, c = F.col("s"), F.left(F.col("s"), F.lit(1))
    return r.select(
        s, dna.reverse_complement(s).alias("rc"), dna.canonical(s).alias("canon"), dna.canonical_sign(F.left(s, F.lit(4))).alias("sign4"), dna.is_clean(s).alias("clean"),
        dna.pack(F.left(s, F.lit(31))).alias("packed"), dna.unpack(dna.pack(F.left(s, F.lit(31))), 31).alias("unpacked"), dna.symbol_code(c).alias("code"), dna.code_symbol(dna.symbol_code(c)).alias("symbol"),
        dna.complement_code(dna.symbol_code(c)).alias("comp_code"), dna.complement_char(c).alias("comp"), F.array_join(dna.pack_blocks(s).cast("array<string>"), ",").alias("blocks"), dna.unpack_blocks(dna.pack_blocks(s), 32).alias("unblocked"),
    )


def _compare(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    even, odd = r.where("l_linenumber % 2 = 0"), r.where("l_linenumber % 2 = 1")
    return op.compare_counts(op.count_kmers(even, k=7, min_abundance=1), op.count_kmers(odd, k=7, min_abundance=1))


def _strands(spark: SparkSession, sf: str) -> DataFrame:
    w = op.windows(docs(spark, sf), "seq", 3, ("doc_id",), positions=True)
    symbols = [op.symbol_at(F.col("forward"), i, back).alias(f"{'back' if back else 'forward'}_{i}") for back in (False, True) for i in range(3)]
    return w.select("doc_id", "seg_id", "pos", F.col("kmer").cast("string").alias("canonical"), F.col("noncanonical").cast("string").alias("noncanonical"), "is_forward", *symbols)


#: (file name, first line) of small files whose formats are told.
_SAMPLES = (("a.fa", ">r"), ("b.fasta.gz", ">r"), ("c.fq", "@r"), ("d.txt", "ACGT"), ("e.fa", "ACGT"), ("f.gz", "acgt"), ("g.seq", "NACGT"))


def _formats(spark: SparkSession, sf: str) -> DataFrame:
    rows, top = [], _shared(spark)
    for name, line in _SAMPLES:
        folder = f"{top}-{name}"
        spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.option("compression", "gzip" if name.endswith(".gz") else "none").text(folder)
        (file,) = spark.read.text(folder).inputFiles()
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        named = f"{folder}/{name}"
        at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(named))
        try:
            rows.append((name, *detect_format(spark, named)))
        except FormatError:
            rows.append((name, "ill-formed", name.endswith(".gz")))
    return spark.createDataFrame(rows, "name string, format string, gzipped boolean")


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, numbers.next_prime(n), numbers.next_prime(n, 3), numbers.inverse(n, 211), numbers.power(n, 5, 97), numbers.gcd(n, 60)) for n in range(1, 201)]
    return spark.createDataFrame(rows, "n long, prime long, prime3mod4 long, inverse long, power long, gcd long")


def _filter_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, f, *numbers.bloom_size(n, f)) for n in (1000, 123_456, 4_000_000, 10**9) for f in (0.5, 0.01, 0.001)]
    return spark.createDataFrame(rows, "n long, fpr double, bits long, hashes long")


def _strand_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the hash is the same for both strands of each read, and how many different values there are."""
    r = reads(spark, sf).select(dna.strand_hash(F.col("seq")).alias("h"), dna.strand_hash(dna.reverse_complement(F.col("seq"))).alias("g"))
    return r.agg(F.count(F.when(F.col("h") == F.col("g"), 1)).alias("same"), F.countDistinct("h").alias("hashes"))


def _reads(k: int, a: int = 2, **more) -> Query:
    return lambda s, d: op.count_kmers(reads(s, d), k=k, min_abundance=a, **more)


def _docs(k: int, a: int = 2) -> Query:
    return lambda s, d: op.count_kmers(docs(s, d), k=k, min_abundance=a)


QUERIES: dict[str, Query] = {
    "kmer_count_docs_k3": _docs(3),
    "kmer_count_docs_k3_a1": _docs(3, 1),
    "kmer_count_docs_k4": _docs(4),
    "kmer_count_reads_k5": _reads(5, 1),
    "kmer_count_reads_k11": _reads(11),
    "kmer_count_reads_k11_a5": _reads(11, 5),
    "kmer_count_reads_k21": _reads(21),
    "kmer_count_reads_k31": _reads(31),
    "kmer_count_reads_k32": _reads(32),
    "kmer_count_capped": _reads(5, 1, count_cap=1000),
    "kmer_prefiltered": lambda s, d: op.prefiltered_counts(reads(s, d), k=11),
    "kmer_spectrum": lambda s, d: op.spectrum(op.count_kmers(reads(s, d), k=11, min_abundance=1)),
    "abundance_summary": lambda s, d: op.abundance_summary(op.count_kmers(reads(s, d), k=11, min_abundance=1)),
    "kmer_totals": lambda s, d: op.totals(op.count_kmers(reads(s, d), k=11, min_abundance=1)),
    "kmer_edges": lambda s, d: op.edges(docs(s, d), k=3),
    "kmer_edges_reads_k15": lambda s, d: op.edges(reads(s, d), k=15, min_abundance=2),
    "kmer_predecessors": lambda s, d: op.predecessors(docs(s, d), "seq", 3, ("doc_id",)),
    "kmer_window_symbols": lambda s, d: op.window_symbols(docs(s, d), "seq", 3, ("doc_id",)),
    "run_lengths": lambda s, d: op.run_lengths(docs(s, d), "seq", 3),
    "kmer_lookup": _lookup,
    "union_strands": lambda s, d: op.count_kmers(reads(s, d), k=11, min_abundance=1, both_strands=True),
    "compare_counts": _compare,
    "orient_counts": lambda s, d: op.orient_counts(_forward_counts(docs(s, d), 3), 3),
    "read_lengths": lambda s, d: op.read_stats(docs(s, d), "seq", 5, ("doc_id",)),
    "segments": lambda s, d: op.segment_stats(docs(s, d), "seq", ("doc_id",)),
    "dna_scalars": _scalars,
    "fasta_roundtrip": _through_files("fasta"),
    "plain_roundtrip": _through_files("plain"),
    "gzip_fasta": _through_files("gzip"),
    "fastq_roundtrip": _through_files("fastq"),
    "count_file_roundtrip": _through_files("counts"),
    "kmer_strands": _strands,
    "table_slots": lambda s, d: op.table_slots(op.count_kmers(reads(s, d), k=11, min_abundance=1)),
    "file_formats": _formats,
    "number_helpers": _numbers,
    "filter_sizes": _filter_sizes,
    "strand_hashes": _strand_hashes,
}


def _windows_sql(source: str, table: str, k: int) -> str:
    return f"""seg AS (SELECT unnest(regexp_extract_all({source}, '[ACGTacgt]+')) AS seg FROM {table}),
     win AS (SELECT upper(seg[i:i+{k - 1}]) AS f FROM (SELECT seg, unnest(generate_series(1, length(seg)-{k - 1})) AS i FROM seg WHERE length(seg) >= {k}))"""


def _count_sql(source: str, table: str, k: int, a: int) -> str:
    return f"""WITH {_windows_sql(source, table, k)}
SELECT kmer, count(*) AS count FROM (SELECT least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer FROM win) GROUP BY kmer HAVING count(*) >= {a}"""


def _of_reads(k: int, a: int = 2, where: str = "") -> str:
    return _count_sql(READ, f"lineitem{where}", k, a)


def _of_docs(k: int, a: int = 2) -> str:
    return _count_sql("text", "documents", k, a)


def _canon(x: str) -> str:
    return f"least({x}, translate(reverse({x}), 'ACGT', 'TGCA'))"


def _edges_sql(source: str, table: str, k: int, a: int) -> str:
    return f"""WITH {_windows_sql(source, table, k + 1)}
SELECT {_canon(f"f[1:{k}]")} AS pred, {_canon(f"f[2:{k + 1}]")} AS kmer, count(*) AS count FROM win GROUP BY ALL HAVING count(*) >= {a}"""


_PRED = f"""WITH seg AS (SELECT doc_id, unnest(string_split_regex(text, '[^ACGTacgt]+')) AS seg, generate_subscripts(string_split_regex(text, '[^ACGTacgt]+'), 1) - 1 AS seg_id FROM documents),
 w AS (SELECT doc_id, seg_id, i, upper(seg[i:i+2]) AS a, upper(seg[i+1:i+3]) AS b FROM (SELECT *, unnest(generate_series(1, length(seg)-3)) AS i FROM seg WHERE length(seg) >= 4))
SELECT doc_id, CAST(seg_id AS INTEGER) AS seg_id, CAST(i AS BIGINT) AS pos, {_canon("a")} AS pred, {_canon("b")} AS kmer, a <= translate(reverse(a), 'ACGT', 'TGCA') AS pred_is_forward,
 b <= translate(reverse(b), 'ACGT', 'TGCA') AS is_forward, ({_canon("b")})[1:1] AS first, ({_canon("b")})[3:3] AS last FROM w"""

_SYMBOLS = """WITH seg AS (SELECT doc_id, unnest(string_split_regex(text, '[^ACGTacgt]+')) AS s, generate_subscripts(string_split_regex(text, '[^ACGTacgt]+'), 1) - 1 AS seg_id FROM documents),
 w AS (SELECT doc_id, seg_id, upper(s) AS s, unnest(generate_series(1, length(s)-2)) AS i FROM seg WHERE length(s) >= 3)
SELECT doc_id, CAST(seg_id AS INTEGER) AS seg_id, CAST(i - 1 AS BIGINT) AS pos, s[i:i] AS leftmost, s[i+2:i+2] AS rightmost, CASE WHEN i > 1 THEN s[i-1:i-1] END AS pushed_off FROM w"""

_STRANDS = f"""WITH seg AS (SELECT doc_id, unnest(string_split_regex(text, '[^ACGTacgt]+')) AS seg, generate_subscripts(string_split_regex(text, '[^ACGTacgt]+'), 1) - 1 AS seg_id FROM documents),
 w AS (SELECT doc_id, seg_id, i, upper(seg[i:i+2]) AS f, translate(reverse(upper(seg[i:i+2])), 'ACGT', 'TGCA') AS b FROM (SELECT *, unnest(generate_series(1, length(seg)-2)) AS i FROM seg WHERE length(seg) >= 3))
SELECT doc_id, CAST(seg_id AS INTEGER) AS seg_id, CAST(i - 1 AS BIGINT) AS pos, least(f, b) AS canonical, greatest(f, b) AS noncanonical, f <= b AS is_forward,
 f[1:1] AS forward_0, f[2:2] AS forward_1, f[3:3] AS forward_2, b[1:1] AS back_0, b[2:2] AS back_1, b[3:3] AS back_2 FROM w"""

_NUMBERS = """WITH p AS (SELECT n FROM range(2, 300) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 18) d(k) WHERE k < n AND n % k = 0))
SELECT n, (SELECT min(p.n) FROM p WHERE p.n >= r.n) AS prime, (SELECT min(p.n) FROM p WHERE p.n >= r.n AND p.n % 4 = 3) AS prime3mod4,
 (SELECT min(x) FROM range(1, 211) i(x) WHERE x * r.n % 211 = 1) AS inverse, n * n * n * n * n % 97 AS power, gcd(n, 60) AS gcd FROM range(1, 201) r(n)"""

ORACLES: dict[str, str] = {
    "kmer_strands": _STRANDS,
    "table_slots": f"SELECT CAST(2 * count(*) AS BIGINT) AS slots FROM ({_of_reads(11)})",
    "file_formats": "SELECT * FROM (VALUES ('a.fa', 'fasta', false), ('b.fasta.gz', 'fasta', true), ('c.fq', 'fastq', false), ('d.txt', 'plain', false), ('e.fa', 'ill-formed', false), ('f.gz', 'plain', true), ('g.seq', 'ill-formed', false)) t(name, format, gzipped)",
    "number_helpers": _NUMBERS,
    "filter_sizes": """SELECT n, fpr, CAST(bits AS BIGINT) AS bits, CAST(ceil(bits / n * ln(2)) AS BIGINT) AS hashes
FROM (SELECT *, pow(2, ceil(log2(-n * ln(fpr) / pow(ln(2), 2)))) AS bits FROM (SELECT CAST(n AS BIGINT) AS n, CAST(fpr AS DOUBLE) AS fpr FROM (VALUES (1000), (123456), (4000000), (1000000000)) a(n), (VALUES (0.5), (0.01), (0.001)) b(fpr)))""",
    "strand_hashes": f"SELECT count(*) AS same, count(DISTINCT {_canon('s')}) AS hashes FROM (SELECT {READ} AS s FROM lineitem)",
    "kmer_window_symbols": _SYMBOLS,
    "kmer_count_docs_k3": _of_docs(3),
    "kmer_count_docs_k3_a1": _of_docs(3, 1),
    "kmer_count_docs_k4": _of_docs(4),
    "kmer_count_reads_k5": _of_reads(5, 1),
    "kmer_count_reads_k11": _of_reads(11),
    "kmer_count_reads_k11_a5": _of_reads(11, 5),
    "kmer_count_reads_k21": _of_reads(21),
    "kmer_count_reads_k31": _of_reads(31),
    "kmer_count_reads_k32": _of_reads(32),
    "kmer_count_capped": f"SELECT kmer, least(count, 1000) AS count FROM ({_of_reads(5, 1)})",
    "kmer_prefiltered": _of_reads(11),
    "kmer_spectrum": f"SELECT count AS abundance, count(*) AS kmers FROM ({_of_reads(11, 1)}) GROUP BY 1",
    "abundance_summary": "SELECT count_if(count=1) AS eq1, count_if(count=2) AS eq2, count_if(count=3) AS eq3, count_if(count>3) AS gt3, count_if(count>=1) AS ge1, count_if(count>=2) AS ge2, count_if(count>=3) AS ge3, count_if(count>3) AS over3 FROM (SELECT CAST(count AS BIGINT) AS count FROM (" + _of_reads(11, 1) + "))",
    "kmer_totals": f"SELECT count(*) AS distinct_kmers, CAST(coalesce(sum(count), 0) AS BIGINT) AS windows, count(*) FILTER (count >= 2) AS written, count(*) FILTER (count < 2) AS skipped FROM ({_of_reads(11, 1)})",
    "kmer_edges": _edges_sql("text", "documents", 3, 1),
    "kmer_edges_reads_k15": _edges_sql(READ, "lineitem", 15, 2),
    "kmer_predecessors": _PRED,
    "run_lengths": "SELECT CAST(length(seg) - 2 AS BIGINT) AS run_length, count(*) AS runs FROM (SELECT unnest(regexp_extract_all(text, '[ACGTacgt]+')) AS seg FROM documents) WHERE length(seg) >= 3 GROUP BY 1",
    "kmer_lookup": f"""SELECT q, CAST(CASE WHEN length(q) <> 3 OR NOT regexp_full_match(q, '[ACGTacgt]*') THEN -1 ELSE coalesce(count, 0) END AS BIGINT) AS count
FROM (VALUES ('CAT'), ('ATG'), ('cat'), ('GGGG'), ('NNN'), ('AAC'), ('CCC')) t(q) LEFT JOIN ({_of_docs(3, 1)}) c ON c.kmer = {_canon("upper(q)")}""",
    "union_strands": f"SELECT kmer, 2 * count AS count FROM ({_of_reads(11, 1)})",
    "compare_counts": f"""SELECT coalesce(l.kmer, r.kmer) AS kmer, l.count AS left_count, r.count AS right_count
FROM ({_of_reads(7, 1, " WHERE l_linenumber % 2 = 0")}) l FULL JOIN ({_of_reads(7, 1, " WHERE l_linenumber % 2 = 1")}) r ON l.kmer = r.kmer WHERE l.count IS DISTINCT FROM r.count""",
    "orient_counts": f"WITH {_windows_sql('text', 'documents', 3)} SELECT {_canon('f')} AS kmer, count FROM (SELECT f, count(*) AS count FROM win GROUP BY f HAVING count(*) >= 2)",
    "read_lengths": "SELECT doc_id, CAST(length(text) AS BIGINT) AS length, CAST(coalesce(list_sum([greatest(length(s) - 4, 0) FOR s IN regexp_extract_all(text, '[ACGTacgt]+')]), 0) AS BIGINT) AS windows, length(text) < 5 AS too_short FROM documents",
    "segments": "SELECT doc_id, CAST(len(x) AS BIGINT) AS segments, CAST(coalesce(list_max([length(s) FOR s IN x]), 0) AS BIGINT) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '[ACGTacgt]+') AS x FROM documents)",
    "dna_scalars": f"""SELECT s, translate(reverse(s), 'ACGT', 'TGCA') AS rc, {_canon("s")} AS canon,
 CAST(CASE WHEN s[1:4] < translate(reverse(s[1:4]), 'ACGT', 'TGCA') THEN 1 WHEN s[1:4] > translate(reverse(s[1:4]), 'ACGT', 'TGCA') THEN -1 ELSE 0 END AS INTEGER) AS sign4, regexp_full_match(s, '[ACGTacgt]*') AS clean,
 CAST(list_reduce(list_concat([0::HUGEINT], [CAST(instr('ACGT', c) - 1 AS HUGEINT) FOR c IN string_split(s[1:31], '')]), lambda a, b: a * 4 + b) AS BIGINT) AS packed, s[1:31] AS unpacked,
 CAST(instr('ACGT', s[1:1]) - 1 AS INTEGER) AS code, s[1:1] AS symbol, CAST(4 - instr('ACGT', s[1:1]) AS INTEGER) AS comp_code, translate(s[1:1], 'ACGT', 'TGCA') AS comp,
 CAST(list_reduce(list_concat([0::HUGEINT], [CAST(instr('ACGT', c) - 1 AS HUGEINT) FOR c IN string_split(s[1:31], '')]), lambda a, b: a * 4 + b) AS VARCHAR) || ',' || CAST(instr('ACGT', s[32:32]) - 1 AS VARCHAR) AS blocks, s AS unblocked FROM (SELECT {READ} AS s FROM lineitem)""",
    "fasta_roundtrip": _of_reads(11),
    "plain_roundtrip": _of_reads(11),
    "gzip_fasta": _of_reads(11),
    "fastq_roundtrip": _of_reads(11),
    "count_file_roundtrip": _of_reads(11),
}
