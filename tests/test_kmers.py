"""Small fixtures and a plain automaton against which random inputs are held."""

import gzip
import random

import pytest

from helixframe import operators as op
from helixframe.functions import dna, numbers
from helixframe.sources import FormatError, detect_format, read_counts, read_fasta, read_fastq, read_plain, read_sequences, write_counts
from pyspark.sql import functions as F

COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def counted(reads, k):
    """Windows one symbol at a time."""
    out = {}
    for read in reads:
        held = ""
        for c in read:
            held = (held + c.upper())[-k:] if c in "ACGTacgt" else ""
            if len(held) == k:
                key = min(held, "".join(COMP[x] for x in reversed(held)))
                out[key] = out.get(key, 0) + 1
    return out


def fasta_reads(text):
    reads, now, header = [], "", False
    for c in text:
        if header:
            header = c != "\n"
        elif c == ">":
            reads.append(now)
            now, header = "", True
        elif c != "\n":
            now += c
    return [*reads, now]


def frame(spark, reads):
    return spark.createDataFrame([(r,) for r in reads], "seq string")


def as_dict(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


@pytest.mark.parametrize(
    ("reads", "k", "want"),
    [
        (["CAT"], 3, {"ATG": 1}),
        (["ACGT"], 4, {"ACGT": 1}),
        (["acgtN", "ACGT"], 4, {"ACGT": 2}),
        (["ACNGT"], 2, {"AC": 2}),
        (["AC", "GT"], 4, {}),
        (["AAAA"], 5, {}),
        ([None, "", "AAA", "TTT"], 3, {"AAA": 2}),
    ],
)
def test_small(spark, reads, k, want):
    assert as_dict(op.count_kmers(frame(spark, reads), k=k, min_abundance=1)) == want


@pytest.mark.parametrize("k", [1, 2, 5, 16, 32, 33])
def test_random_reads(spark, k):
    rng = random.Random(k)
    reads = ["".join(rng.choice("ACGTacgtN\r -é") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    df = frame(spark, reads)
    want = counted(reads, k)
    assert as_dict(op.count_kmers(df, k=k, min_abundance=1)) == want
    assert as_dict(op.count_kmers(df, k=k, min_abundance=1, tile=7)) == want
    assert as_dict(op.count_kmers(df, k=k, min_abundance=2)) == {x: n for x, n in want.items() if n >= 2}
    assert as_dict(op.prefiltered_counts(df, k=k, min_abundance=1)) == {x: n for x, n in want.items() if n >= 2}
    rc = df.select(dna.reverse_complement(F.col("seq")).alias("seq"))
    assert as_dict(op.count_kmers(rc, k=k, min_abundance=1)) == want


@pytest.mark.parametrize("seed", range(4))
def test_fasta(spark, tmp_path, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ACGTacgt\n\n>N\r") if rng.random() < 0.3 else rng.choice("ACGT") for _ in range(600))
    text = ">" + text
    p = tmp_path / "a.fa"
    p.write_bytes(text.encode())
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(text.encode())
    want = counted(fasta_reads(text), 4)
    assert as_dict(op.count_kmers(read_sequences(spark, str(p)), k=4, min_abundance=1)) == want
    assert as_dict(op.count_kmers(read_sequences(spark, str(tmp_path / "b.fa.gz"), repartition=3), k=4, min_abundance=1)) == want
    assert as_dict(op.count_kmers(read_fasta(spark, str(p), strip_cr=True), k=4, min_abundance=1)) == counted(fasta_reads(text.replace("\r", "")), 4)


def test_fastq_and_plain(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\nACGTA\n+\n@@@@@\n@r2\nTTTTT\n+r2\n+@+@+\n")
    assert sorted(r.seq for r in read_fastq(spark, str(tmp_path / "a.fq")).collect()) == ["ACGTA", "TTTTT"]
    (tmp_path / "p.txt").write_text("ACGT\nNN\n")
    assert [r.seq for r in read_plain(spark, str(tmp_path / "p.txt")).collect()] == ["ACGT", "NN"]


def test_formats(spark, tmp_path):
    for name, data, want in [("a.fasta", b">r\nA", ("fasta", False)), ("a.fq", b"@r", ("fastq", False)), ("a.txt", b"acgt", ("plain", False)), ("e.txt", b"", ("plain", False)), ("a.fa.gz", gzip.compress(b">r"), ("fasta", True))]:
        (tmp_path / name).write_bytes(data)
        assert detect_format(spark, str(tmp_path / name)) == want
    for name, data in [("b.fasta", b"ACGT"), ("b.fq", b">r"), ("b.txt", b"xyz"), ("b.fa", gzip.compress(b">r"))]:
        (tmp_path / name).write_bytes(data)
        with pytest.raises(FormatError):
            detect_format(spark, str(tmp_path / name))


def test_sink(spark, tmp_path):
    counts = op.count_kmers(frame(spark, ["AAAAC", "AAAA"]), k=3, min_abundance=1)
    write_counts(counts, str(tmp_path / "out"), 2)
    assert as_dict(read_counts(spark, str(tmp_path / "out"))) == {"AAA": 4}
    write_counts(counts, str(tmp_path / "none"), 0)
    assert read_counts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        op.count_kmers(frame(spark, ["A"]), k=1, min_abundance=0)
    with pytest.raises(ValueError):
        op.count_kmers(frame(spark, ["A"]), k=0)


def test_lookup_compare_orient(spark):
    counts = op.count_kmers(frame(spark, ["CATCAT"]), k=3, min_abundance=1)
    q = spark.createDataFrame([("cat",), ("ATG",), ("GGG",), ("CATC",), ("CAN",), (None,)], "q string")
    assert {r.q: r["count"] for r in op.lookup(q, counts, 3).collect()} == {"cat": 2, "ATG": 2, "GGG": 0, "CATC": -1, "CAN": -1, None: -1}
    a, b = (spark.createDataFrame(x, "kmer string, count long") for x in ([("A", 1), ("C", 2)], [("A", 1), ("C", 3), ("G", 1)]))
    assert {tuple(r) for r in op.compare_counts(a, b).collect()} == {("C", 2, 3), ("G", None, 1)}
    c = spark.createDataFrame([("TTT", 3), ("AAA", 1), ("ANA", 5), ("AA", 9)], "kmer string, count long")
    assert [tuple(r) for r in op.orient_counts(c, 3).collect()] == [("AAA", 3)]


def test_edges(spark):
    got = {(r.pred, r.kmer): r["count"] for r in op.edges(frame(spark, ["AAAC", "AANAC"]), k=2, tile=2).collect()}
    assert got == {("AA", "AA"): 1, ("AA", "AC"): 1}
    assert op.predecessors(frame(spark, ["AAAC"]), "seq", 2, (), tile=1).count() == 2
    got = sorted(tuple(r) for r in op.window_symbols(frame(spark, ["ACGTNTT", None]), "seq", 2, (), tile=2).collect())
    assert [r[1:] for r in got] == [(0, "A", "C", None), (1, "C", "G", "A"), (2, "G", "T", "C"), (0, "T", "T", None)]
    assert {tuple(r) for r in op.run_lengths(frame(spark, ["AAAC", "AAN"]), "seq", 2).collect()} == {(3, 1), (1, 1)}


def test_scalars(spark):
    row = spark.range(1).select(
        *(dna.symbol_code(F.lit(c)).alias(f"c{i}") for i, c in enumerate(["g", "N", "", "T"])),
        dna.pack(F.lit("GATTACA")).alias("p"), dna.unpack(dna.pack(F.lit("GATTACA")), 7).alias("u"), dna.is_clean(F.lit("")).alias("e"), dna.is_clean(F.lit("AC\n")).alias("n"),
        dna.complement_char(F.lit("x")).alias("z"), dna.code_symbol(F.lit(4)).alias("s"), dna.canonical_sign(F.lit("ACGT")).alias("pal"), (dna.strand_hash(F.lit("CAT")) == dna.strand_hash(F.lit("ATG"))).alias("h"),
    ).first()
    assert tuple(row) == (2, 4, 4, 3, 9156, "GATTACA", True, False, "Z", "N", 0, True)


@pytest.mark.parametrize("k", [1, 30, 31, 32, 62, 63, 100])
def test_blocks(spark, k):
    s = "GATTACA" * 20
    row = spark.range(1).select(dna.unpack_blocks(dna.pack_blocks(F.lit(s[:k])), k).alias("u"), F.size(dna.pack_blocks(F.lit(s[:k]))).alias("n"), F.size(dna.pack_blocks(F.lit(""))).alias("e")).first()
    assert tuple(row) == (s[:k], -(-k // 31), 0)


def test_numbers():
    assert [numbers.next_prime(n) for n in (0, 8, 14, 7919)] == [2, 11, 17, 7919]
    assert numbers.next_prime(12, 3) == 19
    assert numbers.inverse(3, 11) == 4 and numbers.power(2, 10, 1000) == 24 and numbers.gcd(12, 18) == 6
    assert numbers.bloom_size(1000, 0.01) == (16384, 12)


def test_streaming(spark, tmp_path):
    from helixframe.streaming import stream_counts, stream_plain

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("AAA\nTTT\n")
    q = stream_counts(stream_plain(spark, str(tmp_path / "in")), k=3).writeStream.format("memory").queryName("seen").outputMode("complete").start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.txt").write_text("AAA\n")
        q.processAllAvailable()
        assert as_dict(spark.table("seen")) == {"AAA": 3}
    finally:
        q.stop()


def test_cli(tmp_path, spark, monkeypatch):
    from helixframe import cli

    (tmp_path / "r.fa").write_text(">a\nACGTACGT\n")
    assert cli.main([str(tmp_path / "r.fa"), "4", "-a", "1", "-m", "2", "-s", "100", "-o", str(tmp_path / "o")]) == 0
    assert as_dict(read_counts(spark, str(tmp_path / "o"))) == counted(["ACGTACGT"], 4)


def test_cli_options(tmp_path, spark, capsys):
    from helixframe import cli

    for bad in (["-b"], ["-u", "5"], ["-f", "0.1"], ["-b", "-u", "9", "-f", "0.9999"], ["-t", "65"], ["-t", "x"], ["-a", "-1"], ["-s", "0"], ["-s", "1", "-u", "2", "-b"], ["-c", "0"]):
        with pytest.raises(SystemExit):
            cli.checked(["r.fa", "4", *bad])
    with pytest.raises(SystemExit):
        cli.checked(["r.fa", "0"])
    reads = ["ACGTTGCA" * 40, "ACGTTGCA", "GATTACA"]
    with gzip.open(tmp_path / "r.fa.gz", "wt") as f:
        f.write("".join(f">{i}\n{r}\n" for i, r in enumerate(reads)))
    capsys.readouterr()
    assert cli.main([str(tmp_path / "r.fa.gz"), "5", "-a", "1", "-b", "-u", "100", "-f", "0.01", "-c", "30", "-o", str(tmp_path / "b")]) == 0
    want = {x: min(n, 30) for x, n in counted(reads, 5).items() if n >= 2}
    assert as_dict(read_counts(spark, str(tmp_path / "b"))) == want and max(want.values()) == 30
    assert str(len(want)) in capsys.readouterr().out
    assert cli.main([str(tmp_path / "r.fa.gz"), "5", "-a", "0", "-o", str(tmp_path / "none")]) == 0
    assert read_counts(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 15, 30, 31, 32, 33])
def test_packed_windows(spark, k):
    rng = random.Random(k)
    reads = ["".join(rng.choice("ACGTacgtN" if rng.random() < 0.05 else "ACGT") for _ in range(n)) for n in (0, 1, 30, 31, 32, 33, 61, 62, 63, 64, 93, 94, 200, 700)] + ["A" * 300, "ACGT" * 50]
    df = frame(spark, reads)
    want = counted(reads, k)
    for tile in (1, 7, 31, 100, 1 << 16):
        assert as_dict(op.count_kmers(df, k=k, min_abundance=1, tile=tile)) == want
    assert as_dict(op.count_kmers(df, k=k, min_abundance=2, both_strands=True)) == as_dict(op.count_kmers(op.with_reverse_strands(df), k=k, min_abundance=2))
    pairs = {}
    for a, b, n in ((r.pred, r.kmer, r["count"]) for r in op.edges(df, k=k, tile=13).collect()):
        pairs[a, b] = n
    slow = {}
    for seg in (s for r in reads for s in r.upper().replace("N", " ").split()):
        canon = [min(w, "".join(COMP[x] for x in reversed(w))) for w in (seg[i : i + k] for i in range(len(seg) - k + 1))]
        for a, b in zip(canon, canon[1:], strict=False):
            slow[a, b] = slow.get((a, b), 0) + 1
    assert pairs == slow
