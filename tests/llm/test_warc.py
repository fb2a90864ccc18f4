import hashlib
import random
import zlib

import pytest

from helixframe.llm import warc
from tests.oracle import same


def test_sql(spark):
    assert same(spark, "op2", warc.op2, warc.OP2_SQL) > 0


def test_cases(spark, tmp_path):
    big = "x" * 99 + "é"
    rows = [(5, "http://a/\r\nX: y", big, "k"), (3, None, big, None), (9, "u", big, ""), (9, "u", big, ""), (1, "u", "short", ""), (2, "u", "short", ""), (4, "u", None, ""), (6, "u", "", ""), (None, "u", big, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    df.repartition(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in warc.op2(spark, str(tmp_path)).collect() if r.page_id is not None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 5, sha("short"), "response", None), (2, 5, sha("short"), "response", None), (3, 101, sha(big), "response", None), (4, 0, sha(""), "response", None), (5, 101, sha(big), "revisit", 3), (6, 0, sha(""), "response", None), (9, 101, sha(big), "revisit", 3), (9, 101, sha(big), "revisit", 3)]
    assert got == want
    assert warc.op2(spark, str(tmp_path)).where("page_id is null and refers_to = 3").count() == 1
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    assert warc.op2(spark, str(tmp_path)).count() == 0


def test_large_member():
    z = warc._member(random.Random(1).randbytes(17 << 20))
    assert z[-1] == 0
    d = zlib.decompressobj(31)
    assert len(d.decompress(z)) == 17 << 20 and zlib.decompressobj(31).decompress(d.unused_data) == b""


@pytest.mark.parametrize("span", [300, 1000, 5000, 100000])
def test_chance_magic_and_ranges(spark, tmp_path, span):
    """Stored blocks show the magic inside members; small ranges cut members anywhere."""
    rng = random.Random(span)
    want = []
    for f in range(2):
        out = b""
        for i in range(150):
            payload = b"".join(rng.choice([warc.MAGIC, warc.MAGIC + b"\0", warc.MAGIC + b"\x08\0\0\0\0\0\x03", b"abc\r\n\r\n", rng.randbytes(rng.randrange(60))]) for _ in range(rng.randrange(12)))
            z = zlib.compressobj(0 if i % 2 else 6, zlib.DEFLATED, 31)
            out += z.compress(warc.record("response", f"urn:page:{f}-{i}", "u", payload, "00", None)) + z.flush()
            want.append((f"urn:page:{f}-{i}", payload))
        (tmp_path / f"a{f}.warc").write_bytes(out)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(span))
    try:
        got = sorted((r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(want)


def test_damage(spark, tmp_path):
    good = warc._member(warc.record("response", "r", "u", b"p" * 500, "00", None))
    (tmp_path / "a.warc").write_bytes(good + good[: len(good) // 2])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(tmp_path)).collect()


def archive(n, name="r", size=900):
    rng = random.Random(n)
    payloads = [rng.randbytes(size) for _ in range(n)]
    return payloads, [warc._member(warc.record("response", f"{name}{i}", "u", p, "00", None)) for i, p in enumerate(payloads)]


def test_files_named_gz_are_read_in_ranges(spark, tmp_path):
    want = []
    (tmp_path / "sub").mkdir()
    for name in ("a b.warc.gz", "c%20d.warc.gz", "plain.warc"):
        payloads, members = archive(60, name)
        (tmp_path / "sub" / name).write_bytes(b"".join(members))
        want += payloads
    (tmp_path / "sub" / "_SUCCESS").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = warc.read_warc(spark, str(tmp_path / "sub"))
        assert df.rdd.getNumPartitions() > 15
        assert sorted(bytes(r.payload) for r in df.collect()) == sorted(want)
        assert warc.read_warc(spark, str(tmp_path / "sub" / "a*.warc.gz")).count() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("span", [1500, 100000])
def test_damaged_members_are_rows(spark, tmp_path, span):
    payloads, members = archive(40)
    bad = bytearray(members[7])
    bad[len(bad) // 2] ^= 0xFF
    foreign = zlib.compressobj(6, zlib.DEFLATED, 31)
    foreign = foreign.compress(b"something else") + foreign.flush()
    parts = [*members[:7], bytes(bad), *members[8:20], members[20][: len(members[20]) // 2], *members[21:30], foreign, *members[30:39], members[39][:-20]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"GET / no archive" + members[0])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(span))
    try:
        rows = warc.read_warc(spark, str(tmp_path), damaged="row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    good = sorted(r.record_id for r in rows if r.error is None)
    assert good == sorted([*(f"r{i}" for i in range(40) if i not in (7, 20, 39)), "r0"])
    assert all(bytes(r.payload) in payloads for r in rows if r.error is None)
    errors = [r.error for r in rows if r.error]
    assert 3 <= len(errors) <= 6 and any("b.warc.gz" in e and "begin" in e for e in errors) and all(r.record_id is None for r in rows if r.error)
    with pytest.raises(Exception, match="damaged|begin"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_nulls_and_odd_lengths(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None, None, None, None, 1), ("response", "a", "u", bytearray(b"xy"), None, None, 2)], "record_type string, record_id string, target_uri string, payload binary, payload_digest string, refers_to string, extra int")
    warc.write_warc(df, str(tmp_path / "w"))
    got = sorted((r.record_type, r.record_id, r.payload_digest, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [("response", "", hashlib.sha256(b"").hexdigest(), b""), ("response", "a", hashlib.sha256(b"xy").hexdigest(), b"xy")]
    assert warc.parse(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: many\r\n\r\nbody\r\n\r\n")[5:] == (4, b"body")
