"""WARC archives: a distributed writer and a splittable reader of gzip members.

Writing. Each record is one gzip member. Tasks make members and Spark's text sink writes them, as raw bytes, with its
commit protocol, to any file system it knows. The sink ends a row with a separator; a member's last byte, the top byte of
its length field, is zero below 16 MiB, so that byte is left to a separator of one zero byte, and the file is exactly
the members. A larger member is followed by an empty one.

Reading. Tasks scan byte ranges for the gzip magic: Spark's text source with the magic as its separator does that, and a
piece belongs to the range in which it starts. A candidate counts as a member if its gzip header decodes and its content
starts as a WARC record. Compressed bytes may hold the magic by chance. Inside a range the pieces of such a member follow
one another and are decoded as one. Where a range ends within such a member, its parts are set aside by both ranges, and
a second step joins these few parts by file. The members are decoded once for records and once for these parts.

Spark decompresses files named .gz whole, in one task each. Such archives are therefore read by other names, which a mount
table of Hadoop's view file system maps to them: it holds in any store, and the bytes are read in ranges like any others.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import gathered, shared_path, small_batches, tidy, until_exit, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are never replaced by a revisit.
LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payload in one batch that the reader hands on.
BATCH = 8 << 20

RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_SCAN = f"{RECORD}, error string, file string, block long, seq long, piece binary"
_FIELDS = 7  # of RECORD


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _member(b"")


def _header(**fields: str | int | None) -> bytes:
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record's bytes: an HTTP response with the payload, or a revisit with the response's header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None
    head = _header(WARC_Type=kind, WARC_Record_ID=f"<{record_id}>", WARC_Date=DATE, WARC_Target_URI=uri, WARC_Profile=profile, WARC_Refers_To=None if refers_to is None else f"<{refers_to}>", WARC_Payload_Digest=f"sha256:{digest}", Content_Type="application/http;msgtype=response", Content_Length=len(block))
    return head + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: helixframe\r\nformat: WARC File Format 1.1\r\n"
    return _header(WARC_Type="warcinfo", WARC_Record_ID="<urn:helixframe:info>", WARC_Date=DATE, Content_Type="application/warc-fields", Content_Length=len(body)) + body + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Writes rows of record_type, record_id, target_uri, payload (binary), payload_digest (hex), refers_to to a folder.

    A null payload is empty, a null digest is the payload's SHA-256, a null type is response, and a null record_id is empty.
    Repeated rows are records each. An empty table gives a folder without records. Other columns aren't written.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            out = [_member(_info())[:-1]] if first and b.num_rows else []
            first = first and not b.num_rows
            held = 0
            for row in zip(*b.columns, strict=True):  # one row at a time, so that a worker holds a batch once
                kind, rid, uri, payload, digest, refers = (x.as_py() for x in row)
                payload = payload or b""
                digest = digest or hashlib.sha256(payload).hexdigest()
                out.append(_member(record(kind or "response", rid or "", uri, payload, digest, refers))[:-1])
                held += len(out[-1])
                if held >= BATCH // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    cols = records.select("record_type", "record_id", "target_uri", "payload", "payload_digest", "refers_to")
    small_batches(cols).mapInArrow(tidy(members), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> tuple | None:
    """A row of RECORD from a record's bytes; None for what holds no payload record, such as warcinfo. A content length that
    is missing or no number stands for the whole block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "resource", "conversion"):
        return None
    said = fields.get("content-length", "")
    block = rest[: int(said)] if re.fullmatch("[0-9]{1,18}", said) else rest.removesuffix(b"\r\n\r\n")
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = re.findall(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        size = int(sizes[0]) if sizes and kind == "revisit" else len(payload)
    else:
        payload, size = block, len(block)
    bare = lambda x: None if x is None else x.strip("<>")
    return kind, bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").rpartition(":")[2] or None, size, None if kind == "revisit" else payload


class _Machine:
    """Decodes pieces of one range in order; sets aside what another range must complete.

    What is damaged raises, or with lenient is noted in wrong, and decoding goes on at the next member.
    """

    def __init__(self, at_start: bool, lenient: bool = False):
        self.sure, self.lenient, self.lost = at_start, lenient, False
        self.records: list[bytes] = []
        self.aside: list[tuple[bool, bytes]] = []  # does a member surely start here, piece
        self.wrong: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.d, self.raw, self.text = None, [], []

    def feed(self, piece: bytes) -> None:
        waiting = [MAGIC + piece]
        while waiting:
            waiting = self._take(waiting[0]) + waiting[1:]

    def _take(self, data: bytes) -> list[bytes]:
        """Decodes one piece; pieces that must be looked at again come back."""
        while data:
            if self.d is None:
                self.d = zlib.decompressobj(31)
            self.raw.append(data)
            try:
                got = self.d.decompress(data)
            except zlib.error as e:
                return self._wrong(f"the archive is damaged: {e}")
            if got:
                self.text.append(got)
            if (self.text or self.d.eof) and not b"WARC/".startswith(b"".join(self.text[:5])[:5]):
                return self._wrong("the archive is damaged: a gzip member that is no WARC record")
            if not self.d.eof:
                return []
            data = self.d.unused_data.lstrip(b"\0")
            if self.text:
                self.records.append(b"".join(self.text))
            self.sure, self.lost = True, False
            self._clear()
        return []

    def _wrong(self, why: str) -> list[bytes]:
        raw = self.raw
        self._clear()
        if not self.sure:  # the end of a member that began in an earlier range
            self.aside += [(False, x) for x in raw]
            return []
        if not self.lenient:
            raise ValueError(why)
        if not self.lost:
            self.wrong.append(why)
        self.lost = True
        return raw[1:]  # a whole member may follow the damage

    def end(self) -> None:
        """No more of the member that is being decoded."""
        if self.d is not None:
            why = "the archive ends within a record"
            if not self.lenient:
                raise ValueError(why)
            self.wrong.append(why)
            self._clear()
        self.lost = False

    def close(self) -> None:
        if self.d is not None:
            self.aside += [(self.sure and i == 0, x) for i, x in enumerate(self.raw)]


def _plain_names(spark: SparkSession, path: str) -> tuple[list[str], dict[str, str]]:
    """Paths of the archives that a path, folder or pattern names, and options for readers under which those named .gz go
    by names that don't end so. Names that begin with a dot or an underscore are left out, as Spark does."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for at in fs.globStatus(top) or [] for x in (fs.listStatus(at.getPath()) if at.isDirectory() else [at])]
    files = [x.getPath() for x in found if x.isFile() and x.getPath().getName()[:1] not in "._"]
    if not any(x.getName().endswith(".gz") for x in files):
        return [path], {}
    mount, folders, paths = f"n{uuid.uuid4().hex}", {}, []
    for x in files:
        if x.getName().endswith(".gz"):
            folder = folders.setdefault(x.getParent().toUri().toString(), len(folders))
            paths.append(f"viewfs://{mount}/{folder}/{quote(x.getName(), safe='')}.raw")  # the mount decodes names
        else:
            paths.append(x.toString())
    return paths, {f"fs.viewfs.mounttable.{mount}.linkRegex.^/{i}/(?<name>.+)[.]raw$": f"{folder.rstrip('/')}/${{name}}" for folder, i in folders.items()}


def read_warc(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """Rows of RECORD for each response, revisit, resource and conversion record of the archives of a folder, of one
    archive, or of those that a pattern names.

    payload_bytes is the full payload's length, for a revisit from its HTTP header; its payload is null. Empty archives
    give no rows. A damaged archive raises; with damaged="row" there is a column error, null in good rows, and a
    stretch that can't be read gives a row with the file and the error and nothing else, and reading goes on at the next
    record that can.
    """
    if damaged not in ("raise", "row"):
        raise ValueError("damaged must be raise or row")
    lenient = damaged == "row"
    paths, options = _plain_names(spark, path)
    empty = "file_path string, file_block_start long, piece binary"
    pieces = spark.read.options(**options).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    if paths:
        pieces = pieces.text(paths).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("piece"))
    else:
        pieces = spark.createDataFrame([], empty)
    kind = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("piece", pa.binary())])

    def found(m: _Machine, file: str) -> list[tuple]:
        """Rows of what the machine has read; it forgets them."""
        file = unquote(unquote(file)).removesuffix(".raw") if options else file
        rows = [(*r, None) for x in m.records if (r := parse(x))] + [(*[None] * _FIELDS, f"{file}: {why}") for why in m.wrong]
        m.records.clear()
        m.wrong.clear()
        return rows

    def scan(want_records: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, m, rows, held = None, None, [], 0

            def take() -> list[tuple]:
                if m is None:
                    return []
                if want_records:
                    return [(*r, None, None, None, None) for r in found(m, key[0])]
                m.records.clear()
                m.wrong.clear()
                return []

            def finish() -> list[tuple]:
                last = take()
                if m is not None and not want_records:
                    m.close()
                    last += [(*[None] * (_FIELDS + 1), *key, 2 * i + starts, x) for i, (starts, x) in enumerate(m.aside)]
                return last

            for b in batches:
                for row in zip(*b.columns, strict=True):
                    file, block, piece = (x.as_py() for x in row)
                    if (file, block) != key:
                        rows += finish()
                        key, m = (file, block), _Machine(block == 0, lenient)
                        if block == 0:  # what comes before the first magic
                            if piece.strip(b"\0"):
                                if not lenient:
                                    raise ValueError(f"{file} doesn't begin with a gzip member")
                                m.wrong.append("the archive doesn't begin with a gzip member")
                            continue
                    m.feed(piece)
                    new = take()
                    held += sum(len(r[6] or b"") for r in new)
                    rows += new
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
                        rows, held = [], 0
            rows += finish()
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

        return run

    def mend(table: pa.Table) -> pa.Table:
        m, file = _Machine(True, lenient), table["file"][0].as_py()
        table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
        for seq, piece in zip(table["seq"].to_pylist(), table["piece"].to_pylist(), strict=True):
            if seq % 2:  # a member starts, which ends the one before
                m.end()
            m.feed(piece.removeprefix(MAGIC))
        m.end()
        return pa.Table.from_pylist([dict(zip(kind.names, r, strict=False)) for r in found(m, file)], pa.schema(list(kind)[: _FIELDS + 1]))

    whole = small_batches(pieces).mapInArrow(tidy(scan(True)), _SCAN).drop("file", "block", "seq", "piece")
    broken = pieces.mapInArrow(tidy(scan(False)), _SCAN).select("file", "block", "seq", "piece")
    out = whole.unionByName(broken.groupBy("file").applyInArrow(mend, f"{RECORD}, error string"))
    return out if lenient else out.drop("error")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record per page: of pages with equal payloads of LEAST_SHARED bytes or more, the smallest id is the response and
    others revisit it. A null payload is empty; one of any length is whole. An empty table stays empty. Repeated rows of
    that smallest id are all responses. A null id is never the smallest unless all are null, then all are responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), html.cast("binary").alias("payload"), F.sha2(html, 256).alias("payload_digest"))
    slim = written(p.where(F.length("payload") >= LEAST_SHARED).select("page_id", "payload_digest"), "digests")
    shared = slim.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and first is not null")
    again = slim.join(shared, slim.payload_digest == shared["_digest"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), "_digest", "first").distinct()
    out = p.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return out.select(F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri", "payload", "payload_digest", F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archive")
    write_warc(gathered(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))), path)
    until_exit(spark, path)
    got = read_warc(spark, path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast("bigint")
    digest = F.when(F.col("record_type") == "response", F.sha2(F.col("payload"), 256)).otherwise(F.col("payload_digest"))
    return got.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))


OP2_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to FROM f"""
