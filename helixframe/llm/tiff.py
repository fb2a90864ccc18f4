"""TIFF columns: a decoder that emits one row per page, and a writer of lossless grey images.

The decoder walks the chain of image directories in either byte order, decodes strips or tiles stored plain or by
PackBits, LZW or deflate, undoes horizontal and floating-point predictors, joins separate planes, and gives the samples
of each page row by row. It reads whole-byte samples and bilevel pages. Fields are checked for type and sizes against the
strips or tiles that are there before memory is taken, so a damaged file gives an error and no more.

The writer stores a payload under one of LAYOUTS, which its checksum picks: equal payloads give equal files, and a corpus
goes through every codec, in strips and in tiles.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from helixframe.llm.common import small_batches, tidy

#: Fixed tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_SIZE, PLANES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT, FILL = 322, 323, 324, 325, 339, 266
#: Fixed codes of compression.
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Fixed sizes and letters of field types 1 to 12.
_KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Fixed bounds of what one byte of a codec's data can become.
_MOST = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
#: Bytes of samples in a page; a binary value can't hold more.
MOST_BYTES = (1 << 31) - 1
#: Samples per row, and rows per strip, of what the writer makes, and its tiles' width and height.
ROW, STRIP_ROWS, TILE = 64, 1024, (32, 64)
#: (compression, in tiles?) of which a payload's checksum picks one; most are deflate in strips, as that is the smallest.
LAYOUTS = ((LZW, False), (LZW, True), (PACKBITS, False), (PACKBITS, True), (PLAIN, False), (PLAIN, True), (DEFLATE, True), *[(DEFLATE, False)] * 9)
_RUN = re.compile(rb"(?s)(.)\1{2,127}")
#: A worker hands its rows on when their samples reach so many bytes.
BATCH = 8 << 20


class TiffError(ValueError):
    """The bytes aren't a TIFF file that this decoder reads."""


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count of literal bytes, or of repeats of one."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that widen one entry early; 256 clears the table, 257 ends."""
    out = bytearray()
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, b""
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("an LZW code out of order")
        out += entry
        if last and len(table) < 4096:  # a code can't name more entries
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits of one row: runs of three and more equal bytes as repeats, the rest as literals."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """What unpack_lzw reads; the table is cleared before its codes need more than 12 bits."""
    out, bits, held = bytearray(), 256, 9  # begins with a clear code
    table: dict[int, int] = {}
    width, free, prefix = 9, 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        bits, held = bits << width | prefix, held + width
        table[key] = free
        free += 1
        if free == 4094:
            bits, held = bits << width | 256, held + width
            table, width, free = {}, 9, 258
        elif free == 1 << width:
            width += 1
        if held >= 64:
            held -= 64
            out += (bits >> held).to_bytes(8, "big")
            bits &= (1 << held) - 1
        prefix = byte
    if prefix >= 0:
        bits, held, free = bits << width | prefix, held + width, free + 1
        width += free == 1 << width
    bits, held = bits << width | 257, held + width
    pad = -held % 8
    return bytes(out) + (bits << pad).to_bytes((held + pad) // 8, "big")


def _decompress(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        out = data
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    elif how == PACKBITS:
        out = unpack_bits(data, size)
    elif how == LZW:
        out = unpack_lzw(data, size)
    else:
        raise TiffError(f"compression {how} isn't supported")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:4] not in (b"II*\0", b"MM\0*") or len(data) < 8:
            raise TiffError("no TIFF header")
        self.order = "<" if data[:2] == b"II" else ">"

    def take(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > len(self.data):
            raise TiffError("an offset lies outside the file")
        return self.data[at : at + n]

    def number(self, at: int, letter: str) -> int:
        return struct.unpack(self.order + letter, self.take(at, struct.calcsize(letter)))[0]

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.number(4, "I"), set()
        while at:
            if at in seen:
                raise TiffError("the directories form a cycle")
            seen.add(at)
            n, tags = self.number(at, "H"), {}
            for i in range(n):
                entry = at + 2 + 12 * i
                tag, kind, count = struct.unpack(self.order + "HHI", self.take(entry, 8))
                if kind in _KINDS:
                    size, letters = _KINDS[kind]
                    place = entry + 8 if size * count <= 4 else self.number(entry + 8, "I")
                    tags[tag] = struct.unpack(f"{self.order}{count}{letters}" if len(letters) == 1 else self.order + letters * count, self.take(place, size * count))
            yield tags
            at = self.number(at + 2 + 12 * n, "I")

    def page(self, tags: dict[int, tuple]) -> Page:
        def every(tag: int) -> tuple[int, ...]:
            values = tags.get(tag, ())
            if not all(isinstance(v, int) and v >= 0 for v in values):
                raise TiffError(f"tag {tag} isn't a whole number")
            return values

        def one(tag: int, default: int | None = None) -> int:
            if values := every(tag):
                return values[0]
            if default is None:
                raise TiffError(f"tag {tag} is missing")
            return default

        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, how, predictor = one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if not width or not height or not samples or len(set(every(BITS) or (bits,))) != 1 or bits not in (1, 8, 16, 32, 64) or (bits == 1 and predictor != 1):
            raise TiffError("sizes or sample depths aren't supported")
        if how not in _MOST:
            raise TiffError(f"compression {how} isn't supported")
        planes = samples if one(PLANES, 1) == 2 else 1
        each = samples // planes
        tiled = TILE_AT in tags
        w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not w or not h or (tiled and w * each * bits % 8):
            raise TiffError("tiles or strips have a size that isn't supported")
        ats, sizes = (every(TILE_AT), every(TILE_SIZE)) if tiled else (every(STRIP_AT), every(STRIP_SIZE))
        across, down = -(-width // w), -(-height // h)
        needed = across * down * planes
        if len(ats) < needed or len(sizes) < len(ats):
            raise TiffError("strips or tiles are missing")
        columns = (width * each * bits + 7) // 8
        stored = (w * each * bits + 7) // 8 * (h * across * down if tiled else height) * planes
        if max(stored, planes * height * columns) > MOST_BYTES or stored > _MOST[how] * sum(sizes[:needed]):
            raise TiffError("the page is larger than its strips or tiles can be")
        stride = (w * each * bits + 7) // 8
        whole = np.zeros((planes, height, columns), np.uint8)
        for plane in range(planes):
            for i in range(across * down):
                k = plane * across * down + i
                y, x = i // across * h, i % across * w
                rows = h if tiled else min(h, height - y)
                data = self.take(ats[k], sizes[k])
                if one(FILL, 1) == 2:
                    data = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 8)[:, ::-1]).tobytes()
                block = np.frombuffer(_decompress(data, how, rows * stride), np.uint8).reshape(rows, stride)
                block = self._undo(block, predictor, bits, each, w)
                left = x * each * bits // 8
                part = block[: height - y, : columns - left]
                whole[plane, y : y + len(part), left : left + part.shape[1]] = part
        if planes > 1 and bits == 1:
            dots = np.unpackbits(whole, axis=2, count=width)
            whole = np.packbits(np.moveaxis(dots, 0, 2).reshape(height, -1), axis=1)
        elif planes > 1:
            whole = np.moveaxis(whole.reshape(planes, height, width, bits // 8), 0, 2)
        return Page(width, height, samples, bits, how, predictor, np.ascontiguousarray(whole).tobytes())

    def _undo(self, block: np.ndarray, predictor: int, bits: int, each: int, w: int) -> np.ndarray:
        rows = len(block)
        if predictor == 1:
            return block
        if predictor == 2:
            kind = np.dtype(f"{self.order}u{bits // 8}")
            values = block.view(kind).reshape(rows, w, each)
            return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(rows, -1).view(np.uint8)
        if predictor == 3 and bits >= 16:  # differences of bytes, the most significant bytes of a row first
            sums = np.cumsum(block.reshape(rows, -1, each), axis=1, dtype=np.uint8).reshape(rows, bits // 8, w * each)
            return np.ascontiguousarray((sums[:, ::-1] if self.order == "<" else sums).transpose(0, 2, 1)).reshape(rows, -1)
        raise TiffError(f"predictor {predictor} isn't supported")


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in order; samples stay in the file's byte order."""
    r = _Reader(data)
    for tags in r.directories():
        yield r.page(tags)


def layout(payload: bytes) -> tuple[int, bool]:
    """The payload's own one of LAYOUTS."""
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def _stored(block: np.ndarray, how: int) -> bytes:
    """A strip's or tile's data; LZW and deflate get differences along rows."""
    if how == PLAIN:
        return block.tobytes()
    if how == PACKBITS:
        return b"".join(pack_bits(r.tobytes()) for r in block)
    changes = block.copy()
    changes[:, 1:] -= block[:, :-1]
    return pack_lzw(changes.tobytes()) if how == LZW else zlib.compress(changes.tobytes(), 6)


def encode(payload: bytes, row: int = ROW, strip_rows: int = STRIP_ROWS, stored: tuple[int, bool] | None = None) -> bytes:
    """A grey page of 8-bit samples of whole rows, under the given (compression, in tiles?) or the payload's own."""
    how, tiled = stored or layout(payload)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, row)
    w, h = TILE if tiled else (row, strip_rows)
    out, ats, sizes = bytearray(b"II*\0\0\0\0\0"), [], []
    for y in range(0, len(pixels), h):
        for x in range(0, row, w):
            block = pixels[y : y + h, x : x + w]
            if tiled:
                block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])))
            data = _stored(block, how)
            ats.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
    fields = [(WIDTH, 4, [row]), (HEIGHT, 4, [len(pixels)]), (BITS, 3, [8]), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1])]
    fields += [] if tiled else [(STRIP_AT, 4, ats)]
    fields += [(SAMPLES, 3, [1])]
    fields += [] if tiled else [(ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_SIZE, 4, sizes)]
    fields += [(PREDICTOR, 3, [2])] if how in (LZW, DEFLATE) else []
    fields += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_AT, 4, ats), (TILE_SIZE, 4, sizes)] if tiled else []
    entries = b""
    for tag, kind, values in fields:
        data = struct.pack(f"<{len(values)}{_KINDS[kind][1]}", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), len(out))
            out += data
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    if len(out) >= 1 << 32:
        raise TiffError("the payload doesn't fit into a file of four gigabytes")
    out[4:8] = struct.pack("<I", len(out))
    return bytes(out) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"


def feature(page: Page) -> str:
    """Size, mean, deviation and entropy of a page's sample bytes."""
    x = np.frombuffer(page.pixels, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n / max(len(x), 1)
    v = np.arange(256)
    mean = float((p * v).sum())
    spread = float(np.sqrt(max((p * (v - mean) ** 2).sum(), 0)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    return f"{page.width}x{page.height}x{page.samples}:{mean:.4f}:{spread:.4f}:{entropy:.4f}"


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) per row: the whole text in UTF-8, filled with zero bytes to a positive multiple of ROW, as
    a one-page file. Null is empty; repeated rows give a file each; an empty table gives an empty result. A text of any
    length is one file, up to the four gigabytes that a file can have. Other columns aren't returned and may have any
    name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, media, sizes, held = 0, [], [], 0
            for i, t in enumerate(b.column(1)):
                data = t.as_py()
                sizes.append(len(data))
                media.append(encode(data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")))
                held += len(media[-1])
                if held > BATCH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    first, media, sizes, held = i + 1, [], [], 0

    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    return small_batches(source).mapInArrow(tidy(run), T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


_PAGE = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("feature", pa.string()), ("pixels", pa.binary()), ("error", pa.string())]


def decode_pages(df: DataFrame, media: Column | str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page with the keep columns, page (from 0), sizes, compression, predictor, feature, pixels and error.

    Media that can't be decoded give one row with the error, after the pages before it, with no pixels. Null media give
    none, as does a file without directories; an empty table gives an empty result. Repeated rows are decoded each. A page
    column whose name a keep column has, in any case of letters, gets as many underscores at its end as it needs.
    """
    taken = {k.lower() for k in keep}
    fields = [(next(n for n in (x + "_" * i for i in itertools.count()) if n.lower() not in taken), t) for x, t in _PAGE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0

            def made(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True))
                kept = [b.column(k + 1).take(pa.array(cols[0], pa.int64())) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, (_, t) in zip(cols[1:], fields, strict=True))], names=[*keep, *(x for x, _ in fields)])

            for i, m in enumerate(b.column(0)):
                for row in _rows(m.as_py()):
                    rows.append((i, *row))
                    held += len(row[-2] or b"")
                    if held > BATCH:
                        yield made(b, rows)
                        rows, held = [], 0
            if rows:
                yield made(b, rows)

    source = df.select(F.col(media).alias("_media") if isinstance(media, str) else media.alias("_media"), *keep)
    kinds = [T.StructField(n, from_arrow_type(t)) for n, t in fields]
    return small_batches(source).mapInArrow(tidy(run), T.StructType([*(source.schema[1 + k] for k in range(len(keep))), *kinds]))


def _rows(data: bytes | None) -> Iterator[tuple]:
    """Values of _PAGE for each page, and for what ends the file before its time."""
    n = 0
    if data is None:
        return
    try:
        for n, p in enumerate(pages(data), 1):
            yield n - 1, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, feature(p), p.pixels, None
    except Exception as e:  # whatever a file's bytes lead to is that file's error, not the job's
        yield n, *[None] * 8, f"{type(e).__name__}: {e}"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made = made.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = decode_pages(made, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    size = F.octet_length("pixels").cast("bigint")
    tail = F.crc32(F.substring(F.col("pixels"), F.lit(-ROW), F.lit(ROW)))
    return read.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
