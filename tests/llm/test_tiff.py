import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

from helixframe.llm import tiff as x


def pack_bits(data):
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i + n] == data[i] and n < 128:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
            i += n
        else:
            j = i
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
            i = j
    return bytes(out)


def pack_lzw(data):
    """Greedy, with the widths of the published algorithm: the writer's table is one entry ahead of the reader's."""
    codes, width, bits, n = {bytes([i]): i for i in range(256)}, 9, 0, 0

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    put(256)
    nxt, s = 258, b""
    for c in data:
        t = s + bytes([c])
        if t in codes:
            s = t
            continue
        put(codes[s])
        codes[t] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            codes, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif nxt == 1 << width:
            width += 1
        s = bytes([c])
    if s:
        put(codes[s])
        nxt += 1
        if nxt == 1 << width:
            width += 1
    put(257)
    pad = -n % 8
    return (bits << pad).to_bytes((n + pad) // 8, "big")


CODECS = {x.PLAIN: bytes, x.PACKBITS: pack_bits, x.LZW: pack_lzw, x.DEFLATE: zlib.compress, x.OLD_DEFLATE: zlib.compress}


def make(images, order="<"):
    """A file from pages given as dictionaries; written apart from the package's own writer."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for im in images:
        a, tile, bits, how, pred, planar = (im.get(k) for k in ("a", "tile", "bits", "how", "pred", "planar"))
        h, w, s = a.shape
        kind = np.dtype(f"{order}u{bits // 8}") if bits > 1 else np.dtype("u1")
        th, tw = tile or (im.get("rows", h), w)
        parts = [a[:, :, i : i + 1] for i in range(s)] if planar else [a]
        ats, sizes = [], []
        for part in parts:
            for y in range(0, h, th):
                for x0 in range(0, w, tw):
                    block = part[y : y + th, x0 : x0 + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if bits == 1:
                        raw = np.packbits(block[:, :, 0], axis=1).tobytes()
                    elif pred == 3:
                        by = np.frombuffer(block.astype(f">u{bits // 8}").tobytes(), np.uint8).reshape(block.shape[0], -1, bits // 8).transpose(0, 2, 1).reshape(block.shape[0], -1, part.shape[2])
                        raw = np.concatenate([by[:, :1], by[:, 1:] - by[:, :-1]], 1).astype(np.uint8).tobytes()
                    else:
                        v = block.astype(kind.newbyteorder("="))
                        if pred == 2:
                            v = np.concatenate([v[:, :1], v[:, 1:] - v[:, :-1]], 1)
                        raw = v.astype(kind).tobytes()
                    data = CODECS[how](raw)
                    ats.append(len(out))
                    sizes.append(len(data))
                    out += data
        fields = {256: (4, [w]), 257: (3, [h]), 258: (3, [bits] * s), 259: (3, [how]), 262: (3, [1]), 277: (3, [s]), 284: (3, [2 if planar else 1]), 317: (3, [pred or 1])}
        fields |= {322: (3, [tw]), 323: (3, [th]), 324: (4, ats), 325: (4, sizes)} if tile else {273: (4, ats), 278: (4, [th]), 279: (4, sizes)}
        entries = b""
        for tag in sorted(fields):
            k, values = fields[tag]
            data = struct.pack(f"{order}{len(values)}{'H' if k == 3 else 'I'}", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, k, len(values)) + place
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", list(CODECS))
def test_round_trips(order, how):
    rng = np.random.default_rng(how)
    images = []
    for bits in (8, 16, 32):
        for pred in (1, 2, 3) if bits > 8 else (1, 2):
            for planar in (False, True):
                for tile in (None, (16, 32)):
                    a = np.cumsum(rng.integers(0, 3, (37, 45, 3)), axis=1) * rng.integers(1, 9) % (1 << min(bits, 20))
                    images.append({"a": a, "bits": bits, "pred": pred, "planar": planar, "tile": tile, "how": how, "rows": 10})
    images.append({"a": rng.integers(0, 2, (9, 21, 1)), "bits": 1, "how": how})
    got = list(x.pages(make(images, order)))
    assert len(got) == len(images)
    for im, p in zip(images, got, strict=True):
        a = im["a"]
        want = np.packbits(a[:, :, 0], axis=1).tobytes() if im["bits"] == 1 else a.astype(f"{order}u{im['bits'] // 8}").tobytes()
        assert (p.height, p.width, p.samples, p.bits, p.compression) == (*a.shape, im["bits"], how)
        assert p.pixels == want, im


def test_lzw_long():
    rng = random.Random(1)
    for data in (b"", b"a", b"a" * 9000, bytes(rng.randrange(256) for _ in range(20000)), bytes(rng.randrange(3) for _ in range(30000))):
        assert x.unpack_lzw(pack_lzw(data), len(data)) == data
        assert x.unpack_bits(pack_bits(data), len(data)) == data


def test_own_writer():
    for n in (64, 640, 64 * 1024, 64 * 1025, 64 * 5000):
        data = random.Random(n).randbytes(n)
        (p,) = x.pages(x.encode(data))
        assert p.pixels == data and p.width == 64


def test_damage():
    good = x.encode(b"a" * 640)
    cycle = bytearray(good)
    cycle[-4:] = good[4:8]
    for bad in (b"", b"II*", b"GIF89a..", good[:40], bytes(cycle), good[:8] + b"\xff" * 10 + good[18:]):
        with pytest.raises((x.TiffError, struct.error)):
            list(x.pages(bad))


def test_frames(spark):
    two = make([{"a": np.ones((2, 3, 1), int), "bits": 8, "how": 1}] * 2)
    df = spark.createDataFrame([(1, two, "k"), (2, b"junk", None), (3, None, "x"), (4, two[:-30], "y")], "doc_id long, media binary, feature string")
    rows = sorted((r.doc_id, r.page, r.pixels and bytes(r.pixels), r.error is not None) for r in x.decode_pages(df.drop("feature")).collect())
    assert rows[:3] == [(1, 0, b"\1" * 6, False), (1, 1, b"\1" * 6, False), (2, 0, None, True)] and rows[-1][0] == 4 and rows[-1][3]
    assert x.decode_pages(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (3, "é" * 32, 3), (4, "x" * 65, 4), (4, "x" * 65, 4), (None, "long " * 40000, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(str(tmp_path / "documents.parquet"))
    got = x.op4(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({tuple(r)[1:] for r in got}) == 4
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        full = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = x.encode(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"64x{len(full) // 64}x1:")
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert x.op4(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stored", sorted(set(x.LAYOUTS)))
def test_every_layout(stored):
    rng = random.Random(5)
    for data in (b"\0" * 64, bytes(rng.randrange(97, 123) for _ in range(64 * 70)), rng.randbytes(64 * 3), b"ab" * 32 * 2100, b"words and words " * 4 * 5000):
        file = x.encode(data, stored=stored)
        (p,) = x.pages(file)
        assert p.pixels == data and p.compression == stored[0] and file == x.encode(data, stored=stored)
        assert len(data) < 64 * 4000 or stored[0] == x.PLAIN or len(file) < len(data) * 1.05
    picked = {x.layout(rng.randbytes(64)) for _ in range(1000)}
    assert picked == set(x.LAYOUTS)


def test_feature_by_hand():
    for data in (b"\0" * 64, bytes(range(64)), random.Random(2).randbytes(640), b"aab" * 64):
        (p,) = x.pages(x.encode(data))
        n = len(data)
        mean = sum(data) / n
        spread = (sum((c - mean) ** 2 for c in data) / n) ** 0.5
        entropy = sum(-data.count(c) / n * math.log2(data.count(c) / n) for c in set(data))
        size, *got = x.feature(p).split(":")
        assert size == f"64x{n // 64}x1"
        for g, w in zip(got, (mean, spread, entropy), strict=True):
            assert abs(float(g) - w) <= 0.5001e-4


def test_bilevel_planes():
    a = np.random.default_rng(3).integers(0, 2, (5, 13, 2))
    (p,) = x.pages(make([{"a": a, "bits": 1, "how": 1, "planar": True, "rows": 2}]))
    assert p.pixels == np.packbits(a.reshape(5, 26), axis=1).tobytes()


def test_mutated_files_give_error_rows(spark):
    rng = random.Random(11)
    good = [x.encode(bytes(rng.randrange(97, 100) for _ in range(64 * 9)), stored=s) for s in sorted(set(x.LAYOUTS))]
    a = np.random.default_rng(1).integers(0, 200, (9, 20, 3))
    good += [make([{"a": a, "bits": b, "how": h, "pred": 2, "planar": q, "tile": t, "rows": 4}] * 2, o) for b in (8, 16) for h in (1, 5, 8) for q in (False, True) for t in (None, (16, 16)) for o in "<>"]
    errors = 0
    for _ in range(20_000):
        data = bytearray(rng.choice(good))
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(max(0, len(data) - 300), len(data)) if rng.random() < 0.8 else rng.randrange(len(data))
            data[at] = rng.choice((0, 1, 2, 5, 11, 12, 255, rng.randrange(256)))
        if rng.random() < 0.1:
            del data[rng.randrange(len(data)) :]
        rows = list(itertools.islice(x._rows(bytes(data)), 10))  # raises for nothing but an error of the test
        errors += rows[-1][-1] is not None if rows else 0
        assert all(r[-2] is not None or r[-1] for r in rows)
    assert errors > 2000
    huge = make([{"a": a, "bits": 8, "how": 1}])
    for tag, why in ((256, "larger"), (257, "missing")):
        at = huge.index(struct.pack("<H", tag), len(huge) - 150)
        bad = huge[: at + 2] + struct.pack("<HII", 4, 1, 1 << 31) + huge[at + 12 :]
        assert why in next(x._rows(bad))[-1]
    df = spark.createDataFrame([(1, huge), (2, bad), (3, huge[:50]), (3, huge[:50])], "width long, media binary")
    rows = x.decode_pages(df, keep=("width",)).collect()
    assert sorted((r.width, r.width_, r.error is None) for r in rows if r.width_) == [(1, 20, True)] and sum(r.error is not None for r in rows) == 3
