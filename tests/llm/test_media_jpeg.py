import hashlib
import struct
import zlib

import numpy as np
import pytest

from ledgerlark.llm import media_jpeg as M


def padded(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 or (0 if b else 64))


def test_round_trip_of_every_row(spark):
    texts = ["", None, "a", "x" * 64, "é" * 40, "\x00\x7f" * 100, "ÿ" * 9000, "hello world\n" * 500, "z" * 600_000, "hello world\n" * 500]
    rows = [(k or None, t, b"") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    out = M.digests(docs).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    for d, t, _ in rows:
        want = padded(t)
        x = by[d]
        assert (x.n_bytes, x.payload_bytes) == (len((t or "").encode()), len(want))
        assert x.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert x.tail_crc32 == zlib.crc32(want[-64:])
    assert by[7][1:] == by[9][1:] and by[None][1:] == by[1][1:]
    assert by[8].feature.startswith("512x")
    media = {x.doc_id: bytes(x.media) for x in M.store(docs).collect()}
    assert all(hashlib.sha256(media[d]).hexdigest() == by[d].media_sha256 and len(media[d]) == by[d].media_bytes for d in by)
    read = {x.doc_id: x for x in M.read(M.store(docs)).collect()}
    assert all(bytes(read[d].thumbnail) == padded(t) for d, t, _ in rows)
    assert M.digests(docs.limit(0)).collect() == []


def test_all_byte_values_and_many_images():
    r = np.random.default_rng(0)
    sizes = [64, 640, M.FRAME, M.FRAME + 64, 6400]
    data = r.integers(0, 256, sum(sizes), dtype=np.uint8)
    data[:64] = [0, 255] * 32
    first = np.concatenate(([0], np.cumsum(sizes)))
    media = M.encode(data, first)
    got = [(p, n) for p, _, _, n, _ in M._read(media)]
    assert got == [(data[a:b].tobytes(), 1 if b - a <= M.FRAME else 2) for a, b in zip(first, first[1:])]


class Writer:
    """A slow baseline encoder, for images that encode() doesn't write: several components, AC coefficients, no restarts."""

    def __init__(self, table):
        self.bits, self.codes = "", {}
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                self.codes[table[k]] = format(code, f"0{n}b")
                code, k = code + 1, k + 1
            code <<= 1

    def value(self, symbol_high, v):
        n = abs(v).bit_length()
        return self.codes[symbol_high << 4 | n] + (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")


@pytest.mark.parametrize("interval", [0, 2])
def test_three_components_with_ac(interval):
    r = np.random.default_rng(interval)
    table = bytes([0] * 7 + [254] + [0] * 8) + bytes(range(254))  # every symbol used has 8 bits
    w = Writer(table)
    width, height = 40, 24  # 3 x 2 units of 16 x 16
    parts = [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]
    grid = r.integers(-60, 60, (4, 6))
    scans, bits, last = [], "", [0, 0, 0]
    for unit in range(6):
        uy, ux = divmod(unit, 3)
        if interval and unit and unit % interval == 0:
            scans.append(bits)
            bits, last = "", [0, 0, 0]
        for c, (_, h, v, _) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    dc = int(grid[uy * 2 + y, ux * 2 + x]) if c == 0 else int(r.integers(-9, 9))
                    bits += w.value(0, dc - last[c])
                    last[c] = dc
                    k = 1
                    for _ in range(r.integers(0, 4)):
                        run = int(r.integers(0, 15))
                        k += run + 1
                        bits += w.value(run, int(r.integers(1, 30)))
                    bits += w.codes[0xF0] if k < 40 else ""
                    bits += w.codes[0]
    scans.append(bits)
    body = b""
    for k, s in enumerate(scans):
        s += "1" * (-len(s) % 8)
        body += int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") + (b"" if k == len(scans) - 1 else bytes([0xFF, 0xD0 + k]))
    q = bytes([0, 16] + [3] * 63)
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, h << 4 | v, t]) for i, h, v, t in parts)
    head = b"\xff\xd8" + M._segment(0xFE, b"note") + M._segment(0xDB, q) + M._segment(0xC0, frame) + M._segment(0xC4, b"\x00" + table) + M._segment(0xC4, b"\x10" + table)
    if interval:
        head += M._segment(0xDD, struct.pack(">H", interval))
    media = head + M._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    ((image, thumbnail),) = M.decode([media])[0]
    assert (image.width, image.height) == (width, height)
    assert (thumbnail == np.clip(grid[:3, :5] * 2 + 128, 0, 255)).all()


def test_missing_media_read_as_nulls(spark):
    media = M.store(spark.createDataFrame([(1, "text")], "doc_id long, text string")).select("doc_id", "media").unionByName(spark.createDataFrame([(2, None), (3, b"")], "doc_id long, media binary"))
    out = {x.doc_id: x for x in M.read(media.coalesce(1)).collect()}
    assert out[1].width == 512 and all(out[d].width is None and out[d].thumbnail is None and out[d].thumbnail_hash is None for d in (2, 3))
