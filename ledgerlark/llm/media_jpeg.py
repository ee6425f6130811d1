"""Media columns: payloads kept losslessly in baseline JPEG, and DC thumbnails read back.

Writing: each byte of a payload is one 8 x 8 block of a grey image whose samples all have
the byte's value, 64 blocks to a row. With a DC quantiser of 8 that
value is the block's only coefficient, so every decoder returns it exactly. Each row of blocks ends
with a restart marker. A payload of more than FRAME bytes fills several images, one after the
other.

Reading (any baseline JPEG of one interleaved scan): markers are parsed for each image. Scans are
decoded for many images at once in numpy: the parts between restart markers are
independent, so each is a lane, and all lanes decode their next symbol in the same step. Only
the DC coefficient of each luminance block is kept: block by block it is the mean,
which makes the image's thumbnail at an eighth of its size.

Cases: a null text is an empty payload, and an empty payload is 64 bytes 0. Very long texts fill further images. Equal
texts give equal media. Repeated rows and null doc_ids are kept as they are. Extra columns are ignored. Null and empty media are read as nulls. A scan that
ends early gives 0 bits; markers that contradict each other raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _words as W
from ledgerlark.llm._shared import bound_batches

UNIT = 64
ROW = 64  #: blocks in a row of an image
FRAME = ROW * 8191  #: bytes in one image: the format's height is at most 65,535
SLICE = 1 << 20

# Tables of the images written: DC categories 0 to 8 have codes of 4 bits, AC has the end of block only.
DC_CODES = (4, tuple(range(9)))
AC_CODES = (1, (0,))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(kind: int, length: int, symbols: tuple[int, ...]) -> bytes:
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return bytes([kind]) + bytes(counts) + bytes(symbols)


def _header(rows: int) -> bytes:
    quantiser = bytes([0, 8] + [1] * 63)
    frame = struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    tables = _codes(0x00, *DC_CODES) + _codes(0x10, *AC_CODES)
    return b"\xff\xd8" + _segment(0xDB, quantiser) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs from the last one's by -255..255."""
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        n = abs(diff).bit_length()
        value = diff if diff > 0 else diff + (1 << n) - 1
        bits[diff + 255] = ((n << n) | value) << 1  # category, value, end of block
        size[diff + 255] = 4 + n + 1
    return bits, size


BITS, SIZES = _symbols()


def payloads(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes and 0s up to a positive multiple of UNIT, and where each begins (n + 1)."""
    size = np.diff(at)
    full = np.maximum(1, -(-size // UNIT)) * UNIT
    first = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(first[-1], np.uint8)
    out[np.repeat(first[:-1] - at[:-1], size) + np.arange(len(raw))] = raw
    return out, first


def encode(data: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The media of each payload data[first[i]:first[i + 1]], whose size is a positive multiple of UNIT."""
    rows_of = np.diff(first) // ROW
    grid = data.reshape(-1, ROW)
    rows = len(grid)
    diff = grid.astype(np.int16)
    diff[:, 1:] -= grid[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    size, bits = SIZES[diff], BITS[diff]
    total = size.sum(1)
    length = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(length)))
    scan = np.zeros(start[-1] + 4, np.uint8)
    at = start[:-1] * 8
    for k in range(ROW):
        word = bits[:, k] << (24 - size[:, k] - (at & 7)).astype(np.uint32)
        byte = at >> 3
        scan[byte] |= (word >> 16).astype(np.uint8)
        scan[byte + 1] |= ((word >> 8) & 255).astype(np.uint8)
        scan[byte + 2] |= (word & 255).astype(np.uint8)
        at = at + size[:, k]
    pad = -total % 8
    scan[start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    scan = scan[: start[-1]]
    # stuffed zeros and restart markers
    ff = scan == 0xFF
    of = np.repeat(np.arange(rows), length)
    frame_row = W.spread(rows_of) % (FRAME // ROW)
    place = np.arange(len(scan)) + np.cumsum(ff) - ff + 2 * of
    out = np.zeros(len(scan) + int(ff.sum()) + 2 * rows, np.uint8)
    out[place] = scan
    stuffed = np.cumsum(ff)
    end = start[1:] + stuffed[start[1:] - 1] + 2 * np.arange(rows)
    last = np.zeros(rows, bool)
    last[np.cumsum(rows_of) - 1] = True
    last |= frame_row == FRAME // ROW - 1
    out[end] = 0xFF
    out[end + 1] = np.where(last, 0xD9, 0xD0 + frame_row % 8)
    out = memoryview(out)
    media, row, begin = [], 0, 0
    for n in rows_of.tolist():
        parts = []
        while n:
            take = min(n, FRAME // ROW)
            stop = int(end[row + take - 1]) + 2
            parts += [_header(take), out[begin:stop]]
            row, n, begin = row + take, n - take, stop
        media.append(b"".join(parts))
    return media


@dataclass
class Image:
    width: int
    height: int
    parts: list[tuple[int, int, int, int]]  # of the scan's components: index, blocks across, blocks down, quantiser
    tables: tuple
    interval: int
    scan: tuple[int, int]
    pattern: list[tuple[int, int, int]] = field(default_factory=list)


def parse(media: bytes) -> list[Image]:
    """The images in media, one after the other."""
    out, at = [], 0
    quant: dict[int, int] = {}
    huffman: dict[int, bytes] = {}
    frame, interval = None, 0
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind = media[at + 1]
        at += 2
        if kind == 0xD8:
            quant, huffman, frame, interval = {}, {}, None, 0
            continue
        if kind == 0xD9 or kind == 0xFF:
            at -= kind == 0xFF
            continue
        (size,) = struct.unpack_from(">H", media, at)
        body = media[at + 2 : at + size]
        at += size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            frame = (height, width, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}, list(body[6 : 6 + 3 * n : 3]))
        elif 0xC2 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("not a baseline image")
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            end = at
            while True:
                end = media.find(b"\xff", end)
                if end < 0 or end + 1 >= len(media):
                    end = len(media)
                    break
                if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            height, width, components, order = frame
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            tables = tuple((huffman[t >> 4], huffman[0x10 | t & 15]) for _, t in chosen)
            if order[0] in [c for c, _ in chosen]:
                parts = [(order.index(c), *components[c][:2], quant[components[c][2]]) for c, _ in chosen]
                out.append(Image(width, height, parts, tables, interval, (at, end)))
            at = end
    return out


def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: length of their code << 8 | symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, np.uint16)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            out[a : a + (1 << (16 - n))] = n << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """(image, thumbnail) of the images in each medium; a thumbnail has one uint8 for each luminance block."""
    images = [parse(m) for m in media]
    out: list[list] = [[None] * len(x) for x in images]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, some in enumerate(images):
        for j, image in enumerate(some):
            groups.setdefault((image.tables, tuple(image.parts)), []).append((i, j))
    for (tables, parts), members in groups.items():
        found = _decode(tables, parts, [(images[i][j], media[i]) for i, j in members])
        for (i, j), thumbnail in zip(members, found):
            out[i][j] = (images[i][j], thumbnail)
    return out


def _decode(tables: tuple, parts: tuple, members: list[tuple[Image, bytes]]) -> list[np.ndarray]:
    """Thumbnails of images with the same tables and components."""
    scans = [np.frombuffer(m, np.uint8)[slice(*image.scan)] for image, m in members]
    sizes = np.array([len(s) for s in scans])
    data = np.concatenate([*scans, np.zeros(1, np.uint8)])
    # lanes begin with each image and after each restart marker; stuffed zeros and markers go
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(data), bool)
    keep[-1] = False
    keep[ff[after == 0] + 1] = False
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[restart] = keep[restart + 1] = False
    kept = np.cumsum(keep) - keep
    starts = np.sort(np.concatenate((begins, restart + 2)))
    lane_image = np.searchsorted(begins, starts, "right") - 1
    lane = W.spread(np.bincount(lane_image, minlength=len(members)))
    at = kept[np.minimum(starts, len(kept) - 1)] * 8
    stream = np.concatenate((data[keep], np.zeros(8, np.uint8))).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]
    most = len(window) - 1
    # units: what one step of a scan holds
    alone = len(parts) == 1
    wide, tall = max(p[1] for p in parts), max(p[2] for p in parts)
    across = np.array([-(-im.width // (8 if alone else 8 * wide)) for im, _ in members])
    down = np.array([-(-im.height // (8 if alone else 8 * tall)) for im, _ in members])
    units = across * down
    interval = np.array([im.interval or across[k] * down[k] for k, (im, _) in enumerate(members)])
    todo = np.minimum(interval[lane_image], units[lane_image] - lane * interval[lane_image])
    pattern = [(c, y, x) for c, p in enumerate(parts) for y in range(1 if alone else p[2]) for x in range(1 if alone else p[1])]
    looks = [(_lookup(dc), _lookup(ac)) for dc, ac in tables]
    grey = next(c for c, p in enumerate(parts) if p[0] == 0)
    per_x, per_y = (1, 1) if alone else (parts[grey][1], parts[grey][2])
    grids = [np.zeros((down[k] * per_y, across[k] * per_x), np.int32) for k in range(len(members))]
    base = np.concatenate(([0], np.cumsum([g.size for g in grids])))
    flat = np.zeros(base[-1], np.int32)
    last = np.zeros((len(parts), len(at)), np.int32)
    first_unit, origin = lane * interval[lane_image], base[lane_image]

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, most)] << (p & 7).astype(np.uint32)

    for step in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > step)
        whole = len(live) == len(at)
        p = at if whole else at[live]
        unit = first_unit[live] + step
        if not alone:
            of = lane_image[live]
            uy, ux = unit // across[of], unit % across[of]
        for c, y, x in pattern:
            dc, ac = looks[c]
            bits = peek(p)
            hit = dc[bits >> 16]
            size = (hit >> 8).astype(np.int64)
            n = (hit & 255).astype(np.int64)
            p = p + size
            # 25 bits or more are at hand, which is enough after codes of up to 14
            value = (bits << size.astype(np.uint32)) if int(size.max(initial=0)) <= 14 else peek(p)
            value = np.where(n > 0, value >> np.minimum(32 - n, 31).astype(np.uint32), 0).astype(np.int32)
            value -= np.where((n > 0) & (value < (1 << np.maximum(n - 1, 0))), (1 << n) - 1, 0).astype(np.int32)
            p = p + n
            if whole:
                last[c] += value
                now = last[c]
            else:
                last[c][live] += value
                now = last[c][live]
            if c == grey:
                flat[origin[live] + unit if alone else origin[live] + (uy * per_y + y) * (across[of] * per_x) + ux * per_x + x] = now
            # AC coefficients are only passed over
            k, busy = np.ones(len(p), np.int64), None
            while True:
                q = p if busy is None else p[busy]
                hit = ac[peek(q) >> 16]
                run, n = (hit >> 4 & 15).astype(np.int64), (hit & 15).astype(np.int64)
                q = q + (hit >> 8) + n
                skip = np.where((n > 0) | (run == 15), run + 1, 64)
                if busy is None:
                    p = q
                    k = k + skip
                else:
                    p[busy] = q
                    k[busy] += skip
                busy = np.flatnonzero(k < 64)
                if not len(busy):
                    break
        if whole:
            at = p
        else:
            at[live] = p
    quantiser = parts[grey][3]
    flat = np.clip((flat * quantiser + (4 if quantiser % 8 else 0)) // 8 + 128, 0, 255).astype(np.uint8)
    # images whose width or height isn't a whole number of units have blocks beyond the edge
    out = []
    for k, (image, _) in enumerate(members):
        grid = flat[base[k] : base[k + 1]].reshape(grids[k].shape)
        h = -(-image.height * per_y // (8 * (1 if alone else tall)))
        w = -(-image.width * per_x // (8 * (1 if alone else wide)))
        out.append(grid[:h, :w])
    return out


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits as hex: is each of 8 x 8 parts of the thumbnail lighter than their mean?"""
    h, w = grid.shape
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    area = np.add.reduceat(np.add.reduceat(grid.astype(np.float64), ys, axis=0), xs, axis=1)
    count = np.maximum(np.diff(np.append(ys, h)), 1)[:, None] * np.maximum(np.diff(np.append(xs, w)), 1)[None, :]
    mean = area / count
    return np.packbits(mean > mean.mean()).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of every row."""
    bound_batches(docs.sparkSession)

    def work(stream):
        for batch in stream:
            for i, j, raw, at in W.slices(batch.column("text"), SLICE):
                rows = batch.slice(i, j - i)
                media = encode(*payloads(raw, at))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def _read(media: list[bytes]):
    """payload, width, height, images and thumbnail hash of each medium."""
    for images in decode(media):
        grids = [g for _, g in images]
        whole = grids[0] if len(grids) == 1 else np.concatenate(grids)
        yield whole.tobytes(), images[0][0].width, sum(i.height for i, _ in images), len(images), thumbnail_hash(whole)


def read(media: DataFrame) -> DataFrame:
    """doc_id, width, height, images, thumbnail (binary, a byte for each block) and thumbnail_hash of every row of (doc_id, media) that store() made."""
    bound_batches(media.sparkSession)
    schema = "doc_id long, width int, height int, images int, thumbnail binary, thumbnail_hash string"
    names = ["doc_id", "width", "height", "images", "thumbnail", "thumbnail_hash"]

    def work(stream):
        for batch in stream:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                stored = part.column("media").to_pylist()
                found = _read([m for m in stored if m])
                rows = [next(found) if m else (None,) * 5 for m in stored]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[0], pa.binary()), pa.array(cols[4], pa.string())], names)

    return media.select("doc_id", "media").mapInArrow(work, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back, and digests both."""
    bound_batches(docs.sparkSession)

    def work(stream):
        for batch in stream:
            for i, j, raw, at in W.slices(batch.column("text"), SLICE):
                media = encode(*payloads(raw, at))
                rows = [
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{n}:{code}")
                    for m, (payload, width, height, n, code) in zip(media, _read(media))
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), *columns], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, DIGEST)
