"""Baseline JPEG media columns.

A payload is kept losslessly in JPEG's own unit, the quantised coefficient: byte k of a run of 64 is coefficient k
of an 8x8 luminance block in zigzag order, under a fixed one-to-one code of bytes to non-zero values. An image is 24
pixels wide; each row of three blocks is a restart interval, so that numpy decodes all rows of many images in step.
The reader takes any baseline JPEG of one or more interleaved components: it parses the markers, Huffman-decodes the
scan, and rebuilds a luminance thumbnail from the DC coefficients alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trilattice.llm.common import byte_texts, slices, table
from trilattice.session import stored

UNIT, ROW, WIDTH, MAX_ROWS = 576, 192, 24, 8184
#: Bytes from the most frequent in prose; all others follow in their own order. Fixed values.
FREQUENT = b" etnhaoirsdl\xffu" + b"c\xc3bgqmpvw.,\n"
#: Huffman code lengths of the size categories of a coefficient: DC differences 0 to 9, AC values 1 to 8. Fixed values.
DC_LENGTHS, AC_LENGTHS = dict(zip(range(10), (4, 4, 3, 3, 3, 3, 3, 4, 5, 6))), dict(zip(range(1, 9), (2, 2, 2, 3, 4, 5, 6, 7)))
CHUNK_ROWS = 8192


def _value_of_byte() -> np.ndarray:
    order = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)])
    rank = np.arange(256)
    out = np.empty(256, np.int32)
    out[order] = np.where(rank % 2 == 0, 1, -1) * (rank // 2 + 1)
    return out


VALUE = _value_of_byte()
BYTE = np.zeros(257, np.uint8)
BYTE[VALUE + 128] = np.arange(256)


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical (code, length) by symbol, in the order of length and then symbol."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _with_bits(lengths: dict[int, int], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each value: its size category, then its bits."""
    table, out, size = _codes(lengths), [], []
    for v in values.tolist():
        s = abs(v).bit_length()
        code, n = table[s]
        out.append(code << s | (v if v > 0 else v + (1 << s) - 1))
        size.append(n + s)
    return np.array(out, np.uint32), np.array(size, np.uint8)


DC_CODE, DC_SIZE = _with_bits(DC_LENGTHS, np.arange(-256, 257))
AC_CODE, AC_SIZE = _with_bits(AC_LENGTHS, VALUE)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    return _segment(0xC4, bytes([kind, *(sum(n == i for _, n in order) for i in range(1, 17)), *(s for s, _ in order)]))


_TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _huffman_segment(0x00, DC_LENGTHS) + _huffman_segment(0x10, AC_LENGTHS) + _segment(0xDD, struct.pack(">H", 3))
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _header(rows: int, note: bytes) -> bytes:
    return b"\xff\xd8" + _segment(0xFE, note) + _TABLES + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, WIDTH, 1, 1, 0x11, 0)) + _SCAN


def _entropy(rows: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bytes of (n, 192) payload rows, each followed by FF and its mark, and where each row ends."""
    n = len(rows)
    dc = VALUE[rows[:, ::64]]
    code, size = AC_CODE[rows], AC_SIZE[rows]
    step = np.diff(dc, axis=1, prepend=0) + 256
    code[:, ::64], size[:, ::64] = DC_CODE[step], DC_SIZE[step]
    total = size.sum(axis=1, dtype=np.int64)
    pad = (-total % 8).astype(np.uint8)
    code, size = np.column_stack([code, (1 << pad.astype(np.uint32)) - 1]).ravel(), np.column_stack([size, pad]).ravel()
    ends = np.cumsum(size, dtype=np.int64)
    at = (np.repeat(ends, size) - 1 - np.arange(ends[-1])).astype(np.uint8)
    packed = np.packbits((np.repeat(code, size) >> at).astype(np.uint8) & 1)
    row_bytes = (total + pad) // 8
    stuffed = packed == 255
    row_of = np.repeat(np.arange(n), row_bytes)
    where = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed + 2 * row_of
    out = np.zeros(len(packed) + int(stuffed.sum()) + 2 * n, np.uint8)
    out[where] = packed
    row_ends = np.cumsum(row_bytes + np.bincount(row_of, stuffed, n).astype(np.int64) + 2)
    out[row_ends - 2], out[row_ends - 1] = 255, marks
    return out.tobytes(), row_ends


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """Each padded payload as a stream of one or more baseline JPEGs; the unpadded length goes in a comment."""
    out: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not waiting:
            return
        counts = [len(r) for _, r in waiting]
        marks = np.concatenate([0xD0 + np.arange(c) % 8 for c in counts]).astype(np.uint8)
        last = np.cumsum(counts) - 1
        marks[last] = 0xD9
        coded, ends = _entropy(np.concatenate([r for _, r in waiting]), marks)
        starts = [0, *ends[last][:-1].tolist()]
        for (i, rows), a, b in zip(waiting, starts, ends[last].tolist()):
            out[i].append(_header(len(rows), str(lengths[i]).encode()) + coded[a:b])
        waiting.clear()

    held = 0
    for i, data in enumerate(payloads):
        rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
        for a in range(0, len(rows), MAX_ROWS):
            part = rows[a : a + MAX_ROWS]
            if held + len(part) > CHUNK_ROWS:
                flush()
                held = 0
            waiting.append((i, part))
            held += len(part)
    flush()
    return [b"".join(x) for x in out]


class Image:
    """Markers of one baseline JPEG, and where its scan begins and ends."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quant, self.huffman, self.restart, self.note = {}, {}, 0, b""
        while True:
            if data[at] != 255:
                raise ValueError("no marker where one is due")
            while data[at + 1] == 255:
                at += 1
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide, name = body[0] >> 4, body[0] & 15
                    n = 64 * (1 + wide)
                    self.quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif kind in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.note = body
            elif kind == 0xDA:
                if body[0] != len(self.parts):
                    raise ValueError("components are not interleaved in one scan")
                self.tables = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                break
        self.start = at
        self._layout()
        while True:
            at = data.index(b"\xff", at)
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
            elif data[at + 1] == 255:
                at += 1
            else:
                break
        if data[at + 1] != 0xD9:
            raise ValueError("more than one scan")
        self.stop, self.end = at, at + 2

    def _layout(self) -> None:
        """Blocks of an MCU as (component, DC table, AC table), and the number of MCUs."""
        alone = len(self.parts) == 1
        across, down = (1, 1) if alone else (max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values()))
        self.pattern = [(i, d, a) for i, (c, d, a) in enumerate(self.tables) for _ in range(1 if alone else self.parts[c][0] * self.parts[c][1])]
        self.mcu_columns, self.mcu_rows = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        self.sampling = (1, 1) if alone else self.parts[self.tables[0][0]][:2]

    def style(self) -> tuple:
        return tuple(self.pattern), tuple(sorted(self.huffman.items()))


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(spec: bytes) -> np.ndarray:
    """symbol << 8 | length by the next 16 bits; length 0 where no code fits."""
    if spec not in _LOOKUPS:
        out, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = spec[at] << 8 | n
                code, at = code + 1, at + 1
            code <<= 1
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[spec] = out
    return _LOOKUPS[spec]


def decode(data: list[bytes], images: list[list[Image]]) -> list[list[np.ndarray]]:
    """Quantised coefficients (blocks, 64) in zigzag order of every image of every stream."""
    out = [[None] * len(x) for x in images]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, own in enumerate(images):
        for j, image in enumerate(own):
            groups.setdefault(image.style(), []).append((i, j))
    for members in groups.values():
        held, size = [], 0
        for i, j in members:
            held.append((i, j))
            size += images[i][j].stop - images[i][j].start
            if size > 1 << 20:
                _decode_alike(data, images, held, out)
                held, size = [], 0
        _decode_alike(data, images, held, out)
    return out


def _decode_alike(data: list[bytes], images: list[list[Image]], members: list[tuple[int, int]], out: list) -> None:
    """Images of one MCU pattern and one set of Huffman tables: each restart interval is a lane, all lanes take a symbol a step."""
    if not members:
        return
    first = images[members[0][0]][members[0][1]]
    raw = np.frombuffer(b"".join(data[i][images[i][j].start : images[i][j].stop] for i, j in members) + bytes(8), np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    follows = raw[full + 1]
    marks = full[(follows >= 0xD0) & (follows <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[follows == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    new_at = np.cumsum(keep) - keep
    sizes = np.array([images[i][j].stop - images[i][j].start for i, j in members])
    opens = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lane_raw = np.sort(np.concatenate([opens, marks + 2]))
    clean = raw[keep].astype(np.uint32)
    window = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    # lanes: how many blocks, and where they go
    per_mcu, blocks, bases, total = len(first.pattern), [], [], 0
    for i, j in members:
        image = images[i][j]
        mcus = image.mcu_columns * image.mcu_rows
        each = image.restart or mcus
        lanes = -(-mcus // each)
        of = np.full(lanes, each * per_mcu)
        of[-1] = (mcus - each * (lanes - 1)) * per_mcu
        blocks.append(of)
        bases.append(total + np.arange(lanes) * each * per_mcu)
        total += mcus * per_mcu
    blocks, bases = np.concatenate(blocks), np.concatenate(bases)
    if len(blocks) != len(lane_raw):
        raise ValueError("restart markers do not match the image's size")
    names = sorted({x for p in first.pattern for x in ((p[1],), (16 + p[2],))})
    tables = np.concatenate([_lookup(first.huffman[n]) for (n,) in names])
    number = {n: k << 16 for k, (n,) in enumerate(names)}
    dc_table, ac_table = np.array([number[p[1]] for p in first.pattern]), np.array([number[16 + p[2]] for p in first.pattern])
    part = np.array([p[0] for p in first.pattern])
    coefficients = np.zeros(total * 64, np.int16)
    lane, bit = np.arange(len(blocks)), new_at[lane_raw].astype(np.int64) * 8
    k, block = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        phase = block % per_mcu if per_mcu > 1 else 0
        entry = tables[np.where(k == 0, dc_table[phase], ac_table[phase]) + ((window[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & 0xFFFF)]
        length, symbol = entry & 255, entry >> 8
        if not length.all():
            raise ValueError("no such Huffman code")
        bit += length
        s, run = symbol & 15, symbol >> 4
        extra = ((window[bit >> 3].astype(np.int64) << (bit & 7)) & 0xFFFFFFFF) >> (32 - s)
        value = np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)
        bit += s
        is_dc = k == 0
        end_of_block = ~is_dc & (s == 0) & (run != 15)
        k += np.where(is_dc, 0, run)
        live = ~end_of_block & (k < 64)
        coefficients[((bases[lane] + block) * 64 + k)[live]] = value[live]
        k = np.where(live, k + 1, 64)
        over = k >= 64
        if over.any():
            k[over] = 0
            block[over] += 1
            going = block < blocks[lane]
            if not going.all():
                lane, bit, k, block = lane[going], bit[going], k[going], block[going]
    coefficients = coefficients.reshape(-1, 64)
    # DC values are differences to the last block of the same component within the interval
    steps, component = coefficients[:, 0].astype(np.int64), np.tile(part, total // per_mcu)
    fresh = np.zeros(total, np.int64)
    fresh[bases] = 1
    interval = np.cumsum(fresh)
    for c in np.unique(part):
        own = np.flatnonzero(component == c)
        sums = np.cumsum(steps[own])
        starts = np.flatnonzero(np.diff(interval[own], prepend=0))
        before = np.concatenate([[0], sums])[starts]
        coefficients[own, 0] = sums - np.repeat(before, np.diff(np.append(starts, len(own))))
    at = 0
    for i, j in members:
        n = images[i][j].mcu_columns * images[i][j].mcu_rows * per_mcu
        out[i][j] = coefficients[at : at + n]
        at += n


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone, (rows, columns) of bytes."""
    across, down = image.sampling
    per = len(image.pattern)
    dc = coefficients[:, 0].reshape(-1, per)[:, : across * down] * int(image.quant[image.parts[image.tables[0][0]][2]][0])
    grid = dc.reshape(image.mcu_rows, image.mcu_columns, down, across).transpose(0, 2, 1, 3).reshape(image.mcu_rows * down, -1)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip(np.rint(grid / 8.0) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(grid: np.ndarray, side: int = 8) -> str:
    """Average hash of the grid brought to side x side by area means, 16 hex digits for side 8."""

    def cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(side) * n // side
        return a, np.maximum((np.arange(side) + 1) * n // side, a + 1)

    (a, b), (c, d) = cuts(grid.shape[0]), cuts(grid.shape[1])
    sums = np.pad(np.cumsum(np.cumsum(grid, axis=0, dtype=np.int64), axis=1), ((1, 0), (1, 0)))
    box = sums[np.ix_(b, d)] - sums[np.ix_(a, d)] - sums[np.ix_(b, c)] + sums[np.ix_(a, c)]
    mean = box / np.outer(b - a, d - c)
    return np.packbits(mean > mean.mean()).tobytes().hex()


def parse(media: bytes) -> list[Image]:
    """The images of a stream, one after the other."""
    at, out = 0, []
    while at < len(media):
        out.append(Image(media, at))
        at = out[-1].end
    return out


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, media): the UTF-8 of each whole text, padded, as baseline JPEGs. A null text is an empty one."""
    schema = docs.select(key).schema.add("media", "binary", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = byte_texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode([padded(t) for t in texts], [len(t) for t in texts]), pa.binary())], [key, "media"])

    return docs.select(key, text).mapInArrow(of, schema)


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sizes, digests and the feature of each stored stream, all from the bytes read.

    feature is width x height of the first image, the number of images, and the hash of their thumbnails one
    below the other.
    """
    kinds = [("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    schema = media.select(key).schema
    for name, _, kind in kinds:
        schema = schema.add(name, kind, False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            streams = b.column(1).to_pylist()
            images = [parse(m) for m in streams]
            rows = []
            for m, own, blocks in zip(streams, images, decode(streams, images)):
                payload = b"".join(BYTE[c.ravel().astype(np.int32) + 128].tobytes() for c in blocks)
                grid = np.concatenate([thumbnail(i, c) for i, c in zip(own, blocks)])
                rows.append((int(own[0].note), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{own[0].width}x{own[0].height}x{len(own)}:{thumbnail_hash(grid)}"))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k, _) in zip(columns, kinds))], [key, *(n for n, _, _ in kinds)])

    return media.select(key, "media").mapInArrow(of, schema)


def op7_jpeg_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as JPEG in the shared folder, and what reading it back gives.

    One row per row; null ids and repeated rows pass through, other columns play no part, and an empty table
    gives an empty one.
    """
    return media_features(stored(media_column(table(spark, sf_dir, "documents")), "media"))
