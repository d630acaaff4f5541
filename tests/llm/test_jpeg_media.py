import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from trilattice.llm import jpeg_media as J


def scalar_decode(media, image):
    """Bit by bit, block by block."""
    at, bits, out = image.start, [], []
    codes = {}
    for name, spec in image.huffman.items():
        code, k, own = 0, 16, {}
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                own[(n, code)] = spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes[name] = own
    segments, now = [], bytearray()
    while at < image.stop:
        if media[at] == 255 and media[at + 1] != 0:
            segments.append(now)
            now, at = bytearray(), at + 2
        else:
            now.append(media[at])
            at += 2 if media[at] == 255 else 1
    segments.append(now)
    left = image.mcu_rows * image.mcu_columns
    for seg in segments:
        bits, pos = "".join(f"{b:08b}" for b in seg), 0

        def symbol(name):
            nonlocal pos
            n = 1
            while (n, int(bits[pos : pos + n], 2)) not in codes[name]:
                n += 1
            pos += n
            return codes[name][(n, int(bits[pos - n : pos], 2))]

        def value(s):
            nonlocal pos
            if not s:
                return 0
            x = int(bits[pos : pos + s], 2)
            pos += s
            return x if x >> (s - 1) else x - (1 << s) + 1

        last = {}
        for _ in range(min(left, image.restart or left)):
            left -= 1
            for c, d, a in image.pattern:
                block = [0] * 64
                last[c] = last.get(c, 0) + value(symbol(d))
                block[0], k = last[c], 1
                while k < 64:
                    s = symbol(16 + a)
                    if s & 15 == 0 and s != 0xF0:
                        break
                    k += s >> 4
                    block[k] = value(s & 15)
                    k += 1
                out.append(block)
    return np.array(out)


def texts():
    rng = random.Random(4)
    return [b"", b"a", b"x" * 575, b"x" * 576, b"x" * 577, bytes(range(256)) * 9, "é漢 test".encode() * 40, bytes(rng.randrange(256) for _ in range(20_000)), rng.randbytes(J.MAX_ROWS * J.ROW + 700)]


def test_round_trip_and_scalar_decoder():
    data = texts()
    media = J.encode([J.padded(d) for d in data], [len(d) for d in data])
    images = [J.parse(m) for m in media]
    assert [len(i) for i in images] == [1] * 8 + [2]
    for d, m, own, blocks in zip(data, media, images, J.decode(media, images)):
        back = b"".join(J.BYTE[c.ravel().astype(int) + 128].tobytes() for c in blocks)
        assert back == J.padded(d) and len(back) % 576 == 0 and int(own[0].note) == len(d)
        if len(d) < 30_000:
            assert (scalar_decode(m, own[0]) == blocks[0]).all()
            assert J.thumbnail(own[0], blocks[0]).shape == (own[0].height // 8, 3)


def colour_image(rng, restart):
    """A 4:2:0 image of random sparse coefficients by another, plain encoder."""
    dc = J._codes({s: 4 for s in range(12)})
    ac = J._codes({s: 8 for s in [0x00, 0xF0, *(r << 4 | s for r in range(0, 16, 3) for s in range(1, 7))]})
    pattern, bits, blocks, out, last = [0, 0, 0, 0, 1, 2], "", [], b"", {}

    def put(v, s):
        return "" if not s else f"{v if v > 0 else v + (1 << s) - 1:0{s}b}"

    mcus = 6
    for m in range(mcus):
        if restart and m and m % restart == 0:
            bits += "1" * (-len(bits) % 8)
            out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes([255, 0xD0 + (m // restart - 1) % 8])
            bits, last = "", {}
        for c in pattern:
            block = [0] * 64
            block[0] = rng.randrange(-700, 700)
            diff = block[0] - last.get(c, 0)
            last[c] = block[0]
            s = abs(diff).bit_length()
            bits += f"{dc[s][0]:0{dc[s][1]}b}" + put(diff, s)
            k = 1
            while True:
                run = rng.choice([0, 3, 6, 9, 12, 15, 18])
                if k + run > 63 or rng.random() < 0.1:
                    bits += f"{ac[0][0]:08b}"
                    break
                if run >= 16:
                    bits += f"{ac[0xF0][0]:08b}"
                    k, run = k + 16, 0
                k += run
                v = rng.choice([-1, 1]) * rng.randrange(1, 60)
                s = abs(v).bit_length()
                bits += f"{ac[run << 4 | s][0]:08b}" + put(v, s)
                block[k] = v
                k += 1
                if k == 64:
                    break
            blocks.append(block)
    bits += "1" * (-len(bits) % 8)
    out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + J._segment(0xE0, b"JFIF\0") + J._segment(0xDB, bytes([0] + [2] * 64))
    head += J._segment(0xC0, struct.pack(">BHHB", 8, 30, 41, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += J._huffman_segment(0, {s: 4 for s in range(12)}) + J._huffman_segment(16, {s: 8 for s in ac})
    head += (J._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + J._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return head + out + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_colour_images_of_another_encoder(restart):
    made = [colour_image(random.Random(i), restart) for i in range(4)]
    images = [J.parse(m) for m, _ in made]
    for (m, want), own, (got,) in zip(made, images, J.decode([m for m, _ in made], images)):
        assert (got == want).all() and (scalar_decode(m, own[0]) == want).all()
        assert J.thumbnail(own[0], got).shape == (4, 6)


def test_other_kinds_are_refused():
    good = J.encode([J.padded(b"q")], [1])[0]
    for bad in (good[2:], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises((ValueError, IndexError)):
            J.decode([bad], [J.parse(bad)])


def test_query(spark):
    docs = spark.createDataFrame([(1, "é text", 5), (None, None, 5), (2, "", 5), (2, "", 5), (3, "z" * 9000, 1)], "doc_id long, text string, media long")
    rows = J.media_features(J.media_column(docs)).collect()
    assert len(rows) == 5
    for (i, t, _), r in zip(docs.collect(), rows):
        p = J.padded((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert rows[2].media_sha256 == rows[3].media_sha256 == rows[1].media_sha256
    assert J.media_features(J.media_column(docs.where("false"))).collect() == []
    assert J.op7_jpeg_media(spark, "/root/testdata/sf0.001").count() == 200
