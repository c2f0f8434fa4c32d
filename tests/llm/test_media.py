import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tonearm.llm import media as M


def test_zigzag_is_a_path():
    steps = [(abs(a // 8 - b // 8), abs(a % 8 - b % 8)) for a, b in zip(M.ZIGZAG, M.ZIGZAG[1:])]
    assert sorted(M.ZIGZAG) == list(range(64)) and all(max(s) == 1 for s in steps)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 640, 5000, 70_000])
def test_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n)) if n != 640 else b"\xff" * n
    payload = M.pad(data)
    assert len(payload) % 64 == 0 and payload[:n] == data
    ((image, blocks),) = M.decode([M.encode(payload)])
    assert M.payload_of(image, blocks) == payload


def test_several_images_share_a_call():
    payloads = [M.pad(bytes([i]) * (50 * i)) for i in range(20)]
    assert [M.payload_of(*x) for x in M.decode([M.encode(p) for p in payloads])] == payloads


# a plain encoder of any coefficients, for images that are not ours
def plain_jpeg(blocks, plan, sampling, width, height, interval, seed):
    """blocks: (mcu, len(plan), 64) in zigzag order."""
    r = random.Random(seed)
    dc_symbols, ac_symbols = list(range(12)), [run << 4 | c for run in range(16) for c in range(1, 11)] + [0x00, 0xF0]
    tables = {}
    for t in range(2):
        for kind, symbols in ((0, dc_symbols), (1, ac_symbols)):
            s = symbols[:]
            r.shuffle(s)
            tables[kind, t] = {4: s} if len(s) < 16 else {3: s[:5], 9: s[5:]}
    codes = {}
    for key, t in tables.items():
        code, length, codes[key] = 0, 0, {}
        for n in sorted(t):
            code <<= n - length
            length = n
            for x in t[n]:
                codes[key][x] = format(code, f"0{n}b")
                code += 1
    magnitude = lambda v: (0, "") if v == 0 else (abs(v).bit_length(), format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b"))
    scan, bits, last = b"", "", {}

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            b = int(bits[i : i + 8], 2)
            scan += bytes([b]) + (b"\0" if b == 255 else b"")
        bits = ""

    for m, mcu in enumerate(blocks):
        if interval and m and m % interval == 0:
            flush()
            scan += bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            last = {}
        for part, block in zip(plan, mcu):
            t = min(part, 1)
            c, b = magnitude(int(block[0]) - last.get(part, 0))
            last[part] = int(block[0])
            bits += codes[0, t][c] + b
            run = 0
            top = max([k for k in range(1, 64) if block[k]], default=0)
            for k in range(1, top + 1):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += codes[1, t][0xF0]
                    run -= 16
                c, b = magnitude(int(block[k]))
                bits += codes[1, t][run << 4 | c] + b
                run = 0
            if top < 63:
                bits += codes[1, t][0x00]
    flush()
    n = len(sampling)
    out = b"\xff\xd8" + M._segment(0xDB, b"\0" + bytes(range(2, 66)))
    out += M._segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling)))
    out += b"".join(M._segment(0xC4, M._huffman(k, t, x)) for (k, t), x in tables.items())
    out += M._segment(0xDD, struct.pack(">H", interval)) if interval else b""
    out += M._segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, min(i, 1) << 4 | min(i, 1)]) for i in range(n)) + b"\0\x3f\0")
    return out + scan + b"\xff\xd9"


@pytest.mark.parametrize("seed,interval", [(1, 0), (2, 0), (3, 2), (4, 5)])
def test_other_peoples_images(seed, interval):
    r = np.random.default_rng(seed)
    sampling = [(1, 1)] if seed % 2 else [(2, 2), (1, 1), (1, 1)]
    plan = [0] if seed % 2 else [0, 0, 0, 0, 1, 2]
    width, height = 40, 24
    unit = 8 if seed % 2 else 16
    mcus = -(-width // unit) * -(-height // unit)
    blocks = r.integers(-200, 200, (mcus, len(plan), 64)) * (r.random((mcus, len(plan), 64)) < 0.15)
    raw = plain_jpeg(blocks, plan, sampling, width, height, interval, seed)
    ((image, got),) = M.decode([raw])
    assert (image.width, image.height) == (width, height)
    assert (got == blocks.reshape(-1, 64)).all()
    thumb = M.thumbnail(image, got)
    down = 2 if seed % 2 == 0 else 1
    assert thumb.shape == (-(-height // unit) * down, -(-width // unit) * down)
    assert thumb[0, 0] == np.clip(round(blocks[0, 0, 0] * 2 / 8) + 128, 0, 255)


def test_query_rows(spark):
    texts = [(1, "hello wörld"), (2, None), (3, ""), (4, "x" * 200_000), (4, "x" * 200_000), (None, "é" * 32)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, feature int")
    rows = M.text_media(docs, with_media=True).collect()
    assert len(rows) == len(texts)
    for row, (i, t) in zip(sorted(rows, key=lambda x: str(x.doc_id)), sorted(texts, key=lambda x: str(x[0]))):
        payload = M.pad((t or "").encode())
        assert (row.doc_id, row.n_bytes, row.payload_bytes) == (i, len((t or "").encode()), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_sha256 == hashlib.sha256(row.media).hexdigest() and row.media_bytes == len(row.media)
    assert M.text_media(docs.limit(0)).collect() == []


def test_broken_media_have_a_reason(spark):
    good = bytearray(M.encode(M.pad(b"abc" * 100)))
    media = spark.createDataFrame([(1, good), (2, None), (3, bytearray()), (4, bytearray(b"\x89PNG")), (5, good[:150])], "id long, m binary")
    rows = {r.id: r for r in M.jpeg_features(media, "id", "m").collect()}
    assert rows[1].error is None and rows[1].thumbnail_hash and all(rows[i].error for i in (2, 3, 4, 5))


def test_unreadable_media_are_told_of(spark):
    good = M.encode(M.pad(b"some text"))
    at = good.index(b"\xff\xc0")
    sampling = bytearray(good)
    sampling[at + 11] = 0  # both factors of the component
    huge = bytearray(good)
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    rows = [(1, bytes(good)), (2, bytes(sampling)), (3, bytes(huge)), (4, None), (5, b""), (6, good[:40]), (7, b"\xff\xd8" + bytes(range(256)))]
    got = {x.id: x.error for x in M.jpeg_features(spark.createDataFrame(rows, "id long, m binary"), "id", "m").collect()}
    assert got[1] is None and all(got[i] for i in range(2, 8)) and "too short" in got[3]
