"""Baseline JPEG media columns.

``encode`` stores bytes losslessly in a greyscale baseline JPEG: the format's unit is
the 8 x 8 block of 64 quantised coefficients, and each coefficient carries one byte.
Bytes below 128 become -255..-128 and the others 128..255, so that every
coefficient is of magnitude category 8 and its eight magnitude bits are the byte.
A restart interval of one block makes the DC differences the values themselves.

``decode`` reads any baseline (SOF0, 8-bit, Huffman) JPEG: it parses the markers,
Huffman-decodes the scan, undoes the DC prediction and gives the coefficients of each
component, the dimensions and a DC-only luminance thumbnail.  Restart segments are
independent, so all segments of all images of a batch that share their tables are
decoded together, a coefficient at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 64
MAX_SIDE = 65_528
#: Fixed value: the zigzag order of coefficients, from its rule (diagonals of alternating direction).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(1, -(-len(data) // unit)) * unit - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(table_class: int, index: int, codes: dict[int, list[int]]) -> bytes:
    counts = bytes(len(codes.get(n, [])) for n in range(1, 17))
    return bytes([table_class << 4 | index]) + counts + bytes(x for n in sorted(codes) for x in codes[n])


def sides(blocks: int) -> tuple[int, int]:
    """Blocks across and down of the most nearly square image that holds so many."""
    wide = int(np.ceil(np.sqrt(blocks)))
    if wide * 8 > MAX_SIDE:
        raise ValueError("more blocks than a JPEG can hold")
    return wide, -(-blocks // wide)


def encode(payload: bytes) -> bytes:
    """A JPEG whose coefficients are ``payload``, which is a positive multiple of 64 bytes; the rest of the last row is zero blocks."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    count = len(payload) // UNIT
    wide, high = sides(count)
    body = np.zeros((wide * high, UNIT), np.uint8)
    body[:count] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    bits = np.zeros((wide * high, UNIT, 9), np.uint8)  # code 0 (category 8, no zeros before it), then the byte
    bits[:, :, 1:] = np.unpackbits(body, axis=1).reshape(-1, UNIT, 8)
    scan = np.packbits(bits.reshape(wide * high, UNIT * 9), axis=1)
    full = np.concatenate([scan, np.zeros((len(scan), 2), np.uint8)], axis=1)
    full[:, -2], full[:, -1] = 0xFF, 0xD0 + np.arange(len(scan)) % 8
    flat = full.ravel()[:-2]  # no restart marker after the last
    stuffed = np.flatnonzero((flat == 0xFF) & (np.arange(len(flat)) % full.shape[1] < scan.shape[1]))
    entropy = np.insert(flat, stuffed + 1, 0).tobytes()
    head = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0"),
        _segment(0xC4, _huffman(0, 0, {1: [0x08]}) + _huffman(1, 0, {1: [0x08], 2: [0x00]})),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ]
    return b"".join([*head, entropy, b"\xff\xd9"])


@dataclass
class Component:
    number: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    interval: int = 0
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    parts: list[Component] = field(default_factory=list)
    scan: bytes = b""

    @property
    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        a, d = (8 * max(getattr(c, k) for c in self.parts) for k in ("across", "down"))
        if len(self.parts) == 1:
            a = d = 8
        return -(-self.width // a), -(-self.height // d)

    @property
    def plan(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.parts) == 1:
            return [0]
        return [i for i, c in enumerate(self.parts) for _ in range(c.across * c.down)]


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG up to its only scan; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, index = body[0] >> 4, body[0] & 15
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                image.quants[index], body = values.astype(np.int64), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0] >> 4, body[0] & 15], body = body[1:n], body[n:]
        elif marker == 0xC0:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are baseline")
            image.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            (image.interval,) = struct.unpack_from(">H", body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            if body[0] != len(image.parts):
                raise ValueError("several scans")
            by = {c.number: c for c in image.parts}
            for i in range(body[0]):
                by[body[1 + 2 * i]].dc, by[body[1 + 2 * i]].ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            end = data.rfind(b"\xff\xd9")
            image.scan = data[at : end if end >= at else len(data)]
            # nothing is allocated for an image that its scan can't fill: a block takes two bits at least
            if not image.parts or not image.width or not image.height or any(not 1 <= x <= 4 for c in image.parts for x in (c.across, c.down)):
                raise ValueError("no size, no component, or a sampling factor out of 1 to 4")
            if image.units[0] * image.units[1] * len(image.plan) * 2 > 8 * len(image.scan):
                raise ValueError("the scan is too short for the image")
            return image


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16-bit prefix; length 0 where no code begins so."""
    sizes, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            sizes[lo:hi], symbols[lo:hi] = n, table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return sizes, symbols


def _unstuffed(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scans without stuffing and restart markers; where each segment begins, and its image."""
    data = np.frombuffer(b"".join(x.scan for x in images) + b"\0", np.uint8)
    first = np.cumsum([0, *(len(x.scan) for x in images)])
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[mark[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    begins = np.sort(np.concatenate([first[:-1], restart + 2]))
    owner = np.searchsorted(first, begins, "right") - 1
    kept = np.cumsum(~drop) - ~drop
    return data[~drop], kept[begins], owner


def _decode_group(images: list[Image]) -> list[np.ndarray]:
    """Coefficients in zigzag order, (blocks, 64) for each image, blocks in scan order; the images share tables and plan."""
    plan, parts = images[0].plan, images[0].parts
    tables = {k: lookup(images[0].tables[k]) for c in parts for k in ((0, c.dc), (1, c.ac))}
    data, begins, owner = _unstuffed(images)
    data = np.concatenate([data, np.full(8, 255, np.uint8)])
    total = np.array([x.units[0] * x.units[1] for x in images])
    every = np.array([x.interval or x.units[0] * x.units[1] for x in images])
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    todo = np.minimum(every[owner], total[owner] - place * every[owner])
    if (todo <= 0).any() or (np.bincount(owner, todo, len(images)) != total).any():
        raise ValueError("restart markers do not fit the image")
    width = len(plan)
    starts = np.cumsum(total * width) - total * width
    row0 = starts[owner] + place * every[owner] * width
    out = np.zeros((int((total * width).sum()), 64), np.int16)
    bit = begins.astype(np.int64) * 8
    last = np.zeros((len(parts), len(bit)), np.int64)
    wide = data.astype(np.uint32)
    words = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]

    def symbol(live: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
        """Next symbol and its magnitude value; moves the bit places on."""
        at = bit[live]
        view = words[at >> 3].astype(np.uint64) << np.uint64(8) | data[(at >> 3) + 4]
        shift = (at & 7).astype(np.uint64)
        head = (view >> (np.uint64(24) - shift)).astype(np.int64) & 0xFFFF
        size, found = table[0][head], table[1][head]
        if not size.all():
            raise ValueError("no such Huffman code")
        cat = (found & 15).astype(np.int64)
        rest = at + size
        view = words[rest >> 3].astype(np.uint64) << np.uint64(8) | data[(rest >> 3) + 4]
        raw = (view >> (np.uint64(40) - (rest & 7).astype(np.uint64) - cat.astype(np.uint64))).astype(np.int64) & ((1 << cat) - 1)
        bit[live] = rest + cat
        return found, np.where((cat > 0) & (raw < (1 << np.maximum(cat, 1) - 1)), raw - (1 << cat) + 1, raw)

    limit = (len(words) - 2) * 8
    for mcu in range(int(todo.max())):
        here = np.flatnonzero(todo > mcu)
        for j, part in enumerate(plan):
            dc, ac = tables[0, parts[part].dc], tables[1, parts[part].ac]
            row = row0[here] + mcu * width + j
            _, diff = symbol(here, dc)
            last[part, here] += diff
            out[row, 0] = last[part, here]
            k = np.ones(len(here), np.int64)
            live = np.arange(len(here))
            while len(live):
                if (bit[here[live]] > limit).any():
                    raise ValueError("the scan ends early")
                found, value = symbol(here[live], ac)
                run, cat = (found >> 4).astype(np.int64), found & 15
                k[live] += run
                put = cat > 0
                if (k[live][put] > 63).any():
                    raise ValueError("more than 64 coefficients")
                out[row[live[put]], k[live[put]]] = value[put]
                k[live] += 1
                go = (put | (run == 15)) & (k[live] < 64)
                live = live[go]
    return [out[a : a + n * width] for a, n in zip(starts.tolist(), total.tolist(), strict=True)]


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Parse and Huffman-decode baseline JPEGs; those with equal tables together."""
    images = [parse(x) for x in files]
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        kind = (tuple(sorted(x.tables.items())), tuple((c.across, c.down, c.dc, c.ac) for c in x.parts))
        groups.setdefault(kind, []).append(i)
    out: list = [None] * len(images)
    for members in groups.values():
        for i, blocks in zip(members, _decode_group([images[i] for i in members]), strict=True):
            out[i] = (images[i], blocks)
    return out


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance: one 8-bit sample for each 8 x 8 block of the first component."""
    part, (mx, my) = image.parts[0], image.units
    plan = np.array(image.plan)
    dc = blocks.reshape(mx * my, len(plan), 64)[:, plan == 0, 0].astype(np.int64)
    a, d = (part.across, part.down) if len(image.parts) > 1 else (1, 1)
    grid = dc.reshape(my, mx, d, a).transpose(0, 2, 1, 3).reshape(my * d, mx * a)
    return np.clip(np.rint(grid * image.quants[part.quant][0] / 8) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64-bit difference hash: nearest samples on a side x (side + 1) grid, each compared with its right neighbour."""
    rows = np.arange(side) * thumb.shape[0] // side
    cols = np.arange(side + 1) * thumb.shape[1] // (side + 1)
    grid = thumb[np.ix_(rows, cols)]
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    stored = blocks[: int(image.comment.split()[1]) // UNIT]
    return np.where(stored < 0, stored + 255, stored).astype(np.uint8).tobytes()


def _store(with_media: bool):
    fields = [("_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    fields += [("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_hash", pa.string())]
    schema = pa.schema(fields + [("media", pa.binary())] * with_media)

    def settle(ids: list, sizes: list[int], files: list[bytes]) -> pa.RecordBatch:
        out = []
        for i, n, raw, (image, blocks) in zip(ids, sizes, files, decode(files), strict=True):
            payload, mark = payload_of(image, blocks), thumbnail_hash(thumbnail(image, blocks))
            row = [i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest()]
            out.append(row + [f"{image.width}x{image.height}:{mark}", image.width, image.height, mark] + [raw] * with_media)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("_id").to_pylist(), ([], [], [])
            data, off = C.text_buffers(batch.column("_t"))
            for i, row in enumerate(ids):
                text = data[off[i] : off[i + 1]].tobytes()
                for column, x in zip(held, (row, len(text), encode(pad(text))), strict=True):
                    column.append(x)
                if sum(held[1][-1:]) >= C.BLOCK // 2 or len(held[0]) == 256:
                    yield settle(*held)
                    held = ([], [], [])
            if held[0]:
                yield settle(*held)

    return run


def _features():
    schema = pa.schema([("_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_hash", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, raw in zip(batch.column("_id").to_pylist(), batch.column("_m").to_pylist(), strict=True):
                try:
                    ((image, blocks),) = decode([raw or b""])
                    out.append((i, image.width, image.height, thumbnail_hash(thumbnail(image, blocks)), None))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    out.append((i, None, None, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def jpeg_features(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, width, height, thumbnail_hash of each JPEG of a binary column; ``error`` says why one can't be read (null and empty ones too)."""
    C.prepare(media.sparkSession)
    rows = media.select(media[id_col].cast("long").alias("_id"), media[media_col].alias("_m"))
    return rows.mapInArrow(_features(), "_id long, width int, height int, thumbnail_hash string, error string").withColumnRenamed("_id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as a JPEG, read it back, and give the payload's and the image's features.

    A row per row; a null text is empty and an empty one is one block of zeros; equal texts give equal values; an empty table
    gives an empty result; other columns are ignored.  ``with_media`` adds the stored bytes.  No shuffle.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    kinds = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"
    return rows.mapInArrow(_store(with_media), kinds + ", media binary" * with_media).withColumnRenamed("_id", id_col)
