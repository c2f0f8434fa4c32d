"""Byte-level substring dedup by threshold-bounded interval expansion on a BWT.

Every string of ``length`` bytes has an anchor: the smallest hash among its
``gram``-byte pieces (winnowing).  Equal strings have equal anchors at equal
places, so only strings round the same anchor can be equal, and anchors that
occur once need no further work.  For each remaining anchor the distinct
surroundings are suffix sorted once from the anchor on; then the interval of each
depth is extended backwards by one byte, breadth first over all anchors of a
block: the column of preceding bytes in suffix order is the Burrows-Wheeler
transform, a stable sort of it within each interval is the LF step, and the common
prefixes (LCP) of the longer suffixes are one more than the minimum over the old
interval.  Intervals that cannot reach ``length`` any more are dropped; a suffix
whose LCP with a neighbour reaches it starts a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 200
GRAM = 64
#: An anchor that occurs more often than this is settled string by string, in any number of tasks.
GROUP_LIMIT = 40_000


def _owned(block: C.Block, length: int, gram: int):
    """Anchors of a block: piece, anchor place, first and last start that it owns (places in the block), hash."""
    sums = C.prefix_sums(C.BYTE_VALUES[block.data])
    grams = C.gram_hashes(sums, gram)
    at = C.window_minima(grams, length - gram + 1)
    sizes = np.diff(block.offsets)
    piece = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    if not len(piece):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    counts = np.maximum(0, sizes - length + 1)
    first = np.cumsum(counts) - counts
    starts = block.offsets[piece] + np.arange(len(piece)) - first[piece]
    anchors = at[starts]
    runs = C.run_starts(piece, anchors)
    last = np.concatenate([runs[1:] - 1, [len(starts) - 1]])
    return piece[runs], anchors[runs], starts[runs], starts[last], grams[anchors[runs]]


def _anchors(length: int, gram: int):
    schema = pa.schema([("h", pa.int64()), ("_k", pa.int64()), ("p", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            for block in C.byte_blocks(batch.column("_t"), length - 1):
                piece, at, _, _, h = _owned(block, length, gram)
                if len(piece):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(keys[block.rows[piece]]), pa.array(at - block.offsets[piece] + block.base[piece])], schema=schema
                    )

    return run


def _contexts(length: int, gram: int):
    schema = pa.schema([("cid", pa.binary()), ("h", pa.int64()), ("ctx", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("_k", pa.int64()), ("p", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column("_k").to_numpy(zero_copy_only=False), batch.column("at")
            for block in C.byte_blocks(batch.column("_t"), length - 1):
                piece, at, s0, s1, h = _owned(block, length, gram)
                if not len(piece):
                    continue
                place = at - block.offsets[piece] + block.base[piece]
                keep = np.zeros(len(piece), bool)
                edges = np.searchsorted(piece, np.arange(len(block.rows) + 1))
                for i, row in enumerate(block.rows):
                    lo, hi = edges[i], edges[i + 1]
                    keep[lo:hi] = np.isin(place[lo:hi], np.asarray(wanted[int(row)].as_py(), np.int64))
                raw = block.data.tobytes()
                cid, ctx, sel = [], [], np.flatnonzero(keep)
                for a, b, c in zip((at - s1)[sel].tolist(), s0[sel].tolist(), s1[sel].tolist(), strict=True):
                    body = raw[b : c + length]
                    ctx.append(body)
                    cid.append(hashlib.md5(body + a.to_bytes(4, "little")).digest())
                if cid:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cid, pa.binary()), pa.array(h[sel].view(np.int64)), pa.array(ctx, pa.binary()), pa.array((at - s1)[sel].astype(np.int32)),
                            pa.array((at - s0)[sel].astype(np.int32)), pa.array(keys[block.rows[piece[sel]]]), pa.array(place[sel]),
                        ],
                        schema=schema,
                    )

    return C.frees(run)


def expand_intervals(group: np.ndarray, data: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For each context and each depth 0..max(hi): does the string that starts so far before the anchor occur twice?

    A context is data[off[i]:off[i+1]] with its anchor at ``hi`` and owns the depths lo..hi; it stands for ``weight`` equal ones.
    """
    m, deep = len(lo), int(hi.max(initial=0))
    marks = np.zeros((m, deep + 1), bool)
    depth = np.arange(deep + 1)
    marks |= (weight[:, None] > 1) & (depth >= lo[:, None]) & (depth <= hi[:, None])
    if m < 2:
        return marks
    anchor = off[:-1] + hi
    right = np.zeros((m, 8 + length), np.uint8)
    right[:, :8] = group.astype(">u8").view(np.uint8).reshape(m, 8)
    sizes = (off[1:] - anchor).astype(np.int32)
    span = np.arange(length, dtype=np.int32)
    for a in range(0, m, 4096):
        inside = span < sizes[a : a + 4096, None]
        right[a : a + 4096, 8:][inside] = data[(anchor[a : a + 4096, None] + span)[inside]]
    order = np.argsort(right.view(f"S{8 + length}").ravel(), kind="stable")
    lcp = np.zeros(m, np.int32)
    for a in range(1, m, 4096):
        b = min(m, a + 4096)
        x, y = order[a - 1 : b - 1], order[a:b]
        differ = right[x] != right[y]
        same = ~differ[:, :8].any(1)
        far = np.where(differ[:, 8:].any(1), differ[:, 8:].argmax(1), length)
        lcp[a:b] = np.where(same, np.minimum(far, np.minimum(sizes[x], sizes[y])), 0)
    ids = order
    for depth_now in range(deep + 1):
        full = lcp >= length
        hit = full.copy()
        hit[:-1] |= full[1:]
        who = ids[hit]
        marks[who[hi[who] >= depth_now], depth_now] = True
        if depth_now == deep:
            break
        interval = np.cumsum(lcp < length - (deep - depth_now))
        alive = (np.bincount(interval)[interval] > 1) & (hi[ids] > depth_now)
        old = np.flatnonzero(alive)
        if len(old) < 2:
            break
        before = data[anchor[ids[old]] - depth_now - 1].astype(np.int64)  # the BWT column
        step = interval[old] * 256 + before
        turn = np.argsort(step, kind="stable")
        old, step = old[turn], step[turn]
        joined = np.flatnonzero(step[1:] == step[:-1])
        grown = np.zeros(len(old), np.int32)
        if len(joined):
            edges = np.stack([old[joined] + 1, old[joined + 1] + 1], 1).ravel()
            grown[joined + 1] = np.minimum.reduceat(np.append(lcp, np.int32(length)), edges)[::2] + 1
        ids, lcp = ids[old], np.minimum(grown, length + deep)
    return marks


def _expand(length: int, block: int = 12_000):
    """Rows come sorted by anchor; each call of expand_intervals takes whole anchors, and equal surroundings once."""
    schema = pa.schema([("_k", pa.int64()), ("p", pa.int64()), ("mask", pa.binary())])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        names: dict[tuple[int, int, bytes], int] = {}
        same = zip(*(rows.column(c).to_pylist() for c in ("h", "lo", "ctx")), strict=True)
        which = np.array([names.setdefault(x, len(names)) for x in same], np.int64)
        first = np.unique(which, return_index=True)[1]
        chosen = rows.take(pa.array(first)).combine_chunks()
        data, off = C.text_buffers(chosen.column("ctx"))
        get = lambda c: chosen.column(c).to_numpy().astype(np.int64)
        marks = expand_intervals(get("h").view(np.uint64), data, off, get("lo"), get("hi"), np.bincount(which), length)
        bits = [x.tobytes() for x in np.packbits(marks, axis=1)]
        some = np.flatnonzero(marks.any(1)[which])
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(some)) for c in ("_k", "p")] + [pa.array([bits[i] for i in which[some].tolist()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= block:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left"))
                if cut:
                    yield settle(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).combine_chunks().to_batches()
                    count = len(rows) - cut
        if count:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return C.frees(run)


#: A second code of each byte: with it, two strings are told apart by 128 bits.
OTHER_VALUES = C.mix(C.BYTE_VALUES ^ np.uint64(0x5DEECE66D))


def _strings(length: int):
    """Every owned string of a context by two hashes, for anchors with very many contexts."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("cid", pa.binary()), ("depth", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffers(batch.column("ctx"))
            lo, hi, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi", "n"))
            count = hi - lo + 1
            row = np.repeat(np.arange(len(lo)), count)
            depth = lo[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
            start = off[row] + hi[row] - depth
            s1, s2 = (C.gram_hashes(C.prefix_sums(values[data]), length)[start].view(np.int64) for values in (C.BYTE_VALUES, OTHER_VALUES))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), batch.column("cid").take(pa.array(row)), pa.array(depth.astype(np.int32)), pa.array(n[row])], schema=schema)

    return run


def _depths_to_mask():
    schema = pa.schema([("cid", pa.binary()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for depths in batch.column("depths").to_pylist():
                bits = np.zeros(max(depths) + 1, bool)
                bits[depths] = True
                masks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(masks, pa.binary())], schema=schema)

    return run


def _cut(length: int, with_text: bool):
    fields = [("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffers(batch.column("_t"))
            raw, out = memoryview(data.tobytes()), []
            for i, found in enumerate(batch.column("found")):
                a, b = int(off[i]), int(off[i + 1])
                starts = []
                for x in found.as_py() or []:
                    bits = np.unpackbits(np.frombuffer(x["mask"], np.uint8))
                    starts.append(x["p"] - np.flatnonzero(bits))
                first = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
                s, e = C.union_length(first, first + length)
                kept, at = [], a
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(raw[at : a + x])
                    at = a + y
                kept.append(raw[at:b])
                digest = hashlib.sha256()
                for x in kept:
                    digest.update(x)
                row = [b - a, int((e - s).sum()), len(s), digest.hexdigest(), np.stack([s, e], 1).ravel().tolist()]
                out.append(row + [b"".join(kept)] * with_text)
            columns = [batch.column("_id").cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return C.frees(run)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, with_text: bool = False) -> DataFrame:
    """Cut every byte that lies in a ``length``-byte string occurring at two places or more.

    Returns a row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, start, ...)
    and, if ``with_text``, the kept bytes.  A null text is empty; a text shorter than ``length`` is kept whole; a repeated
    row counts as another place; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    C.shared_dir(spark)
    rows = C.keyed(docs, id_col, text_col)
    texts = rows.select("_k", "_t").where(F.octet_length("_t") >= length)
    anchors = texts.mapInArrow(_anchors(length, gram), "h long, _k long, p long")
    with C.cleanup(spark):
        counted = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").checkpoint()

    def surroundings(which: str) -> DataFrame:
        wanted = C.salted_join(anchors, counted, ["h"], F.xxhash64("_k", "p"), which=which).groupBy("_k").agg(F.collect_set("p").alias("at"))
        return rows.join(wanted, "_k").select("_k", "_id", "_t", "at").mapInArrow(_contexts(length, gram), "cid binary, h long, ctx binary, lo int, hi int, _k long, p long")

    masks = surroundings(f"c <= {group_limit}").drop("cid").repartition("h").sortWithinPartitions("h").mapInArrow(_expand(length), "_k long, p long, mask binary")
    hot = surroundings(f"c > {group_limit}")
    distinct = hot.groupBy("cid", "ctx", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    strings = distinct.mapInArrow(_strings(length), "s1 long, s2 long, cid binary, depth int, n long")
    again = strings.groupBy("s1", "s2").agg(F.sum("n").alias("n")).where("n > 1").select("s1", "s2")
    rest = strings.join(again, ["s1", "s2"], "left_semi").groupBy("cid").agg(F.collect_list("depth").alias("depths")).mapInArrow(_depths_to_mask(), "cid binary, mask binary")
    each = masks.unionByName(hot.select("cid", "_k", "p").join(rest, "cid").select("_k", "p", "mask")).groupBy("_k").agg(F.collect_set(F.struct("p", "mask")).alias("found"))
    out = rows.join(each, "_k", "left").select(F.col("_id").cast("long").alias("_id"), "_t", "found")
    kinds = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * with_text
    return out.mapInArrow(_cut(length, with_text), kinds).withColumnRenamed("_id", id_col)
