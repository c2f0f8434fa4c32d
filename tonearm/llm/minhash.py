"""MinHash near-dedup with exact links.

1. Each text becomes its set of word shingles; equal sets are one class.
2. ``HASHES`` universal (multiply-shift) hash minima per class, cut into ``BANDS`` bands; classes that
   share a band are candidates.  In each bucket a breadth-first search over signatures (the
   frontier against what is not yet reached) gives a spanning forest of the pairs that may
   reach the threshold, so what is emitted grows with the bucket and not with its square.
3. Large-star/small-star joins these links into candidate components, which every
   link lies within.
4. Within a candidate component the same search over the full sets (64-bit hashes of the shingles) finds the
   links that hold, and large-star/small-star gives the components.

Buckets and candidate components beyond a size are searched by pairs of blocks, which
covers all their pairs in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 4
PERCENT = 80
HASHES, BANDS = 128, 32
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 21

_r = np.random.Generator(np.random.PCG64(9))
FACTORS = _r.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
TERMS = _r.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, sorted distinct shingles of each text, their offsets)."""
    for lo, hi, words, off in C.word_blocks(column, lower=True):
        sums, counts = C.prefix_sums(words), np.diff(off)
        n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        text = np.repeat(np.arange(len(n)), n)
        start = off[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
        all_shingles = C.span_hash(sums, start, start + np.minimum(size, counts[text]))
        order = np.lexsort((all_shingles, text)) if hi - lo > 1 else np.argsort(all_shingles, kind="stable")
        text, all_shingles = text[order], all_shingles[order]
        once = C.run_starts(text, all_shingles)
        yield lo, hi, all_shingles[once], np.searchsorted(text[once], np.arange(hi - lo + 1))


def signatures(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima, 0 for an empty set."""
    out = np.zeros((len(off) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        for i in range(HASHES):
            values = ((shingles * FACTORS[i] + TERMS[i]) >> np.uint64(32)).astype(np.uint32)
            out[some, i] = np.minimum.reduceat(values, off[some])
    return out


def _features(size: int):
    schema = pa.schema([("_k", pa.int64()), ("_k2", pa.int64()), ("_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("bands", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shingles, off in shingle_sets(batch.column("_t"), size):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(C.mix(shingles ^ np.uint64(c)), dtype=np.uint64)]) for c in (0, 0x5DEECE66D)]
                s1, s2 = ((x[off[1:]] - x[off[:-1]]).view(np.int64) for x in sums)
                sig = signatures(shingles, off)
                rows = sig.reshape(hi - lo, BANDS, HASHES // BANDS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (hi - lo, BANDS))
                for j in range(HASHES // BANDS):
                    key = C.mix(key * C.BASE + rows[:, :, j])
                low = (C.mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_k"), part.column("_k2"), part.column("_id"), pa.array(np.diff(off)), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in key], pa.binary())],
                    schema=schema,
                )

    return C.frees(run)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = C.text_buffers(batch.column("bands"))
        per = np.diff(off) // 8
        yield pa.RecordBatch.from_arrays([pa.array(data.copy().view(np.int64)), pa.array(np.repeat(batch.column("of").to_numpy(zero_copy_only=False), per))], names=["band", "of"])


def pair_blocks(key: int, member: int, blocks: int) -> list[int]:
    """Keys of the pairs of blocks that a member belongs to; one key if there is one block."""
    if blocks <= 1:
        return [key]
    mine = int(C.mix(np.array([member & 2**64 - 1], np.uint64))[0] % np.uint64(blocks))
    pairs = np.array([min(mine, x) * blocks + max(mine, x) for x in range(blocks)], np.uint64)
    return C.mix(pairs + C.mix(np.array([key & 2**64 - 1], np.uint64))).view(np.int64).tolist()


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, or pair of blocks of a large bucket, that a class belongs to."""
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for c, n, sig, buckets in zip(*(batch.column(x).to_pylist() for x in ("c", "n", "sig", "buckets")), strict=True):
            for b in buckets:
                for g in pair_blocks(b["band"], c, b["blocks"]):
                    for column, x in zip(out, (g, c, n, sig), strict=True):
                        column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def spanning_forest(size: int, links: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Breadth first; ``links(i, rest)`` says which of ``rest`` are linked with i."""
    rest = np.arange(size)
    frontier: list[int] = []
    while len(rest) or frontier:
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
        i = frontier.pop()
        if len(rest):
            hit = links(i, rest)
            for j in rest[hit].tolist():
                yield i, j
                frontier.append(j)
            rest = rest[~hit]


def _grouped(settle: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]], block: int):
    """Rows sorted by g; ``settle`` gets whole groups and the bounds of each."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        g = rows.column("g").to_numpy()
        edges = settle(rows, np.append(C.run_starts(g), len(g)))
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block:
                rows = pa.Table.from_batches(held).combine_chunks()
                g = rows.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1], "left"))
                if cut:
                    yield emit(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks())
        held = []
        C.trim()

    return run


def _by_signature(percent: int):
    # A pair at the threshold agrees in HASHES * percent / 100 places on average; five standard deviations below that.
    p = percent / 100
    least = int(HASHES * p - 5.2 * (HASHES * p * (1 - p)) ** 0.5)

    def settle(rows: pa.Table, bounds: np.ndarray) -> list[tuple[int, int]]:
        c, n = (rows.column(x).to_numpy() for x in ("c", "n"))
        sig = C.text_buffers(rows.column("sig"))[0].reshape(-1, HASHES)
        lo, sizes = bounds[:-1], np.diff(bounds)
        two = lo[sizes == 2]
        fit = (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])) & ((sig[two] == sig[two + 1]).sum(1) >= least)
        out = list(zip(c[two[fit]].tolist(), c[two[fit] + 1].tolist(), strict=True))
        for a, b in zip(lo[sizes > 2].tolist(), (lo + sizes)[sizes > 2].tolist(), strict=True):
            s, m, ids = sig[a:b], n[a:b], c[a:b]

            def links(i: int, rest: np.ndarray, s=s, m=m) -> np.ndarray:
                near = 100 * np.minimum(m[i], m[rest]) >= percent * np.maximum(m[i], m[rest])
                near[near] = (s[rest[near]] == s[i]).sum(1) >= least
                return near

            out += [(int(ids[i]), int(ids[j])) for i, j in spanning_forest(b - a, links)]
        return out

    return settle


def _by_sets(percent: int):
    def settle(rows: pa.Table, bounds: np.ndarray) -> list[tuple[int, int]]:
        c, out = rows.column("c").to_numpy(), []
        data, off = C.text_buffers(rows.column("shingles"))
        values, off = data.copy().view(np.uint64), off // 8
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            at = off[a : b + 1] - off[a]
            names, dense = np.unique(values[off[a] : off[b]], return_inverse=True)
            size, here = np.diff(at), np.zeros(len(names), bool)

            def links(i: int, rest: np.ndarray, at=at, size=size, dense=dense, here=here) -> np.ndarray:
                near = 100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])
                some = rest[near]
                if len(some):
                    here[dense[at[i] : at[i + 1]]] = True
                    picked = np.repeat(at[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(int(size[some].sum()))
                    both = np.add.reduceat(here[dense[picked]].astype(np.int64), np.cumsum(size[some]) - size[some])
                    here[dense[at[i] : at[i + 1]]] = False
                    near[near] = 100 * both >= percent * (size[i] + size[some] - both)
                return near

            out += [(int(c[a + i]), int(c[a + j])) for i, j in spanning_forest(b - a, links)]
        return out

    return settle


def _set_rows(size: int):
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, groups, blocks = (batch.column(x).to_pylist() for x in ("_k", "component", "blocks"))
            for lo, hi, shingles, off in shingle_sets(batch.column("_t"), size):
                out: list[list] = [[], [], []]
                for i in range(lo, hi):
                    body = shingles[off[i - lo] : off[i - lo + 1]].tobytes()
                    for g in pair_blocks(groups[i], keys[i], blocks[i]):
                        for column, x in zip(out, (g, keys[i], body), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return C.frees(run)


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(_k, _id, n, component, component_id) of every row; component is null for a row without shingles."""
    spark = docs.sparkSession
    C.prepare(spark)
    C.shared_dir(spark)
    rows = C.keyed(docs, id_col, text_col, wide=True).withColumn("_id", F.col("_id").cast("long"))
    with C.cleanup(spark):
        all_rows = rows.mapInArrow(_features(shingle), "_k long, _k2 long, _id long, n long, s1 long, s2 long, sig binary, bands binary").checkpoint()
        sets = all_rows.where("n > 0")
        classes = sets.groupBy("s1", "s2", "n").agg(F.min("_k").alias("c"), F.min("_id").alias("least"), F.min("sig").alias("sig"), F.min("bands").alias("bands")).checkpoint()

        bands = classes.select("bands", F.col("c").alias("of")).mapInArrow(_band_rows, "band long, of long")
        shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = shared.select("band", "c", F.when(F.col("c") > 2 * BLOCK_ROWS, F.ceil(F.col("c") / BLOCK_ROWS)).otherwise(1).cast("int").alias("blocks"))
        buckets = C.salted_join(bands, shared, ["band"], F.xxhash64("of"), total=BANDS * classes.count()).groupBy(F.col("of").alias("c")).agg(F.collect_list(F.struct("band", "blocks")).alias("buckets"))
        members = classes.select("c", "n", "sig").join(buckets, "c").mapInArrow(_bucket_rows, "g long, c long, n long, sig binary")
        maybe = members.repartition("g").sortWithinPartitions("g").mapInArrow(_grouped(_by_signature(percent), 8 << 20), "u long, v long")

        groups = components(maybe).withColumnsRenamed({"node": "c"}).join(classes.select("c", "n"), "c")
        sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
        most = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("t") / BLOCK_SHINGLES))
        sizes = sizes.select("component", F.when(most > 2, most).otherwise(1).cast("int").alias("blocks"))
        asked = groups.join(sizes, "component").select(F.col("c").alias("_k"), "component", "blocks")
        texts = rows.select("_k", "_t").join(asked, "_k").mapInArrow(_set_rows(shingle), "g long, c long, shingles binary")
        links = texts.repartition("g").sortWithinPartitions("g").mapInArrow(_grouped(_by_sets(percent), 8 << 20), "u long, v long")
        found = components(links).withColumnsRenamed({"node": "c"})
    named = classes.select("s1", "s2", "n", "c", "least").join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(names, "component").select("s1", "s2", "n", "component", "component_id")
    return all_rows.select("_k", "_k2", "_id", "n", "s1", "s2").join(labels, ["s1", "s2", "n"], "left").select("_k", "_k2", "_id", "n", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept (it is its own component's id).

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle``-word shingles; a text with fewer
    words is one shingle, and one without words (or null) has none and is linked with nothing.  A row per row; repeated rows are
    linked; a null id counts as after all others; an empty table gives an empty result; other columns are ignored.
    """
    out = _labelled(docs, id_col, text_col, shingle, percent)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component (that with the smallest id) and every row without words once."""
    rows = _labelled(docs, id_col, text_col, shingle, percent)
    first = rows.groupBy(F.coalesce("component", "_k").alias("component"), F.when(F.col("component").isNull(), F.col("_k2")).alias("other")).agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_k", "_k2")).alias("x"))
    chosen = first.select(F.col("x._k").alias("__row_key"), F.col("x._k2").alias("__row_key_2"))
    named = docs.withColumns({"__row_key": C.row_key(docs[id_col], docs[text_col]), "__row_key_2": C.second_key(docs[id_col], docs[text_col])})
    return named.join(chosen, ["__row_key", "__row_key_2"], "left_semi").dropDuplicates(["__row_key", "__row_key_2"]).select(*docs.columns)
