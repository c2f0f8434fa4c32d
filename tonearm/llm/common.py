"""Shared pieces of the text operators: row keys, byte blocks, hashing, winnowing.

Texts reach Python as Arrow columns, and all per-byte and per-word work is numpy
on their buffers, in blocks of about ``BLOCK`` bytes, so a task's memory does not
depend on the length of a text or on the number of rows.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.storage import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])
BLOCK = 1 << 20
POSITION_BITS = 24

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Arrow batches of texts are cut by bytes as well as by rows.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", "8388608"),
}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package; bound Arrow batches left at Spark's defaults."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    for name, (default, ours) in BATCH_CONF.items():
        if spark.conf.get(name, default).rstrip("bB") in (default, "256m"):
            spark.conf.set(name, ours)


def trim() -> None:
    """Give free memory of a reused Python worker back, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frees(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back when its task is done: Spark reuses the workers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


@contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of each query when the query ends; the caller's setting comes back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written as a table in the shared checkpoint folder and read back; the table goes with the context."""
    spark = df.sparkSession
    shared_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    path = f"{sc.getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    try:
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, which: str = "true", total: int | None = None, parts: int = 4096, least: int = 256) -> DataFrame:
    """``left`` joined with the ``which`` rows of ``right``, which has a row for each key and ``c``, how many rows of ``left`` the key has.

    A key with more than a ``parts``-th of all rows is dealt to several tasks by ``by``; there are at most ``parts`` such keys, and
    only they are broadcast, so neither that table nor a task's share of a key grows with the data's skew.  ``total`` is the sum of ``c``
    or more; it is counted if not given, which a stored table bears.
    """
    total = (right.agg(F.sum("c")).first()[0] or 0) if total is None else total
    most = max(least, total // parts)
    right = right.where(which)
    pieces = F.ceil(F.col("c") / most).cast("int")
    hot = right.where(F.col("c") > most).select(*keys, pieces.alias("_pieces"))
    dealt = left.join(F.broadcast(hot), keys, "left")  # at most `parts` rows
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(by, F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    copies = right.withColumn("_salt", F.explode(F.when(F.col("c") > most, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")


def sampled(rows: DataFrame, most: int, size: int) -> list[Row]:
    """The rows (_h, _t, ...) with the smallest hashes ``_h``, one for each: at most ``most`` of them with at most ``size`` bytes of texts ``_t`` (or one)."""
    lengths = rows.groupBy("_h").agg(F.min(F.octet_length("_t")).alias("n")).orderBy("_h").limit(most)
    before = F.sum("n").over(Window.orderBy("_h")) - F.col("n")  # over at most `most` hashes
    upto = lengths.withColumn("before", before).where((F.col("before") + F.col("n") <= size) | (F.col("before") == 0)).agg(F.max("_h")).first()[0]
    return [] if upto is None else list(rows.where(F.col("_h") <= F.lit(upto)).dropDuplicates(["_h"]).toLocalIterator())


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files give fewer splits than there are cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_key(*columns: Column) -> Column:
    """64-bit key of a row; nulls and equal rows have defined keys."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns])


def second_key(*columns: Column) -> Column:
    """Another 64 bits, for what must not confuse two of very many rows."""
    return F.xxhash64(F.lit("second"), *[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """(_k, _id, _t), with ``wide`` also _k2: only what the operators read, under names of our own; a null text is empty."""
    return docs.select(
        row_key(docs[id_col], docs[text_col]).alias("_k"),
        docs[id_col].alias("_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("_t"),
        *[second_key(docs[id_col], docs[text_col]).alias("_k2")] * wide,
    )


# --- hashing -----------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        for i, b in enumerate((BASE, INVERSE)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            _POWERS[i] = np.cumprod(run, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of a sequence of 64-bit values, one more than its length."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each [start, end) of the sequence behind ``sums``."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """span_hash of every run of n."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(sums))
    return mix((sums[n:] - sums[:count]) * down[:count] + np.uint64(n))


# --- texts as bytes and as words ------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Block:
    """Consecutive texts, or a piece of one text longer than a block."""

    rows: np.ndarray  # row of each piece
    base: np.ndarray  # where the piece begins in its text
    data: np.ndarray
    offsets: np.ndarray


def byte_blocks(column: pa.Array, overlap: int, limit: int = BLOCK) -> Iterator[Block]:
    """Pieces of one text overlap by ``overlap`` bytes."""
    data, off = text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        if off[hi] - off[lo] <= limit:
            yield Block(np.arange(lo, hi), np.zeros(hi - lo, np.int64), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        else:
            at, end = int(off[lo]), int(off[hi])
            while True:
                stop = min(end, at + limit)
                yield Block(np.array([lo]), np.array([at - int(off[lo])]), data[at:stop], np.array([0, stop - at]))
                if stop == end:
                    break
                at = stop - overlap
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and n + 1 word offsets of its texts."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, 64-bit hashes of their words, word offsets of their texts); whole texts."""
    data, off = text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if len(part) <= limit:
            hashes, woff = _hash_words(part, at, lower)
        else:  # one long text, cut at white space
            pieces, i = [], 0
            while i < len(part):
                j = min(len(part), i + limit)
                while j < len(part):
                    gaps = np.flatnonzero(SPACE[part[j : j + limit]])
                    if len(gaps):
                        j += int(gaps[0])
                        break
                    j = min(len(part), j + limit)
                pieces.append(_hash_words(part[i:j], np.array([0, j - i]), lower)[0])
                i = j
            hashes = np.concatenate(pieces)
            woff = np.array([0, len(hashes)])
        yield lo, hi, hashes, woff
        lo = hi


def _hash_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, woff = word_bounds(data, off)
    sums = prefix_sums(BYTE_VALUES[LOWER[data] if lower else data])
    return span_hash(sums, starts, ends), woff


# --- winnowing ------------------------------------------------------------------


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w neighbours of x, the position of the smallest, the first if several.

    The order compares the high bits only, so equal windows choose the same place.
    """
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(x) >= 1 << POSITION_BITS:
        raise ValueError("a block is longer than its positions can tell")
    low = np.uint64((1 << POSITION_BITS) - 1)
    m = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[:n], m[w - span : w - span + n])
    return (m[:n] & low).astype(np.int64)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals [start, end); touching ones join."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])]
