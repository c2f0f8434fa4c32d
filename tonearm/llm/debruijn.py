"""Word-level substring dedup on a compacted de Bruijn graph.

Nodes are runs of ``size - 1`` consecutive words, and an edge, a window of ``size`` words, is a pair of nodes that follow
each other.

1. Each node goes to the bucket of its minimiser (the smallest hash among its ``gram``-word pieces), as part of a run of
   neighbouring nodes with one minimiser, together with the node before and the node behind.  A bucket therefore holds every
   edge of each of its nodes, so degrees are exact; minimisers of a single text need no further work.
2. A node with one edge in and one out, in all texts, doesn't branch (a text's first and last node do).  All texts that
   hold an edge of a nonbranching path hold the whole path, so a path has one first source: the place in the smallest document.
   Minimisers of very many texts take the same steps through aggregations over nodes, in any number of tasks.
3. Paths of neighbouring buckets share an edge.  A Spark shuffle brings those of one text and one source together, and the
   ones that meet at the same distance from their source become one span.
4. The words of each span are compared with those at its source.  Where they differ (two nodes had the same hash), the span's
   windows are looked up by their words among all texts, so no repeat is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 13
GRAM = 6
#: A bucket with more runs than this is settled by aggregations over its nodes instead of within one group.
GROUP_LIMIT = 40_000
LAST = 2**63 - 1

#: ``nodes`` are 64-bit hashes, the first at node ``s`` of the text; ``lead`` and ``trail``: is the first, the last one another run's?
RUN = "h long, hot boolean, _k long, _o long, s long, lead boolean, trail boolean, nodes binary"
PATH = "dk long, start long, n long, sk long, source long"
ALL_BITS = 2**64 - 1


def _runs(column: pa.Array, size: int, gram: int, bits: int = ALL_BITS, limit: int = 1 << 22):
    """(nodes' hashes, first and end of each run of nodes with one minimiser, its text, its first node's place, its minimiser's hash, more nodes before?, behind?)."""
    for lo, hi, words, off in C.word_blocks(column):
        total = np.diff(off) - size + 2  # nodes of each text; a text without an edge has no use
        total[total < 2] = 0
        if not total.any():
            continue
        alone = hi - lo == 1
        for a in range(0, int(total[0]), limit) if alone else (0,):
            # a long text in stretches, each with a node more at either side
            skip = max(0, a - 1) if alone else 0
            b = min(a + limit, int(total[0])) if alone else 0
            part = words[skip : min(b + 1, int(total[0])) + size - 2] if alone else words
            at = np.array([0, len(part)]) if alone else off
            counts = np.diff(at) - size + 2
            counts[total == 0] = 0
            sums = C.prefix_sums(part)
            grams = C.gram_hashes(sums, gram)
            text = np.repeat(np.arange(len(counts)), counts)
            inner = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
            start = at[text] + inner
            nodes = C.gram_hashes(sums, size - 1)[start] & np.uint64(bits)
            least = C.window_minima(grams, size - gram)[start]
            place = inner + skip
            mine = np.flatnonzero((place >= a) & (place < b)) if alone else np.arange(len(place))
            first = C.run_starts(text[mine], least[mine])
            begin, end = mine[first], mine[np.append(first[1:], len(mine)) - 1] + 1
            yield nodes, begin, end, lo + text[begin], place[begin], grams[least[begin]], place[begin] > 0, place[end - 1] < total[text[begin]] - 1


def _minimisers(size: int, gram: int):
    """Each text's minimisers, and of how many of its runs."""
    schema = pa.schema([("h", pa.int64()), ("_k", pa.int64()), ("r", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            for _, _, _, row, _, h, _, _ in _runs(batch.column("_t"), size, gram):
                order = np.lexsort((h, row))
                first = C.run_starts(row[order], h[order])
                once = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(keys[row[once]]), pa.array(np.diff(np.append(first, len(row))).astype(np.int32))], schema=schema)

    return C.frees(run)


def _wanted_runs(size: int, gram: int, bits: int):
    schema = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("_k", pa.int64()), ("_o", pa.int64()), ("s", pa.int64()), ("lead", pa.bool_()), ("trail", pa.bool_()), ("nodes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, order = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_o"))
            sets = []
            for name in ("wanted", "hot"):
                data, off = batch.column(name).values.to_numpy(zero_copy_only=False), batch.column(name).offsets.to_numpy()
                sets.append(C.mix(data.view(np.uint64) + C.mix(np.repeat(np.arange(len(keys)), np.diff(off)).astype(np.uint64))))
            for nodes, begin, end, row, place, h, lead, trail in _runs(batch.column("_t"), size, gram, bits):
                mark = C.mix(h + C.mix(row.astype(np.uint64)))
                keep = np.flatnonzero(np.isin(mark, sets[0]))
                if not len(keep):
                    continue
                lead, trail, row = lead[keep], trail[keep], row[keep]
                a, b, raw = begin[keep] - lead, end[keep] + trail, nodes.tobytes()
                blobs = [raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                columns = [h[keep].view(np.int64), np.isin(mark[keep], sets[1]), keys[row], order[row], place[keep] - lead, lead, trail]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], schema=schema)

    return C.frees(run)


def branching(node: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """For each occurrence of a node: has it, in all its occurrences, other than one edge in and one out?  -1 stands for a text's end."""
    by = np.argsort(node, kind="stable")
    first = C.run_starts(node[by])
    once = np.ones(len(first), bool)
    for edge in (before[by], behind[by]):
        low, high = np.minimum.reduceat(edge, first), np.maximum.reduceat(edge, first)
        once &= (low == high) & (low >= 0)
    out = np.empty(len(by), bool)
    out[by] = ~np.repeat(once, np.diff(np.append(first, len(by))))
    return out


def nonbranching_paths(h: np.ndarray, lead: np.ndarray, trail: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first edge, length, first edge of the same path in the first run that holds it) of each run's paths, over whole buckets.

    Runs come ordered by document and place; an edge has its first node's index.
    """
    run = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    last = np.zeros(len(nodes), bool)
    last[ends - 1] = True
    head = np.zeros(len(nodes), bool)
    head[ends - counts] = True
    # an edge's name is the place of its first occurrence, which is its source
    edges = np.flatnonzero(~last)
    pair = C.mix(nodes[edges] + C.mix(nodes[edges + 1]))
    by = np.argsort(pair, kind="stable")
    first = C.run_starts(pair[by])
    name = np.full(len(nodes) + 1, -1, np.int64)
    name[edges[by]] = np.repeat(edges[by[first]], np.diff(np.append(first, len(by))))
    own = np.flatnonzero(~((head & lead[run]) | (last & trail[run])))
    before = np.where(head[own], -1, name[own - 1])
    split = head.copy()
    split[own] |= branching(C.mix(nodes[own] + C.mix(h[run[own]])), before, name[own])
    start = edges[split[edges]]
    length = np.diff(np.append(np.flatnonzero(split[edges]), len(edges)))
    return start, length, name[start]


def _settle(block: int = 1 << 24):
    """Rows come sorted by minimiser; whole buckets at a time, ``block`` bytes of nodes or a bucket's."""
    schema = pa.schema([(c, pa.int64()) for c in ("dk", "start", "n", "sk", "source")])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        number = lambda c: rows.column(c).to_numpy()
        rows = rows.take(pa.array(np.lexsort((number("s"), number("_k"), number("_o"))))).combine_chunks()
        data, off = C.text_buffers(rows.column("nodes"))
        nodes, counts = data.copy().view(np.uint64), np.diff(off) // 8
        at, n, source = nonbranching_paths(number("h").view(np.uint64), number("lead"), number("trail"), nodes, counts)
        run = np.repeat(np.arange(len(counts)), counts)
        place = number("s")[run] + np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        hit = number("_o")[run[source]] < number("_o")[run[at]]
        at, n, source = at[hit], n[hit], source[hit]
        key = number("_k")[run]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], place[at], n, key[source], place[source])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left"))
                if cut:
                    yield settle(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return C.frees(run)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each own node of a run with the nodes before and behind it, null at a text's end."""
    for batch in batches:
        data, off = C.text_buffers(batch.column("nodes"))
        nodes, counts = data.copy().view(np.int64), np.diff(off) // 8
        run = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        head, last = inner == 0, inner == counts[run] - 1
        own = np.flatnonzero(~((head & column("lead")[run]) | (last & column("trail")[run])))
        near = lambda at, none: pa.array(nodes[np.clip(at, 0, len(nodes) - 1)], mask=none)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [pa.array(column("h")[run[own]]), pa.array(nodes[own]), near(own - 1, head[own]), near(own + 1, last[own]), pa.array(column("_o")[run[own]]), pa.array(column("_k")[run[own]]), pa.array((column("s")[run] + inner)[own])],
            names=["h", "node", "prev", "next", "_o", "_k", "at"],
        )


def _hot_paths(runs: DataFrame) -> DataFrame:
    """The paths of large buckets: degrees and first sources by aggregation, given back to the occurrences through salted joins."""
    occurrences = runs.mapInArrow(_occurrences, "h long, node long, prev long, next long, _o long, _k long, at long")
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    first = F.min(F.struct("_o", "_k", "at")).alias("first")
    degrees = occurrences.groupBy("h", "node").agg((one("prev") & one("next")).alias("through"), first, F.count(F.lit(1)).alias("c"))
    with C.stored(degrees) as known, C.stored(C.salted_join(occurrences, known, ["h", "node"], F.xxhash64("_k", "at"))) as seen:
        path = lambda start, n, source: (F.col("_k").alias("dk"), F.col(start).alias("start"), F.lit(n).cast("long").alias("n"), F.col("first._k").alias("sk"), F.col(source).alias("source"))
        through = seen.where("through and first._o < _o").withColumns({"s": F.col("at") - 1, "f": F.col("first.at") - 1}).select(*path("s", 2, "f"))
        # the edges of a branching node, one by one
        ends = F.explode(F.array(F.struct(F.col("prev").alias("p"), F.col("node").alias("q"), (F.col("at") - 1).alias("s")), F.struct(F.col("node").alias("p"), F.col("next").alias("q"), F.col("at").alias("s"))))
        edges = seen.where("not through").select("_o", "_k", ends.alias("e")).select("_o", "_k", "e.*").where("p is not null and q is not null").withColumnRenamed("s", "at")
        with C.stored(edges.groupBy("p", "q").agg(first, F.count(F.lit(1)).alias("c"))) as named:
            alone = C.salted_join(edges, named, ["p", "q"], F.xxhash64("_k", "at")).where("first._o < _o").select(*path("at", 1, "first.at"))
            with C.stored(through.unionByName(alone)) as out:
                return out.checkpoint()


def _digests(size: int, each: bool = False):
    """For each asked-for (place, edges) of a text, a digest of the words there; with ``each``, one of every window."""
    schema = pa.schema([("k", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffers(batch.column("_t"))
            keys, out = batch.column("_k").to_pylist(), []
            for i, asked in enumerate(batch.column("asked")):
                part = data[off[i] : off[i + 1]]
                starts, ends, _ = C.word_bounds(part, np.array([0, len(part)]))
                raw, starts, ends = part.tobytes(), starts.tolist(), ends.tolist()
                for x in asked.as_py():
                    for a, n in ((j, 1) for j in range(x["at"], x["at"] + x["n"])) if each else ((x["at"], x["n"]),):
                        body = b" ".join([raw[s:e] for s, e in zip(starts[a : a + n + size - 1], ends[a : a + n + size - 1], strict=True)])
                        out.append((keys[i], a, n, hashlib.md5(body).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _every_window(size: int):
    """(digest, _o) of all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffers(batch.column("_t"))
            for i, o in enumerate(batch.column("_o").to_pylist()):
                words = data[off[i] : off[i + 1]].tobytes().translate(bytes.maketrans(b"\t\n\v\f\r", b" " * 5)).split(b" ")
                words = [w for w in words if w]
                seen = {hashlib.md5(b" ".join(words[j : j + size])).digest() for j in range(len(words) - size + 1)}
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([o] * len(seen), pa.int64())], names=["digest", "_o"])

    return run


def _cut(size: int, with_text: bool):
    schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))] + [("kept", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffers(batch.column("_t"))
            out = []
            for i, found in enumerate(batch.column("found")):
                part = data[off[i] : off[i + 1]]
                starts, ends, _ = C.word_bounds(part, np.array([0, len(part)]))
                runs = found.as_py() or []
                s = np.array([x["start"] for x in runs], np.int64)
                s, e = C.union_length(s, s + np.array([x["n"] for x in runs], np.int64) + size - 1) if runs else (s, s)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, s, 1)
                np.add.at(gone, e, -1)
                keep = np.cumsum(gone[:-1]) == 0
                raw = part.tobytes()
                kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                out.append([len(starts), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), np.stack([s, e], 1).ravel().tolist()] + [kept.decode()] * with_text)
            if out:
                columns = [batch.column("_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return C.frees(run)


def joined(paths: DataFrame) -> DataFrame:
    """Paths of one text that overlap or touch, and whose sources do so at the same distance, as one span."""
    delta, end = F.col("start") - F.col("source"), F.col("start") + F.col("n")
    w = Window.partitionBy("dk", "sk", "delta").orderBy("start", "end")
    rows = paths.select("dk", "sk", delta.alias("delta"), "start", end.alias("end"))
    behind = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") <= behind, 0).otherwise(1))
    spans = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("dk", "sk", "delta", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("dk", "start", (F.col("end") - F.col("start")).alias("n"), "sk", (F.col("start") - F.col("delta")).alias("source"))


def _paths(rows: DataFrame, size: int, gram: int, group_limit: int, bits: int) -> DataFrame:
    """(dk, start, n, sk, source): paths of each bucket that repeat an earlier document."""
    order = F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("_o")
    minimisers = rows.select("_k", "_t").mapInArrow(_minimisers(size, gram), "h long, _k long, r int")
    with ExitStack() as later:
        with C.stored(minimisers) as least, C.stored(least.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("r").alias("r")).where("c > 1")) as counted:
            repeated = C.salted_join(least.select("h", "_k"), counted, ["h"], F.xxhash64("_k"))
            hot = F.when(F.col("r") > group_limit, F.col("h"))
            wanted = later.enter_context(C.stored(repeated.groupBy("_k").agg(F.collect_set("h").alias("wanted"), F.collect_set(hot).alias("hot"))))
        found = rows.join(wanted, "_k").select("_k", order, "_t", "wanted", "hot").mapInArrow(_wanted_runs(size, gram, bits), RUN)
        runs = later.enter_context(C.stored(found))
        cold = runs.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(_settle(), PATH)
        if runs.where("hot").isEmpty():
            return joined(cold).checkpoint()
        return joined(cold.unionByName(_hot_paths(runs.where("hot")))).checkpoint()


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, group_limit: int = GROUP_LIMIT, with_text: bool = False, bits: int = ALL_BITS) -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts in a document with a smaller id.

    Returns a row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space), spans
    (first word, end, ...) and, if ``with_text``, the kept words.  A null text has no words; rows with the same id do not
    count against each other; a null id comes after all others, and such rows do not count against each other; an empty
    table gives an empty result; other columns are ignored.  Ids must be whole numbers or cast to them.  ``bits`` masks the
    nodes' hashes; it changes no result, and tests use it to make hashes collide.
    """
    C.prepare(docs.sparkSession)
    rows = C.keyed(docs, id_col, text_col)
    with C.cleanup(docs.sparkSession):
        spans = _paths(rows, size, gram, group_limit, bits)
        ends = spans.select(F.col("dk").alias("k"), F.col("start").alias("at"), "n").unionByName(spans.select(F.col("sk").alias("k"), F.col("source").alias("at"), "n"))
        asked = ends.groupBy(F.col("k").alias("_k")).agg(F.collect_set(F.struct("at", "n")).alias("asked"))
        digests = lambda wanted, each: rows.join(wanted, "_k").select("_k", "_t", "asked").mapInArrow(_digests(size, each), "k long, at long, n long, digest binary").distinct()
        with C.stored(digests(asked, False)) as seen:
            mine = seen.select(F.col("k").alias("dk"), F.col("at").alias("start"), "n", F.col("digest").alias("a"))
            theirs = seen.select(F.col("k").alias("sk"), F.col("at").alias("source"), "n", F.col("digest").alias("b"))
            compared = spans.join(mine, ["dk", "start", "n"]).join(theirs, ["sk", "source", "n"]).select("dk", "start", "n", (F.col("a") == F.col("b")).alias("same")).checkpoint()
        same = compared.where("same")
        wrong = compared.where("not same")
        if not wrong.isEmpty():
            again = wrong.groupBy(F.col("dk").alias("_k")).agg(F.collect_set(F.struct(F.col("start").alias("at"), "n")).alias("asked"))
            order = F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("_o")
            held = digests(again, True).join(rows.select(F.col("_k").alias("k"), order).distinct(), "k")
            first = rows.select(order, "_t").mapInArrow(_every_window(size), "digest binary, _o long").groupBy("digest").agg(F.min("_o").alias("first"))
            same = same.unionByName(held.join(first, "digest").where("first < _o").select(F.col("k").alias("dk"), F.col("at").alias("start"), "n", F.lit(True).alias("same")).checkpoint())
    found = same.groupBy(F.col("dk").alias("_k")).agg(F.collect_list(F.struct("start", "n")).alias("found"))
    out = rows.join(found, "_k", "left").select(F.col("_id").cast("long").alias("_id"), "_t", "found")
    kinds = "_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>" + ", kept string" * with_text
    return out.mapInArrow(_cut(size, with_text), kinds).withColumnRenamed("_id", id_col)
