"""Benchmark decontamination by template canonicalisation.

Texts become sequences of typed tokens: numbers, names (capitalised inside a sentence) and units
(a unit word after a number) are placeholders, everything else is its lower-case word.
Windows of ``size`` template tokens are hash-joined with those of the benchmark
items, as they are and with each run of names, and each number with its unit, as one slot.
A text holds an item if, at one alignment or over a band of near ones, enough of the item's windows
match and the slots are consistent: each value in the item's slots stands
for one value in the text's, and the other way round.  So an item with other numbers and names is found too.
In a band the windows round an edit count as well if the windows at both sides of it match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 8
LITERALS = 4
COVERAGE = 0.5
CONSISTENT = 0.8
#: Size of the bitmap that tells executors which windows may be an item's (8 MB, whatever the benchmark's size); a join decides.
BITMAP = 1 << 26

# Unit words, as they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons cup cups pint pints "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph dollar dollars cent cents euro euros percent degrees "
    "w kw kwh v volts watts hz khz mhz kb mb gb tb"
).split()

#: Forms of a template; their windows never meet.
RAW, COLLAPSED, EXACT = range(3)
SALTS = (np.uint64(0), np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F))
#: What an item is told apart by: its form, and for the first two also whether its capitalised first word is a name, as it is inside a sentence.
FIRST_NAME = 3

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?:\n|"]] = True


def _hash_word(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return C.span_hash(C.prefix_sums(C.BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0]


UNIT_HASHES = np.sort(np.array([_hash_word(x) for x in UNITS], np.uint64))


def template(data: np.ndarray, off: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template tokens, the values in their places, token offsets of the texts).  A number may hold points and commas between digits.

    ``inside``: the texts are taken to begin inside a sentence, so a capital there makes a name.
    """
    word = _WORD[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inner = np.flatnonzero(((data[1:-1] == 44) | (data[1:-1] == 46)) & digit[:-2] & digit[2:]) + 1
        word[inner] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    values = C.span_hash(C.prefix_sums(C.BYTE_VALUES[C.LOWER[data]]), starts, ends)
    number = _DIGIT[data[starts]]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    first = np.ones(len(starts), bool)
    first[1:] = stops[starts[1:]] > stops[ends[:-1]]
    woff = np.searchsorted(starts, off)
    first[woff[:-1][woff[:-1] < len(starts)]] = not inside
    same = np.ones(len(starts), bool)
    same[woff[:-1][woff[:-1] < len(starts)]] = False
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~first[1:] & same[1:] & (UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, values[1:]), len(UNIT_HASHES) - 1)] == values[1:])
    tokens = np.where(number, NUMBER, np.where(unit, UNIT, np.where(capital & ~first, NAME, values)))
    return tokens, values, woff


def _template_blocks(column: pa.Array, inside: bool = False):
    """Whole texts; (first row, tokens, values, token offsets)."""
    data, off = C.text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + C.BLOCK, "right")) - 1)
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if hi == lo + 1 and len(part) > 4 * C.BLOCK:  # one long text, cut at white space
            cuts = [0]
            while cuts[-1] < len(part):
                j = min(len(part), cuts[-1] + C.BLOCK)
                gap = np.flatnonzero(C.SPACE[part[cuts[-1] + 1 : j]])
                cuts.append(j if j == len(part) or not len(gap) else cuts[-1] + 1 + int(gap[-1]))
            parts = [template(part[a:b], np.array([0, b - a]), inside and not a)[:2] for a, b in zip(cuts, cuts[1:])]
            tokens, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield lo, tokens, values, np.array([0, len(tokens)])
        else:
            yield (lo, *template(part, at, inside))
        lo = hi


def _collapsed(tokens: np.ndarray, values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A template with each run of names, and each number with its unit, as one token."""
    if not len(tokens):
        return tokens, values, off
    begin = np.ones(len(tokens), bool)
    begin[1:] = (tokens[1:] != UNIT) & ((tokens[1:] != NAME) | (tokens[:-1] != NAME))
    begin[off[:-1][off[:-1] < len(tokens)]] = True
    at = np.flatnonzero(begin)
    return tokens[at], C.span_hash(C.prefix_sums(C.mix(values)), at, np.append(at[1:], len(tokens))), np.searchsorted(at, off)


SCHEMA = pa.schema([("_k", pa.int64()), ("form", pa.int32()), ("w", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.int64()))])
KIND = "_k long, form int, w long, at int, slots array<long>"


def _starts(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first token) of every window."""
    counts = np.maximum(0, np.diff(off) - size + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, off[text] + np.arange(len(text)) - (np.cumsum(counts) - counts)[text]


def _literal(tokens: np.ndarray, start: np.ndarray, size: int, literals: int) -> np.ndarray:
    """Which windows have enough literal tokens."""
    slots = np.concatenate([[0], np.cumsum((tokens == NUMBER) | (tokens == NAME) | (tokens == UNIT))])
    return size - (slots[start + size] - slots[start]) >= literals


def _batch(keys, form: int, hashes: np.ndarray, at: np.ndarray, slots: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(np.full(len(at), form, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))], schema=SCHEMA
    )


def _among(hashes: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which windows may be an item's: those whose bit is set."""
    if known is None:
        return np.ones(len(hashes), bool)
    at = hashes & np.uint64(64 * len(known) - 1)
    return (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(windows: DataFrame, size: int) -> np.ndarray:
    """A bit for each window hash, made by Spark in words of 64 bits; at most ``size / 64`` words come to the driver."""
    at = F.col("w").bitwiseAND(F.lit(size - 1))
    words = windows.groupBy(F.shiftright(at, 6).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((w & {size - 1}) & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _templates(keys, form: int, name: int, text: tuple, size: int, literals: int, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows with enough literals."""
    tokens, values, off = text
    which, start = _starts(off, size)
    if not len(start):
        return
    hashes = C.gram_hashes(C.prefix_sums(C.mix(tokens)), size)[start] ^ SALTS[form]
    sel = np.flatnonzero(_literal(tokens, start, size, literals) & _among(hashes, known))
    if not len(sel):
        return
    slot = (tokens == NUMBER) | (tokens == NAME) | (tokens == UNIT)
    slots = np.concatenate([[0], np.cumsum(slot)])
    found, where = values.view(np.int64), np.flatnonzero(slot)
    lists = [found[where[slots[s] : slots[s + size]]].tolist() for s in start[sel].tolist()]
    yield _batch(keys[which[sel]], name, hashes[sel], (start - off[which])[sel], lists)


def _exact(keys, values: np.ndarray, off: np.ndarray, size: int, keep: np.ndarray | None, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of values."""
    which, start = _starts(off, size)
    if not len(start):
        return
    hashes = C.gram_hashes(C.prefix_sums(C.mix(values)), size)[start] ^ SALTS[EXACT]
    sel = np.flatnonzero((True if keep is None else keep) & _among(hashes, known))
    if len(sel):
        yield _batch(keys[which[sel]], EXACT, hashes[sel], (start - off[which])[sel], [[]] * len(sel))


def _windows(size: int, literals: int, known: np.ndarray | None, short: list[int]):
    """Windows of texts: templates in two forms; the values of windows with few literals, and of each run as long as a ``short`` item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            for lo, *text in _template_blocks(batch.column("_t")):
                tokens, values, off = text
                yield from _templates(keys[lo:], RAW, RAW, text, size, literals, known)
                yield from _templates(keys[lo:], COLLAPSED, COLLAPSED, _collapsed(*text), size, literals, known)
                yield from _exact(keys[lo:], values, off, size, ~_literal(tokens, _starts(off, size)[1], size, literals), known)
                for n in short:
                    yield from _exact(keys[lo:], values, off, n, None, known)

    return C.frees(run)


def _item_windows(size: int, literals: int):
    """Windows of items, with the first word as it is and as a name; the values of items without a window with enough literals, whole if shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            for (lo, *text), (_, *inner) in zip(_template_blocks(batch.column("_t")), _template_blocks(batch.column("_t"), True), strict=True):
                tokens, values, off = text
                for name, one in ((0, text), (FIRST_NAME, inner)):
                    yield from _templates(keys[lo:], RAW, name + RAW, one, size, literals, None)
                    yield from _templates(keys[lo:], COLLAPSED, name + COLLAPSED, _collapsed(*one), size, literals, None)
                which, start = _starts(off, size)
                some = np.bincount(which[_literal(inner[0], start, size, literals)], minlength=len(off) - 1) > 0
                yield from _exact(keys[lo:], values, off, size, ~some[which], None)
                lengths = np.diff(off)
                for n in range(1, size):
                    yield from _exact(keys[lo:], values, off, n, (lengths == n)[_starts(off, n)[0]], None)

    return run


def _short(size: int):
    """Lengths of the items that are shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {int(n) for _, *text in _template_blocks(batch.column("_t")) for n in np.diff(text[2]) if 0 < n < size}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["n"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, literals: int = LITERALS, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(_k, item_id, coverage, same_values): the items that each row of ``docs`` (by its row key) holds."""
    spark = docs.sparkSession
    C.prepare(spark)
    items = C.keyed(benchmark, item_col, item_text_col)
    names = items.select("_k", "_id").distinct()
    theirs = items.select("_k", "_t").mapInArrow(_item_windows(size, literals), KIND)
    short = sorted(r[0] for r in items.select("_t").mapInArrow(_short(size), "n int").distinct().collect())  # under size rows
    theirs = theirs.select(F.col("_k").alias("item"), "form", "w", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).distinct()
    theirs = theirs.withColumn("no", F.dense_rank().over(Window.partitionBy("item", "form").orderBy("item_at")))
    totals = theirs.groupBy("item", "form").agg(F.max("no").alias("total"))
    known = bitmap(theirs, BITMAP)
    ours = C.keyed(docs, id_col, text_col).select("_k", "_t").mapInArrow(_windows(size, literals, known, short), KIND).drop("form")
    # lanes of a hit: its alignment, and two bands that overlap, so that alignments that differ by at most ``reach`` share one
    hit = ours.join(theirs.join(totals, ["item", "form"]), "w").withColumn("shift", F.col("at") - F.col("item_at"))
    reach = F.greatest(F.lit(size), F.ceil(F.col("total") / 4)).cast("int")
    band = F.floor(F.col("shift") / reach).cast("int")
    lane = lambda wide, at: F.struct(F.lit(wide).alias("wide"), at.alias("at"))
    hit = hit.withColumn("lane", F.explode(F.array(lane(False, F.col("shift")), lane(True, band), lane(True, band - 1))))
    by = ["_k", "item", "form", "lane"]
    per = hit.groupBy(*by).agg(F.first("total").alias("total"), F.sort_array(F.collect_set(F.struct("item_at", "no"))).alias("p"))
    rest = F.size("p") - 1
    gaps = F.zip_with(F.slice("p", F.lit(1), rest), F.slice("p", F.lit(2), rest), lambda x, y: F.when(y["item_at"] - x["item_at"] <= size + 1, y["no"] - x["no"] - 1).otherwise(0))
    bridged = F.when(F.col("lane.wide"), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    per = per.withColumn("n", F.size("p") + bridged).drop("p")
    slots = hit.select(*by, F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select(*by, "x.item_slots", "x.slots").distinct()
    stands = slots.groupBy(*by, "item_slots").agg(F.count(F.lit(1)).alias("values"), F.max((F.col("item_slots") == F.col("slots")).cast("int")).alias("same"))
    back = slots.groupBy(*by, "slots").agg(F.count(F.lit(1)).alias("values")).groupBy(*by).agg(F.avg((F.col("values") == 1).cast("double")).alias("back"))
    agree = stands.groupBy(*by).agg(F.avg((F.col("values") == 1).cast("double")).alias("there"), F.min("same").alias("same")).join(back, by)
    agree = agree.select(*by, F.least("there", "back").alias("agree"), "same")
    held = per.where(F.col("n") >= coverage * F.col("total")).join(agree, by, "left")
    held = held.where(F.coalesce("agree", F.lit(1.0)) >= consistent)
    best = held.groupBy("_k", "item").agg(F.max(F.col("n") / F.col("total")).alias("coverage"), (F.max(F.coalesce("same", F.lit(1))) == 1).alias("same_values"))
    return best.join(names.withColumnsRenamed({"_k": "item", "_id": "item_id"}), "item").select("_k", "item_id", "coverage", "same_values")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, items (sorted), coverage (of the best item, 0 if none) and reworded (an item with other values) for every row.

    A null text is empty and matches nothing.  An item with fewer than ``size`` tokens is held if the text has all of them in a row, and one
    whose windows all have fewer than ``literals`` literals is matched by its values, so that only copies are found; repeated rows each give a row; empty tables give empty results or no matches; other columns are ignored.
    """
    found = matches(docs, benchmark, id_col, text_col, **options)
    per = found.groupBy("_k").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.min("same_values").alias("same"))
    out = C.keyed(docs, id_col, text_col).select("_k", "_id").join(per, "_k", "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce(~F.col("same"), F.lit(False)).alias("reworded"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item.

    A row with a null or empty text is kept; repeated rows are all kept or all dropped; an empty benchmark drops nothing, an empty table
    stays empty; columns keep their names, types and order, whatever they are called.
    """
    bad = matches(docs, benchmark, id_col, text_col, **options).select("_k").distinct()
    kept = docs.withColumn("__row_key", C.row_key(docs[id_col], docs[text_col])).join(bad.withColumnRenamed("_k", "__row_key"), "__row_key", "left_anti")
    return kept.select(*docs.columns)
