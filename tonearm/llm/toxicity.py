"""Toxicity by a weighted finite-state pattern grammar.

A clause's words become symbols: *insult* (a weighted lexicon of words and word beginnings), *threat*, *target*,
*negation*, *reported speech* or none.  One transducer each marks what a target, a negation and a report reach over
(``SPAN`` words); ``compose`` makes one transducer of them, whose states and arcs are a table.  A clause is read forward by
it, and backward by the target's, as a target may follow.  What comes out are insults and threats with marks: aimed at someone,
denied, or told of someone else.  A mark scales the weight, and a text's score is made of its clauses', not of isolated words.

The insult lexicon's weights are learnt (log-odds of words and word beginnings in labelled texts, with a prior for a
few general words).  So is the logistic map from a text's sums to a probability; it also sees each mark's sum alone, and so
learns what a mark is worth.  Fitting reads at most ``TRAIN_ROWS`` labelled texts of ``TRAIN_BYTES`` in all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: At most so many labelled texts are read to fit (half of each label at most), and so many bytes of them; beyond that those with the smallest hashes.
TRAIN_ROWS = 8000
TRAIN_BYTES = 64 << 20
LEXICON = 4096
LEAST_ODDS = 1.8
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3

# General words of each kind in English, French, German and Spanish.
INSULTS = """idiot moron loser stupid pathetic worthless scum disgusting imbecile dumb trash filth vermin degenerate coward ugly
idiote crétin imbécile débile ordure minable dummkopf trottel abschaum widerlich erbärmlich idiota imbécil estúpido estúpida basura asqueroso""".split()
THREATS = "kill hurt destroy beat stab shoot hang burn murder punish strangle tuer frapper brûler étrangler töten umbringen schlagen erschießen matar golpear quemar estrangular".split()
TARGETS = """you your yours yourself u ur they them their he she him her his these those people women men
tu toi vous votre ton ils elles eux leur du dich dir ihr euch sie ihm ihnen tú vosotros usted ustedes ellos ellas""".split()
NEGATIONS = """not never no neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot
ne pas jamais ni sans non aucun nicht kein keine keinen nie weder noch ohne nunca jamás sin tampoco""".split()
REPORTS = """said says say wrote writes called calls quoted quotes claimed claims reported alleged according
dit disait écrit appelle selon prétend sagt sagte schrieb nannte laut behauptet dijo dice escribió llamó según afirma""".split()

# Symbols of the clause alphabet, and the marks that the transducers put on them.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
AIMED, DENIED, TOLD = 1, 2, 4
#: What a mark multiplies a weight by before anything is learnt.
FACTORS = {AIMED: 1.5, DENIED: 0.4, TOLD: 0.4}
THREAT_WEIGHT, THREAT_ALONE = 3.0, 0.2
SPAN = 12  # words that a target, a negation or a report reaches over

_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(x) for x in ".!?;:\n|()"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), ord("'")]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, prefix hashes, clause number, word offsets of the texts) of letter runs."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    sums = C.prefix_sums(C.BYTE_VALUES[C.LOWER[data]])
    stops = np.cumsum(_CLAUSE[data] | edge[:-1])
    return starts, ends, sums, stops[starts], np.searchsorted(starts, off)


def forms(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of whole words, then of their beginnings of each length."""
    yield np.arange(len(starts)), C.span_hash(sums, starts, ends) ^ np.uint64(0xABCDEF)
    for n in PREFIXES:
        some = np.flatnonzero(ends - starts >= n)
        yield some, C.span_hash(sums, starts[some], starts[some] + n)


def whole(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return C.span_hash(C.prefix_sums(C.BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0] ^ np.uint64(0xABCDEF)


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine on marked symbols: ``step[state, symbol]`` is the next state, ``mark[state, symbol]`` what it adds to the symbol's marks."""

    step: np.ndarray
    mark: np.ndarray

    def read(self, symbols: list[tuple[int, int]]) -> list[int]:
        """Marks of (place, symbol) in rising order of places; the places between are ``OTHER``."""
        state, last, out = 0, None, []
        for place, symbol in symbols:
            for _ in range(min(place - last - 1, SPAN) if last is not None else 0):
                state = int(self.step[state, OTHER])
            out.append(int(self.mark[state, symbol]))
            state, last = int(self.step[state, symbol]), place
        return out


def reaches(symbol: int, mark: int, span: int = SPAN) -> Transducer:
    """Marks the ``span`` words behind each ``symbol``; a state is how many words are left."""
    left = np.arange(span + 1)
    step = np.repeat(np.maximum(left - 1, 0)[:, None], len(SYMBOLS), 1)
    step[:, symbol] = span
    return Transducer(step, np.repeat(np.where(left > 0, mark, 0)[:, None], len(SYMBOLS), 1))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: b reads what a puts out.  A state of the product is a's by b's."""
    m = len(b.step)
    both = lambda x, y, join: join(x[:, None, :], y[None, :, :]).reshape(-1, len(SYMBOLS))
    return Transducer(both(a.step, b.step, lambda i, j: i * m + j), both(a.mark, b.mark, np.bitwise_or))


AIM = reaches(TARGET, AIMED)
CLAUSE = reduce(compose, (AIM, reaches(NEGATION, DENIED), reaches(REPORT, TOLD)))
#: Sums of a text: all weights, scaled by their marks, and those aimed, denied and told alone.
SUMS = ("all", "aimed", "denied", "told")


def clause_sums(symbols: list[tuple[int, int, float]]) -> tuple[float, ...]:
    """``SUMS`` of a clause from its (place, symbol, weight)."""
    forward = CLAUSE.read([(p, s) for p, s, _ in symbols])
    backward = AIM.read([(-p, s) for p, s, _ in reversed(symbols)])[::-1]
    out = [0.0] * len(SUMS)
    for (_, symbol, weight), marks in zip(symbols, map(int.__or__, forward, backward), strict=True):
        if symbol not in (INSULT, THREAT):
            continue
        if symbol == THREAT:  # a threat is one only if it is aimed
            weight, factors = (THREAT_WEIGHT if marks & AIMED else THREAT_ALONE), (DENIED, TOLD)
        else:
            factors = (AIMED, DENIED, TOLD)
        for mark in factors:
            weight *= FACTORS[mark] if marks & mark else 1.0
        out[0] += weight
        for i, mark in enumerate((AIMED, DENIED, TOLD), 1):
            out[i] += weight if marks & mark else 0.0
    return tuple(out)


#: Columns of ``Grammar.features``.
FEATURES = 8


@dataclass
class Grammar:
    keys: np.ndarray  # sorted hashes of lexicon entries
    weights: np.ndarray
    coefficients: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    grammar: bool = True  # without it, words count alone

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text: sum, maximum and number of its clauses' scores, the sum by the length, the length, and the sums aimed, denied and told."""
        starts, ends, sums, clause, woff = words(data, off)
        out = np.zeros((len(off) - 1, FEATURES))
        out[:, 4] = np.log1p(np.diff(woff))
        insult = np.zeros(len(starts))
        symbol = np.zeros(len(starts), np.int8)
        for i, (some, hashes) in enumerate(forms(starts, ends, sums)):
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = self.keys[at] == hashes
                np.maximum.at(insult, some[hit], self.weights[at[hit]])
            if i == 0 and self.grammar:
                for mark, table in FUNCTION_WORDS.items():
                    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                    symbol[some[table[at] == hashes]] = mark
        symbol[(insult > 0) & (symbol == OTHER)] = INSULT  # a function word stays one
        triggers = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
        live = np.flatnonzero((symbol != OTHER) & np.isin(clause, triggers))
        if len(live):
            text = np.searchsorted(woff, live, "right") - 1
            bounds = np.append(C.run_starts(clause[live], text), len(live))
            marks, weights, places = symbol[live].tolist(), insult[live].tolist(), live.tolist()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = clause_sums(list(zip(places[a:b], marks[a:b], weights[a:b], strict=True)))
                row = out[text[a]]
                row[0] += found[0]
                row[1] = max(row[1], found[0])
                row[2] += found[0] > 0
                row[5:] += found[1:]
        out[:, 3] = out[:, 0] / np.sqrt(1 + np.diff(woff))
        logs = [0, 2, 5, 6, 7]
        out[:, logs] = np.log1p(out[:, logs])
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, data, off in _whole_texts(column):
            out[a : a + len(off) - 1] = self.probability(self.features(data, off))
        return np.round(out, 9)


FUNCTION_WORDS = {mark: np.sort(np.array([whole(x) for x in table], np.uint64)) for mark, table in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))}


def _whole_texts(column: pa.Array):
    """Blocks of whole texts; only a text longer than a block makes a longer one."""
    data, off = C.text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + C.BLOCK, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _text_counts(texts: list[str], wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """In how many of the texts each form occurs."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, data, off in _whole_texts(pa.array(texts, pa.string())):
        starts, ends, sums, _, woff = words(data, off)
        owner = np.searchsorted(woff, np.arange(len(starts)), "right") - 1
        found = [keys]
        for some, hashes in forms(starts, ends, sums):
            if wanted is not None:
                keep = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                some, hashes = some[keep], hashes[keep]
            order = np.lexsort((hashes, owner[some]))
            found.append(hashes[order[C.run_starts(owner[some][order], hashes[order])]])
        every = np.concatenate(found)
        names, at = np.unique(every, return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)]), len(names)).astype(np.int64)
        keys = names
    return {"keys": keys, "counts": counts}


def lexicon(good: list[str], bad: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of the forms that mark the bad texts: lower bounds of their log-odds, and the general words."""
    prior = {int(whole(x)): 3.0 for x in INSULTS}
    if good and bad:
        found = _text_counts(bad)
        often = found["counts"] >= max(3, 0.004 * len(bad))
        keys, pos = found["keys"][often], found["counts"][often]
        neg = np.zeros(len(keys))
        if len(keys):
            other = _text_counts(good, keys)
            neg[np.searchsorted(keys, other["keys"])] = other["counts"]
        odds = np.log((pos + 0.5) / (len(bad) + 1)) - np.log((neg + 0.5) / (len(good) + 1))
        lower = odds - 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        take = np.flatnonzero(lower > LEAST_ODDS)
        take = take[np.lexsort((keys[take], -lower[take]))][:LEXICON]
        for k, w in zip(keys[take].tolist(), lower[take].tolist(), strict=True):
            prior[k] = max(w, prior.get(k, 0.0))
    names = sorted(prior)
    return np.array(names, np.uint64), np.array([prior[k] for k in names])


def fit(texts: list[str], labels: list[int], grammar: bool = True) -> Grammar:
    """Learn the lexicon and the logistic map; the order of the rows doesn't matter, and equal texts count once.  Without ``grammar`` the words count alone (for comparison).

    The map is fitted on scores by a lexicon that was learnt from the other half of the texts.
    """
    label: dict[str, int] = {}
    for t, y in zip(texts, labels, strict=True):
        label[t] = max(label.get(t, 0), int(y))
    halves: list[list[list[str]]] = [[[], []], [[], []]]
    for t in sorted(label):
        halves[zlib.crc32(t.encode()) & 1][label[t]].append(t)
    good, bad = (halves[0][y] + halves[1][y] for y in (0, 1))
    names, weights = lexicon(good, bad)
    learnt = Grammar(names, weights, np.array([-4.0, 1, 1, 1, 1, 0, 0, 0, 0]), np.zeros(FEATURES), np.ones(FEATURES), grammar)
    if all(x for half in halves for x in half):
        parts, y = [], []
        for mine, other in ((0, 1), (1, 0)):
            half = Grammar(*lexicon(*halves[other]), learnt.coefficients, learnt.centre, learnt.scale, grammar)
            every = halves[mine][0] + halves[mine][1]
            parts += [half.features(d, o) for _, d, o in _whole_texts(pa.array(every, pa.string()))]
            y += [0] * len(halves[mine][0]) + [1] * len(halves[mine][1])
        x = np.concatenate(parts)
        learnt.centre, learnt.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        learnt.coefficients = logistic((x - learnt.centre) / learnt.scale, np.array(y))
    return learnt


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method; the intercept isn't shrunk."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pull[0] = 1e-6
    weights = np.ones(len(z)) if weights is None else weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (weights * (y - p)) - pull * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id_column) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 by 4; a null id is held out too."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Grammar:
    """Fit on labelled rows that aren't held out: at most ``rows`` distinct (id, text) and ``size`` bytes of them, those with the smallest hashes.

    An id that is labelled twice has its higher label; an id with several texts gives each of them.
    """
    C.prepare(docs.sparkSession)
    given = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_y")).where(F.col("_y").isin(0, 1)).where(~held_out(F.col("_id")))
    given = given.groupBy("_id").agg(F.max("_y").alias("_y"))
    by_hash = lambda y: given.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2)
    sample = F.broadcast(by_hash(0).unionByName(by_hash(1)))  # at most `rows` ids
    text = F.coalesce(docs[text_col], F.lit(""))
    mine = docs.select(docs[id_col].alias("_id"), text.alias("_t"), F.sha2(F.concat_ws(" ", docs[id_col].cast("string"), text), 256).alias("_h")).join(sample, "_id")
    got = [(r["_t"], r["_y"]) for r in C.sampled(mine, rows, size)]
    grammar = fit([t for t, _ in got], [y for _, y in got])
    del got
    C.trim()
    return grammar


def _score(grammar: Grammar):
    schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = grammar.score(batch.column("_t"))
            extra = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            names = [n for n in batch.schema.names if n != "_t"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + extra, names=names + schema.names)

    return C.frees(run)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``THRESHOLD`` on) for every row.

    The score depends on the text alone.  A null text is empty and scores as one; without labels of both kinds the
    general words and a fixed map are used; equal texts get equal scores; an empty table gives an empty result; other
    columns are ignored.  No shuffle of texts.
    """
    grammar = train(docs, labels, id_col, text_col, label_col, rows)
    out = docs.select(docs[id_col].alias("_id"), held_out(docs[id_col]).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = out.mapInArrow(_score(grammar), f"_id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("_id", id_col)


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic.

    A null text is scored as an empty one and stays null; repeated rows are all kept or all rejected; a null id's row is scored like any
    other; an empty table gives an empty result.  No shuffle of texts.
    """
    grammar = train(docs, labels, id_col, text_col, label_col, rows)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    kind = packed.schema["_row"].dataType.simpleString()
    return packed.mapInArrow(_score(grammar), f"_row {kind}, score double, predicted int").where("predicted = 0").select("_row.*")
