"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.  The counts of their
vote patterns over the whole corpus (at most 3 ** labellers rows, aggregated by Spark) are
what expectation-maximisation needs: it estimates the share of good texts and each
labeller's confusion.  The patterns' posteriors then label a bounded sample of texts,
on which a hashed linear scorer is trained; it reads words and shapes, so it also
judges texts on which no labeller votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import _whole_texts

#: The scorer is trained on at most so many different texts, those with the smallest hashes.
TRAIN_ROWS = 6000
#: And on at most so many bytes of them.
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 14
THRESHOLD = 0.5
#: Prior share of a fault labeller's votes that are against good texts.
WRONG = 0.05
LABELLERS = ("symbols", "separators", "capitals", "repeated_words", "repeated_lines", "punctuation", "word_length", "common_words", "digits")
GOOD, NONE, BAD = 2, 1, 0

# Common words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is that for it on with as was by an be this are not or from at have he she they we you but what when which their there "
    "le la les de des et est en que qui dans pour par sur un une au du pas avec plus ce il elle ne se son "
    "der die das und ist nicht ein eine zu von mit den auf sich im dem es er sie auch als an werden aus "
    "el los las y con por para del al lo su una como más pero sus o este"
).split()


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return C.span_hash(C.prefix_sums(C.BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0]


COMMON_HASHES = np.unique(np.array([_hash(x) for x in COMMON], np.uint64))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#$%&*@^~_=+<>\\{}[]"]] = True
_CLASSES = {"symbol": _SYMBOL, "pipe": np.arange(256) == ord("|"), "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90), "lower": (np.arange(256) >= 97) & (np.arange(256) <= 122),
            "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57), "mark": np.isin(np.arange(256), [ord(x) for x in "!?"]), "stop": np.isin(np.arange(256), [ord(x) for x in ".,;:"]), "line": np.arange(256) == 10}
SHAPES = ("symbol", "pipe", "upper", "digit", "mark", "stop", "repeated_words", "repeated_lines", "word_length", "common", "words")


def _distinct_share(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of a text's values that repeat earlier ones of it."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, owner))
    once = np.bincount(owner[order][C.run_starts(owner[order], values[order])], minlength=len(off) - 1) if len(values) else np.zeros(len(off) - 1)
    n = np.diff(off)
    return 1 - once / np.maximum(n, 1) * (n > 0) - (n == 0)


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features of each text, word hashes, word offsets)."""
    n = np.maximum(np.diff(off), 1)
    share = {k: np.diff(np.concatenate([[0], np.cumsum(table[data])])[off]) / n for k, table in _CLASSES.items()}
    # words without the marks round them
    word = ~C.SPACE[data] & ~_SYMBOL[data] & ~_CLASSES["stop"][data] & ~_CLASSES["mark"][data] & ~_CLASSES["pipe"][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts, ends = np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1
    words = C.span_hash(C.prefix_sums(C.BYTE_VALUES[C.LOWER[data]]), starts, ends)
    woff = np.searchsorted(starts, off)
    count = np.diff(woff)
    # lines that are not blank
    breaks = data == 10
    line = ~breaks
    before[1:], after[:-1] = line[:-1], line[1:]
    ls, le = np.flatnonzero(line & (~before | edge[:-1])), np.flatnonzero(line & (~after | edge[1:])) + 1
    lines = C.span_hash(C.prefix_sums(C.BYTE_VALUES[data]), ls, le)
    common = COMMON_HASHES[np.minimum(np.searchsorted(COMMON_HASHES, words), len(COMMON_HASHES) - 1)] == words
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[woff])
    columns = [share["symbol"], share["pipe"], share["upper"] / np.maximum(share["upper"] + share["lower"], 1e-9), share["digit"], share["mark"], share["stop"] * n / np.maximum(count, 1), _distinct_share(words, woff),
               _distinct_share(lines, np.searchsorted(ls, off)), sums(ends - starts) / np.maximum(count, 1), sums(common) / np.maximum(count, 1), np.log1p(count)]
    return np.stack(columns, 1), words, woff


def votes(x: np.ndarray) -> np.ndarray:
    """(texts, labellers): GOOD, NONE or BAD.  A labeller that looks for one fault says nothing of texts without it; very short texts get few votes."""
    at = {k: x[:, i] for i, k in enumerate(SHAPES)}
    many = at["words"] >= np.log1p(20)
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    return np.stack(
        [
            pick(at["symbol"] > 0.02, False),
            pick(at["pipe"] > 0.01, False),
            pick((at["upper"] > 0.4) & (at["words"] > np.log1p(3)), False),
            pick((at["repeated_words"] > 0.8) & many & (at["words"] < np.log1p(2000)), False),
            pick(at["repeated_lines"] > 0.3, False),
            pick((at["mark"] > 0.02) | (many & (at["stop"] < 0.005)), many & (at["stop"] > 0.03) & (at["mark"] < 0.01)),
            pick((at["word_length"] > 12) | ((at["word_length"] < 2) & many), False),
            pick(many & (at["common"] < 0.04), many & (at["common"] > 0.12)),
            pick(at["digit"] > 0.2, False),
        ],
        1,
    ).astype(np.int8)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of each class, (classes, labellers, 3) chance of each vote in each, posterior of class 0 for each pattern).

    Class 0 is the good texts and class 1 the bad ones; each labeller that only ever votes bad, that is, looks for one fault, has
    a class more, as texts with one fault need not have another.  Such a labeller's silence is a vote; the others' says nothing.
    How often it speaks against good texts is estimated under a prior that weighs as much as its votes: ``WRONG`` of them are against
    good ones.  (Without a prior, a fault whose texts are like good ones otherwise can be taken for a mark of good texts.)  Add-one counts
    keep every chance above 0; there is no random start.
    """
    size = patterns.shape[1]
    one_sided = np.array([not (patterns[:, i] == GOOD).any() and (patterns[:, i] == BAD).any() for i in range(size)], bool)
    faults = np.flatnonzero(one_sided)
    onehot = np.stack([(patterns == v) for v in range(3)], 2).astype(float)  # pattern, labeller, vote
    onehot[:, ~one_sided, NONE] = 0
    weight = counts.astype(float)
    spoken = weight @ (patterns == BAD) + 1
    member = np.zeros((len(patterns), 2 + len(faults)))
    found = patterns[:, faults] == BAD
    lean = ((patterns == GOOD) & ~one_sided).sum(1) - ((patterns == BAD) & ~one_sided).sum(1)
    member[:, 2:] = found / np.maximum(found.sum(1), 1)[:, None]
    member[:, 0] = np.where(found.any(1), 0, 1 / (1 + np.exp(-2.0 * lean - 0.5)))
    member[:, 1] = np.where(found.any(1), 0, 1 - member[:, 0])
    for _ in range(rounds):
        old = member
        share = (weight @ member + 1) / (weight.sum() + member.shape[1])
        mass = np.einsum("pc,plv->clv", weight[:, None] * member, onehot) + 1.0
        mass[:, ~one_sided, NONE] = 0
        against = (mass[0, one_sided, BAD] + WRONG * spoken[one_sided]) / 2
        mass[0, one_sided, NONE] += mass[0, one_sided, BAD] - against
        mass[0, one_sided, BAD] = against
        chance = mass / mass.sum(2, keepdims=True)
        log = np.einsum("plv,clv->pc", onehot, np.log(np.maximum(chance, 1e-300))) + np.log(share)
        log -= log.max(1, keepdims=True, initial=-1e300)
        member = np.exp(log)
        member /= member.sum(1, keepdims=True)
        if np.abs(member - old).max(initial=0) < 1e-9:
            break
    return share, chance, member[:, 0]


def accuracies(share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Each labeller's estimated accuracy when it votes."""
    right = share[0] * chance[0, :, GOOD] + np.einsum("c,cl->l", share[1:], chance[1:, :, BAD])
    return right / (right + share[0] * chance[0, :, BAD] + np.einsum("c,cl->l", share[1:], chance[1:, :, GOOD]))


class Scorer:
    """Logistic on standardised shapes and hashed words (their mean weight)."""

    def __init__(self, buckets: int = BUCKETS):
        self.words, self.shape, self.bias = np.zeros(buckets), np.zeros(len(SHAPES)), 0.0
        self.centre, self.scale = np.zeros(len(SHAPES)), np.ones(len(SHAPES))

    def _hashed(self, words: np.ndarray) -> np.ndarray:
        return (words % np.uint64(len(self.words))).astype(np.int64)

    def margin(self, x: np.ndarray, words: np.ndarray, woff: np.ndarray) -> np.ndarray:
        sums = np.diff(np.concatenate([[0.0], np.cumsum(self.words[self._hashed(words)])])[woff])
        return self.bias + np.clip((x - self.centre) / self.scale, -5, 5) @ self.shape + sums / np.sqrt(np.maximum(np.diff(woff), 1))

    def fit(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Scorer:
        """Full-batch gradient with AdaGrad steps on soft targets."""
        if not len(target):
            return self
        x = np.concatenate([b[0] for b in blocks])
        self.centre, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        bucket = np.concatenate([self._hashed(b[1]) for b in blocks])
        counts = np.concatenate([np.diff(b[2]) for b in blocks])
        owner = np.repeat(np.arange(len(target)), counts)
        value = 1 / np.sqrt(np.maximum(counts, 1))[owner]
        seen = [np.full(s, 1e-6) for s in (len(self.words), len(self.shape), 1)]
        for _ in range(steps):
            m = self.bias + z @ self.shape + np.bincount(owner, self.words[bucket] * value, len(target))
            gap = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - target) / len(target)
            grads = [np.bincount(bucket, gap[owner] * value, len(self.words)) + decay * self.words / len(target), z.T @ gap + decay * self.shape, np.array([gap.sum()])]
            for s, g in zip(seen, grads, strict=True):
                s += g * g
            self.words -= 0.02 * rate * grads[0] / np.sqrt(seen[0])
            self.shape -= rate * grads[1] / np.sqrt(seen[1])
            self.bias -= rate * float(grads[2][0]) / np.sqrt(seen[2][0])
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, data, off in _whole_texts(column):
            x, words, woff = shapes(data, off)
            out[a : a + len(off) - 1] = 1 / (1 + np.exp(-np.clip(self.margin(x, words, woff), -30, 30)))
        return np.round(out, 9)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote patterns and their counts in each batch."""
    for batch in batches:
        for _, data, off in _whole_texts(batch.column("_t")):
            code = votes(shapes(data, off)[0]).astype(np.int64) @ 3 ** np.arange(len(LABELLERS))
            names, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], names=["code", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[Scorer, dict[str, float]]:
    """The scorer, and the labellers' estimated accuracies."""
    C.prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    got = texts.mapInArrow(_patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # at most 3 ** labellers rows
    codes, counts = np.array([r["code"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 if len(codes) else np.zeros((0, len(LABELLERS)), np.int64)
    share, chance, good = em(patterns, counts)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    total = int(counts.sum())
    keyed = texts.select("_t", F.xxhash64("_t").alias("_h"))
    # four times the wanted share by hash, then the smallest hashes of those; nothing of the whole table is sorted
    part = keyed if total <= rows else keyed.where(F.pmod(F.xxhash64("_h"), F.lit(1_000_000)) < int(4e6 * rows / total) + 1)
    sample = sorted(r["_t"] for r in C.sampled(part, rows, size))
    blocks, target = [], []
    for _, data, off in _whole_texts(pa.array(sample, pa.string())):
        blocks.append(shapes(data, off))
        code = votes(blocks[-1][0]).astype(np.int64) @ 3 ** np.arange(len(LABELLERS))
        target += [posterior[c] for c in code.tolist()]
    return Scorer().fit(blocks, np.array(target)), dict(zip(LABELLERS, accuracies(share, chance).round(4).tolist(), strict=True))


def _apply(scorer: Scorer):
    schema = pa.schema([("_id", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scorer.score(batch.column("_t"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(p), pa.array(p >= THRESHOLD)], schema=schema)

    return C.frees(run)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and keep (score at least ``THRESHOLD``) for every row.

    The score depends on the text alone; no labels are read.  A null text is empty; equal texts get equal scores; an empty
    table gives an empty result; other columns are ignored.  No shuffle of texts.
    """
    scorer, _ = train(docs, id_col, text_col, rows)
    out = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    return out.mapInArrow(_apply(scorer), "_id long, score double, keep boolean").withColumnRenamed("_id", id_col)
