"""Personal data by a semi-Markov conditional random field.

The field scores whole segments of tokens: features of a candidate span as a unit (its
shape, digit count, checksum, the word before it) have a weight for each type, and so has each pair
of neighbouring types; dynamic programming over segments of at most ``LONGEST`` tokens chooses
boundaries and types together.  The weights maximise the likelihood of sentences made from fixed
templates (forward and backward sums over all segmentations), so they depend on no corpus.  Four base patterns (email, ip, card,
phone) are always reported; the field adds spans that do not touch them, of the same
kinds written otherwise and of secrets.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
LONGEST = 6

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern; those that fail the kind's test are dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if any(x in text for x in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


# --- the field --------------------------------------------------------------------

TOKEN = re.compile(r"[^\s,;|<>\"'\[\]{}=:]+")
TRIGGER = re.compile(r"[0-9@]|^\(?[dD][oO][tT]\)?$")
ANY = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")
OCTET = re.compile(r"[0-9]{1,3}")
#: Tokens of context on either side of a stretch of tokens with a digit or @, or of a spelt dot.
MARGIN = 3
_HEX = frozenset("0123456789abcdefABCDEF")
_DIGITS = frozenset("0123456789")
TYPES = ("", *KINDS)
# Words before a span that tell its type.
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "to"}, "ip": {"ip", "host", "server", "address", "from", "login"}, "card": {"card", "visa", "credit", "account", "pay", "mastercard"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "telephone", "cell"}, "secret": {"token", "key", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api", "auth", "bearer", "access_token"},
}


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of tokens i..j-1 as one span."""
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b].strip(".()!?")
    digits = sum(c in _DIGITS for c in span)
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else ""
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", span))
    out = ["bias", f"n={j - i}", f"d={min(digits, 20)}", f"shape={shape[:12]}"]
    out += [f"cue={k}" for k, words in CUES.items() if before in words]
    head, _, tail = span.partition("@")
    if tail:
        out.append("at+dot" if head and "." in tail and j - i == 1 and "@" not in tail else "at")
    low = span.lower().replace("(", "").replace(")", "").split()
    if "at" in low[1:-2] and low[-2] == "dot":
        out.append("spelt" if len(low) == 5 and low.index("at") == 1 and low.count("at") == low.count("dot") == 1 else "spelt-wide")
    parts = span.split(".")
    if len(parts) == 4 and all(OCTET.fullmatch(p) for p in parts):
        out.append("ip-ok" if all(int(p) <= 255 for p in parts) else "ip-bad")
    if digits >= 9 and not any(c.isalpha() for c in span):
        only = "".join(c for c in span if c in _DIGITS)
        out.append("plus" if span.startswith("+") else "no-plus")
        if 14 <= digits <= 19:
            out.append("luhn" if luhn(only) else "not-luhn")
        if span.startswith("(") or text[a : a + 1] == "(":
            out.append("paren")
        if span[:1] == "0":
            out.append("zero")
    if j - i == 1 and len(span) >= 16 and digits >= 3 and "@" not in span and any(c.isalpha() for c in span):
        out.append("hex-long" if all(c in _HEX for c in span) and len(span) >= 32 else "mixed-long")
        counts = Counter(span)
        out.append("entropy" + str(int(-sum(n / len(span) * math.log2(n / len(span)) for n in counts.values()))))
    return out


class Field:
    """A semi-Markov chain over segments: a weight for each (feature, type) and for each pair of neighbouring types.

    Types are ``TYPES``; the first is one token outside, which is also the state before a stretch.
    """

    def __init__(self, weights: dict[str, list[float]], follow: list[list[float]]) -> None:
        self.weights, self.follow = weights, follow

    def scores(self, text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[float]:
        """Score of tokens i..j-1 as one segment of each type; only one token can be outside."""
        rows = [w for f in segment_features(text, tokens, i, j) if (w := self.weights.get(f))]
        out = [sum(x) for x in zip(*rows, strict=True)] if rows else [0.0] * len(TYPES)
        return out if j - i == 1 else [-math.inf, *out[1:]]

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Segments (first token, end, type) of the best segmentation; memory is linear in the tokens."""
        n, kinds = len(tokens), range(len(TYPES))
        entry: list[list[float]] = []  # best score of a segment of each type that starts at i, before its own
        came: list[list[int]] = []
        state = [0.0] + [-math.inf] * len(KINDS)
        back: list[list[int]] = [[]]
        for j in range(1, n + 1):
            froms = [max(kinds, key=lambda p, t=t, s=state: s[p] + self.follow[p][t]) for t in kinds]
            came.append(froms)
            entry.append([state[p] + self.follow[p][t] for t, p in enumerate(froms)])
            state, at = [-math.inf] * len(TYPES), [j - 1] * len(TYPES)
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                own = self.scores(text, tokens, i, j)
                for t in kinds:
                    s = entry[i][t] + own[t]
                    if s > state[t]:
                        state[t], at[t] = s, i
            back.append(at)
        out, j = [], n
        t = max(kinds, key=lambda k: state[k]) if n else 0
        while j:
            i = back[j][t]
            if t:
                out.append((i, j, TYPES[t]))
            j, t = i, came[i][t]
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Spans in the stretches round tokens with a digit or @ (or a spelt dot); stretches are as long as they are and don't overlap."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        hot = [i for i, (a, b) in enumerate(tokens) if TRIGGER.search(text[a:b])]
        out: list[Span] = []
        at = 0
        while at < len(hot):
            lo = hi = hot[at]
            while at < len(hot) and hot[at] - hi <= 2 * MARGIN:
                hi = hot[at]
                at += 1
            region = tokens[max(0, lo - MARGIN) : hi + MARGIN + 1]
            for i, j, kind in self.best(text, region):
                a, b = region[i][0], region[j - 1][1]
                while b > a and text[b - 1] in ".!?)":
                    b -= 1
                if b > a:
                    out.append((a, b, kind))
        return out


def sentences(count: int, seed: int = 11) -> Iterator[tuple[str, list[Span]]]:
    """Made sentences with their spans."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def card() -> str:
        n = r.choice([15, 16, 16, 16])
        body = digits(n - 1)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return r.choice([body, "-".join(body[i : i + 4] for i in range(0, n, 4)), " ".join(body[i : i + 4] for i in range(0, n, 4))])

    makers = {
        "email": lambda: r.choice([f"{word()}.{word()}{r.randint(1, 99)}@{word()}.{r.choice(['com', 'org', 'example.net'])}", f"{word()}@{word()}.de", f"{word()} at {word()} dot {r.choice(['com', 'net', 'org'])}", f"{word()} (at) {word()} (dot) {r.choice(['com', 'de'])}"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}"]),
        "secret": lambda: r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "sk_" + "".join(r.choice("0123456789abcdefghijkLMNOPQRST") for _ in range(24))]),
    }
    decoys = [lambda: digits(r.randint(1, 8)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{word()}{digits(2)}", lambda: digits(16), lambda: f"@{word()}", lambda: f"{digits(3)},{digits(3)}", lambda: f"{word()} at {word()}", lambda: f"the dot {word()}"]
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                cue = r.random() < 0.5 or kind == "phone"
                cue_word = r.choice(sorted(CUES[kind])) + r.choice(["", ":", " ="])
                body = makers[kind]()
                if kind == "phone" and body[0] != "+":
                    cue_word = r.choice(["tel", "phone", "call", "fax"])
                text += (" " + cue_word if cue else "") + " "
                quote = r.choice(["", '"']) if kind == "secret" else ""
                text += quote
                spans.append((len(text), len(text) + len(body), kind))
                text += body + quote
            else:
                body = r.choice(decoys)()
                if len(body) == 16 and body.isdecimal() and luhn(body):
                    body = body[:-1] + str((int(body[-1]) + 1) % 10)
                text += " " + body
            text += r.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(1, 3)))
        yield text, spans


def gold_segments(text: str, tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, str]]:
    """The segmentation that the spans ask for; a span that doesn't begin and end with tokens is left out."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {}
    for i, (_, b) in enumerate(tokens):
        while b and text[b - 1] in ".!?)":
            ends.setdefault(b, i + 1)
            b -= 1
        ends[b] = i + 1
    known = {starts[a]: (ends[b], kind) for a, b, kind in spans if a in starts and b in ends and ends[b] - starts[a] <= LONGEST}
    out, i = [], 0
    while i < len(tokens):
        j, kind = known.get(i, (i + 1, ""))
        out.append((i, j, kind))
        i = j
    return out


class Likelihood:
    """Log-likelihood of segmentations and its gradient, by forward and backward sums over all sentences at once."""

    def __init__(self, data: list[tuple[str, list[Span]]]):
        rows: dict[tuple[int, ...], int] = {}
        self.names: dict[str, int] = {}
        split = [[m.span() for m in TOKEN.finditer(text)] for text, _ in data]
        self.n = np.array([len(t) for t in split])
        self.most, k = int(self.n.max(initial=0)), len(TYPES)
        shape = (self.most + 1, LONGEST + 1, len(data))
        self.row = np.full(shape, -1)  # which features has the segment of so many tokens that ends before token j
        self.gold, self.gold_follow = np.zeros((*shape, k)), np.zeros((k, k))
        for s, ((text, spans), tokens) in enumerate(zip(data, split, strict=True)):
            for j in range(1, len(tokens) + 1):
                for i in range(max(0, j - LONGEST), j):
                    f = tuple(self.names.setdefault(x, len(self.names)) for x in segment_features(text, tokens, i, j))
                    self.row[j, j - i, s] = rows.setdefault(f, len(rows))
            last = 0
            for i, j, kind in gold_segments(text, tokens, spans):
                t = TYPES.index(kind)
                self.gold[j, j - i, s, t] += 1
                self.gold_follow[last, t] += 1
                last = t
        width = max(map(len, rows), default=1)
        self.features = np.array([[*f, *[len(self.names)] * (width - len(f))] for f in rows])  # the last is a blank

    def __call__(self, weights: np.ndarray, follow: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood, its gradient by (feature, type) and by (type, next type))."""
        k, many = len(TYPES), len(self.n)
        by_row = np.concatenate([np.concatenate([weights, np.zeros((1, k))])[self.features].sum(1), np.full((1, k), -np.inf)])
        own = by_row[self.row]
        own[:, 2:, :, 0] = -np.inf
        own[:, 0] = -np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            add = lambda x, axis: np.logaddexp.reduce(x, axis)
            alpha = np.full((self.most + 1, many, k), -np.inf)
            alpha[0, :, 0] = 0
            entry = np.full_like(alpha, -np.inf)
            for j in range(1, self.most + 1):
                entry[j - 1] = add(alpha[j - 1][:, :, None] + follow, 1)
                alpha[j] = add(np.stack([entry[j - n] + own[j, n] for n in range(1, min(LONGEST, j) + 1)]), 0)
            total = add(alpha[self.n, np.arange(many)], 1)
            beta = np.full((self.most + 1, many, k), -np.inf)
            chance, pair = np.zeros_like(own), np.zeros((k, k))
            for i in range(self.most, -1, -1):
                ahead = np.full((many, k), -np.inf)
                for n in range(1, min(LONGEST, self.most - i) + 1):
                    step = own[i + n, n] + beta[i + n]
                    ahead = np.logaddexp(ahead, step)
                    chance[i + n, n] = np.exp(entry[i] + step - total[:, None])
                beta[i] = np.where((self.n == i)[:, None], 0.0, add(follow + ahead[:, None, :], 2))
                pair += np.exp(alpha[i][:, :, None] + follow + ahead[:, None, :] - total[:, None, None]).sum(0)
        value = float((np.where(self.gold > 0, own, 0) * self.gold).sum() + (self.gold_follow * follow).sum() - total.sum())
        gap = (self.gold - chance).reshape(-1, k)
        flat = self.row.ravel()
        by = np.stack([np.bincount(flat[flat >= 0], gap[flat >= 0, t], len(self.features)) for t in range(k)], 1)
        grad = np.stack([np.bincount(self.features.ravel(), np.repeat(by[:, t], self.features.shape[1]), len(self.names) + 1) for t in range(k)], 1)
        return value, grad[:-1], self.gold_follow - pair


@lru_cache(maxsize=1)
def trained(count: int = 500, rounds: int = 120, rate: float = 0.15, decay: float = 0.02) -> Field:
    """The most likely weights under a Gaussian prior, by full-batch ascent with adaptive steps; the same on every run."""
    likelihood = Likelihood(list(sentences(count)))
    params = [np.zeros((len(likelihood.names), len(TYPES))), np.zeros((len(TYPES), len(TYPES)))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        _, *grads = likelihood(*params)
        for p, g, m, v in zip(params, grads, mean, square, strict=True):
            g = g - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({name: params[0][i].round(6).tolist() for name, i in likelihood.names.items()}, params[1].round(6).tolist())


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); what the field adds touches no base span, nor each other."""
    base = base_spans(text)
    added = []
    if ANY.search(text):
        taken = sorted((a, b) for a, b, _ in base)
        starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
        for a, b, kind in field.spans(text):
            i = bisect.bisect_left(starts, b)  # base spans that start before b
            if not i or reach[i - 1] <= a:
                added.append((a, b, kind))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (s[0], order[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


COLUMNS = "_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_found long"


def _find(field: Field):
    schema = pa.schema([("_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_found", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                base, every = all_spans(text, field)
                n = Counter(k for _, _, k in base)
                out.append([i, *(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(k == "secret" for _, _, k in every), len(every)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return C.frees(run)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end in code points), n_secret and n_found (all spans) for every row.

    A null text is empty; equal texts get equal values; repeated rows each give a row; an empty table gives an empty result;
    other columns are ignored.  The field is fitted once, on the driver, from made sentences, and shipped with the tasks.  No shuffle.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    return rows.mapInArrow(_find(trained()), COLUMNS).withColumnRenamed("_id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by the first's."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(t, field)[1]) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_t"])

    return C.frees(run)


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with its texts masked; ``length_col``, if given, is set to their new lengths.

    A null text stays null, as does its length; an empty one stays empty; repeated rows each stay; an empty table gives an empty
    result; all columns keep their names, types and order.  No shuffle.
    """
    C.prepare(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"), docs[text_col].alias("_t"))
    kind = packed.schema["_row"].dataType.simpleString()
    out = packed.mapInArrow(_mask(trained()), f"_row {kind}, _t string")
    new = {text_col: F.col("_t")} | ({length_col: F.char_length("_t").cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
