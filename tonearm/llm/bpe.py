"""Byte-level BPE by dynamic programming over prefixes.

A sequence of tokens is the BPE encoding of its bytes if and only if every two
neighbours are, alone, what BPE makes of their joined bytes.  So each byte prefix has
one last token that is valid after the last token of the prefix before it.  ``Prefixes``
stores that token for each prefix: appending is exact, an edit re-encodes only the
prefixes after it, and the encoding is read off backwards.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CACHE_PIECES = 300_000
KEPT_PAIRS = 300_000
#: Rows go on when they have so many tokens together.
EMIT_TOKENS = 1 << 17


class Bpe:
    """Ranks of byte strings; pieces are encoded separately."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.pairs = 0
        # tokens by their bytes from the last to the first: byte -> [token or -1, which tokens it fits behind, next bytes]
        self.endings: dict[int, list] = {}
        for token, number in ranks.items():
            branch, node = self.endings, None
            for byte in reversed(token):
                node = branch.setdefault(byte, [-1, None, {}])
                branch = node[2]
            node[:2] = number, {}

    def forget(self, most: int) -> None:
        """Drop the pairs that were tested, if they are many."""
        if self.pairs > most:
            todo = list(self.endings.values())
            while todo:
                _, fits, branch = todo.pop()
                if fits:
                    fits.clear()
                todo.extend(branch.values())
            self.pairs = 0

    def merged(self, piece: bytes) -> list[int]:
        """The merges in order of rank, for short pieces: the definition that pairs are tested by."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None: a single byte, or not made by merges."""
        if token not in self._parts:
            data, found = self.tokens[token], None
            # the last merge joins two tokens at the only place where both sides encode to themselves and fit
            pieces = [data[i : i + 1] for i in range(len(data))]
            while len(pieces) > 2:
                joins = [(r, i) for i in range(len(pieces) - 1) if (r := self.ranks.get(pieces[i] + pieces[i + 1])) is not None]
                if not joins:
                    break
                _, i = min(joins)
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            if len(pieces) == 2:
                found = (self.ranks[pieces[0]], self.ranks[pieces[1]])
            self._parts[token] = found
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        """Whether merges lead to this token."""
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merges lead to b, and a, b is the encoding of their joined bytes.

        Undoes the newer merge next to the boundary, again and again: the pair is broken if at some point the two tokens at
        the boundary would have been joined before the merge that was undone last.
        """
        return self.reachable(b) and self._boundary_holds(a, b)

    def _boundary_holds(self, a: int, b: int) -> bool:
        ranks, tokens, before = self.ranks, self.tokens, 1 << 62
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < before:
                return False
            left, right = self.parts(a), self.parts(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:  # a join of equal age further left comes first
                before, b = b + 1, right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the split pattern; a piece that is a token is that token."""
        one = self.ranks.get(piece)
        return [one] if one is not None else Prefixes(self, piece).tokens()


class Prefixes:
    """The last token of each prefix of a growing byte string."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: prefixes that are there stay as they are."""
        bpe, last = self.bpe, self.last
        endings = bpe.endings
        data = self.data = self.data + more
        for end in range(len(last), len(data) + 1):
            branch, start = endings, end
            while True:
                start -= 1
                token, fits, branch = branch[data[start]]
                if token < 0:
                    continue
                if not start:
                    if end > 1 and not bpe.reachable(token):
                        raise ValueError("a prefix has no encoding")
                    break
                good = fits.get(last[start])
                if good is None:
                    good = fits[last[start]] = bpe.compatible(last[start], token)
                    bpe.pairs += 1
                if good:
                    break
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Re-encode near an edit: prefixes before it are kept, and those after it until they agree again with the old ones."""
        tail = self.data[end:]
        old_last, shift = self.last, start + len(new) - end
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        # The last token of a prefix depends on the last tokens of the `longest` prefixes before it.
        agree, i = 0, 0
        while i < len(tail) and agree < self.bpe.longest:
            self.append(tail[i : i + 1])
            i += 1
            agree = agree + 1 if self._same_as(old_last, end + i, shift) else 0
        self.data += tail[i:]
        self.last += old_last[end + i + 1 :]

    def _same_as(self, old: list[int], old_end: int, shift: int) -> bool:
        token = self.last[old_end + shift]
        return token == old[old_end] and len(self.bpe.tokens[token]) <= old_end

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes, of all by default."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.bpe.tokens[out[-1]])
        return out[::-1]


_LOADED: dict[str, tuple[Bpe, dict[str, bytes], dict[bytes, bytes]]] = {}


def loaded(path: str) -> tuple[Bpe, dict[str, bytes], dict[bytes, bytes]]:
    """The vocabulary of a rank file (base64 of the bytes, a space, the rank), the pieces encoded so far, and the tokens by decimal id."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            bpe = Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        _LOADED[path] = (bpe, {}, {b"%d" % i: t for i, t in bpe.tokens.items()})
    return _LOADED[path]


def unload(path: str) -> None:
    _LOADED.pop(path, None)


def load(path: str) -> Bpe:
    return loaded(path)[0]


def _run(path: str, pattern: str, with_ids: bool, forget: bool = False):
    fields = [("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def emit(out: list[list], ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
        if with_ids:
            ends = np.cumsum([0, *(row[1] for row in out)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        bpe, cache, table = loaded(path)
        for batch in batches:
            out: list[list] = []
            every: list[np.ndarray] = []  # the ids of the rows in `out`
            held = 0
            for key, value in zip(batch.column("_id").to_pylist(), batch.column("_t"), strict=True):
                ids, decoded, count, first = hashlib.sha256(), hashlib.sha256(), 0, True
                for found in _pieces(split, value.as_py()):
                    if not found:
                        continue
                    fresh = [p for p in set(found) if p not in cache]
                    if fresh and len(cache) + len(fresh) > CACHE_PIECES:
                        cache.clear()
                        fresh = list(set(found))
                    for piece in fresh:
                        cache[piece] = ",".join(map(str, bpe.encode_piece(piece.encode()))).encode()
                    row = b",".join([cache[p] for p in found])
                    ids.update(row if first else b"," + row)
                    numbers = row.split(b",")
                    decoded.update(b"".join([table[x] for x in numbers]))
                    if with_ids:
                        every.append(np.fromstring(row, np.int32, sep=","))
                    first, count = False, count + len(numbers)
                out.append([key, count, ids.hexdigest(), decoded.hexdigest()])
                held += count
                if held >= EMIT_TOKENS:
                    yield emit(out, every)
                    out, every, held = [], [], 0
            if out:
                yield emit(out, every)
        cache.clear()  # a reused worker keeps the vocabulary and the fitting pairs only
        bpe.forget(KEPT_PAIRS)
        if forget:
            unload(path)
            del bpe, cache, table
            C.trim()

    return run


def _pieces(split, text: str, limit: int = 1 << 16) -> Iterator[list[str]]:
    """The matches of the pattern, in lists of bounded size for long texts."""
    if len(text) <= limit:
        yield split.findall(text)
        return
    held: list[str] = []
    for m in split.finditer(text):
        held.append(m[0])
        if len(held) >= limit // 4:
            yield held
            held = []
    yield held


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Token counts, the digest of the ids joined by commas, and the digest of the bytes that the ids decode to.

    ``path`` is a rank file that every executor can open.  A row per row; a null text is empty and has no tokens; an empty
    table gives an empty result; other columns are ignored; ``with_ids`` adds the ids;
    ``forget`` drops the vocabulary from a worker after each task, for workers that also run other operators.  No shuffle.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    kinds = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_run(path, pattern, with_ids, forget), kinds).withColumnRenamed("_id", id_col)
