import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tonearm.llm import debruijn as D


def brute(rows, size):
    order = lambda i: D.LAST if i is None else i
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < order(i):
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "b", "the", "été", "of", "x1", "Y"]) for _ in range(n))
    shared = [text(n) for n in (4, 8, 20, 50)]
    rows = [(i, "  ".join([text(r.randint(0, 10)), r.choice(shared), text(r.randint(0, 30)), r.choice(shared)])) for i in range(80)]
    r.shuffle(rows)
    rows += [(100, None), (101, ""), (102, "a " * 90), (103, "a\n" * 40), (104, rows[3][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[7][1]), (None, rows[4][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 10_000), (2, 4), (3, 10_000)])
def test_matches_brute_force(spark, seed, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, start int")
    got = D.remove_repeated(docs, size=6, gram=2, group_limit=limit).collect()
    assert sorted([tuple(x)[:4] for x in got], key=str) == brute(rows, 6)


@pytest.mark.parametrize("bits,limit", [(0x3F, 10_000), (0x3FF, 10_000), (0x3FF, 4)])
def test_colliding_hashes_lose_nothing(spark, bits, limit):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.remove_repeated(docs, size=6, gram=2, group_limit=limit, bits=bits).collect()
    assert sorted([tuple(x)[:4] for x in got], key=str) == brute(rows, 6)


def test_long_text_in_stretches():
    r = random.Random(4)
    t = pa.array([" ".join(f"w{r.randint(0, 500)}" for _ in range(4000))])

    def edges(limit):
        out, inside = set(), {}
        for nodes, begin, end, _, place, h, lead, trail in D._runs(t, 13, 6, limit=limit):
            for b, e, p, m, x, y in zip(*(v.tolist() for v in (begin, end, place, h, lead, trail)), strict=True):
                got = nodes[b - x : e + y].tolist()
                out |= {(p - x + i, m, *pair) for i, pair in enumerate(zip(got, got[1:], strict=False))}
                inside |= dict.fromkeys(range(p, p + e - b), m)
        return out, inside

    whole, cut = edges(1 << 22), edges(300)
    assert whole == cut
    assert sorted(whole[1]) == list(range(4000 - 13 + 2))


def test_degrees():
    # a x b, a x b, c x d: x branches; y is always between a and b; z ends a text once
    node = np.array([7, 7, 7, 8, 8, 9, 9], np.uint64)
    before, behind = np.array([1, 1, 3, 1, 1, 4, 4]), np.array([2, 2, 4, 2, 2, 5, -1])
    assert D.branching(node, before, behind).tolist() == [True] * 3 + [False] * 2 + [True] * 2


def test_empty_table(spark):
    assert D.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
