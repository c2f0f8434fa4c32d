import random
import re

import pytest

from tonearm.llm import components as K
from tonearm.llm import minhash as M


def brute(rows, size, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        have = least.get(top(i))
        least[top(i)] = d if have is None else have if d is None else min(d, have)
    return sorted([(d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "THE", "É", "é"]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, i = [], 0
    for _ in range(25):
        base = text(r.choice([3, 4, 30, 80, 200]))
        for _ in range(r.choice([1, 2, 8])):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "Hi"), (904, "hI"), (905, rows[0][1]), (rows[1][0], rows[1][1]), (None, rows[2][1]), (None, "lonely words that nothing else has at all")]


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_matches_brute_force(spark, seed, size):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = M.near_duplicates(docs, shingle=size).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows, size, 80)


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 2)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(x) for x in M.near_duplicates(docs).collect()], key=str) == brute(rows, 4, 80)


def test_pair_blocks():
    for blocks in (1, 2, 5):
        keys = [set(M.pair_blocks(77, m, blocks)) for m in range(60)]
        assert all(a & b for a in keys for b in keys)


def test_long_chain_and_empty(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "u long, v long")
    assert {tuple(x) for x in K.components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = M.keep_one(docs)
    assert got.columns == docs.columns
    want = {(d, t) for (d, t), (_, _, _, kept) in zip(sorted(rows, key=lambda x: str(x[0])), sorted(brute(rows, 4, 80), key=lambda x: str(x[0]))) if kept and d is not None}
    have = {(x.doc_id, x.text) for x in got.collect()}
    assert {d for d, _ in have if d is not None} == {d for d, _ in want}
    assert got.count() == len(have)
