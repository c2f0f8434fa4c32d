import hashlib
import random
from collections import Counter

import pytest

from tonearm.llm import suffix_dedup as S


def brute(rows, length):
    """Count every string of the length; mark what the repeated ones cover."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        cover = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for j, c in enumerate(cover) if c and (j == 0 or not cover[j - 1]))
        out.append((i, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (5, 12, 30, 60)]
    rows = [(i, r.choice(["", text(5)]) + r.choice(shared) + text(r.randint(0, 40)) + r.choice(shared)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "ab" * 200), (104, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    rows += [(200 + i, rows[5][1][: r.randint(0, 80)] + "x" + rows[5][1][r.randint(0, 20) :]) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 10_000), (2, 10_000), (3, 3)])
def test_matches_brute_force(spark, seed, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, _k int")
    got = S.remove_repeated(docs, length=40, gram=12, group_limit=limit).collect()
    assert sorted([tuple(x)[:5] for x in got], key=str) == brute(rows, 40)


def test_long_text_in_pieces(spark, monkeypatch):
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, a), (2, a[1200:1900] + "zz"), (3, "q" + a[2500:2700])]
    monkeypatch.setattr(S.C, "BLOCK", 500)
    monkeypatch.setattr(S.C.byte_blocks, "__defaults__", (500,))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"_k": [1, 2, 3], "_t": [t for _, t in rows]})
    cut = sorted(x for b in S._anchors(200, 64)([batch]) for x in zip(*b.to_pydict().values()))
    monkeypatch.setattr(S.C.byte_blocks, "__defaults__", (1 << 20,))
    whole = sorted(x for b in S._anchors(200, 64)([batch]) for x in zip(*b.to_pydict().values()))
    assert set(cut) >= set(whole) and {x[0] for x in cut} == {x[0] for x in whole}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeated(docs).collect() == []
