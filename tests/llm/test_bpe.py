import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tonearm.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(n, seed):
    r = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzéüñß   ..,,0123456789\n\t'’中文日🙂"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_as_the_library(library):
    import regex

    bpe = B.load(PATH)
    for text in words(400, 1) + ["don't we'll", "a" * 300, " " * 50 + "x", "é" * 40]:
        assert [t for p in regex.findall(P.PATTERN, text) for t in bpe.encode_piece(p.encode())] == library.encode_ordinary(text)


def test_pairs_fit_as_the_merges_say():
    bpe, r = B.load(PATH), random.Random(8)
    ids = sorted(bpe.tokens)
    for _ in range(30_000):
        a, b = r.choice(ids), r.choice(ids)
        if not bpe.reachable(a):
            continue
        assert bpe.compatible(a, b) == (bpe.merged(bpe.tokens[a] + bpe.tokens[b]) == [a, b])
    for t in r.sample(ids, 3000):
        assert bpe.reachable(t) == (bpe.merged(bpe.tokens[t]) == [t])


def test_appends_and_edits():
    bpe, r = B.load(PATH), random.Random(2)
    for text in words(60, 3):
        data = text.encode()
        grown = B.Prefixes(bpe)
        for i in range(0, len(data), 7):
            grown.append(data[i : i + 7])
        assert grown.tokens() == bpe.merged(data)
        a = r.randint(0, len(data))
        b = r.randint(a, len(data))
        new = r.choice(words(5, a)).encode()[:12]
        grown.replace(a, b, new)
        assert grown.data == data[:a] + new + data[b:]
        assert grown.last == B.Prefixes(bpe, grown.data).last


def test_query_rows(spark, library):
    texts = [(1, "Hello there, it's 12 o'clock"), (2, None), (3, ""), (4, "été " * 30_000), (4, "été " * 30_000), (None, "\n\n x"), (7, "ab" * 400)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, ids string")
    rows = B.encode_decode(docs, PATH, P.PATTERN, with_ids=True).collect()
    key = lambda x: str(x[0])
    for row, (i, t) in zip(sorted(rows, key=key), sorted(texts, key=key), strict=True):
        ids = library.encode_ordinary(t or "")
        assert row.doc_id == i and row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode_decode(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_rows_go_on_in_pieces(library, monkeypatch):
    monkeypatch.setattr(B, "EMIT_TOKENS", 20)
    texts = ["", "", "one two three " * 20, "", *words(40, 5), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["_id", "_t"])
    out = list(B._run(PATH, P.PATTERN, True)(iter([batch, batch.slice(0, 2), batch.slice(0, 0)])))
    assert len(out) > 3
    rows = [row for part in out for row in part.to_pylist()]
    assert [row["_id"] for row in rows] == [*range(len(texts)), 0, 1]
    for row in rows:
        assert row["ids"] == library.encode_ordinary(texts[row["_id"]]) and row["n_tokens"] == len(row["ids"])
