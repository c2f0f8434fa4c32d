"""The pipeline's stages, each written and read again, against plain versions."""

import hashlib
import importlib
import random
import sys

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tonearm.llm import bpe, pii, toxicity
from tonearm.llm import queries as Q

from .test_minhash import brute as near_brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfglmst" for b in "aeiou" for c in ("r", "st", "nd", "")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = " ".join(r.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(400):
        t = text(r.randint(20, 120))
        y = int(i % 6 == 0)
        if y:
            t += " you idiot " + text(3) + " worthless moron"
        if r.random() < 0.8:
            labels.append((i, 1, y))
        rows.append((i, t))
    for i in range(400, 440):  # near copies
        w = rows[i - 399][1].split()
        w[len(w) // 2] = "changed" if len(w) > 60 else w[len(w) // 2]
        rows.append((i, " ".join(w)))
    rows += [(500, text(10) + " " + item + " " + text(10)), (501, "write to a.b@c.org or 10.0.0.1 " + text(9)), (502, ""), (503, None), (504, rows[7][1])]
    base = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, corpus, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    read, kept = spark.read.parquet(f"{corpus}/documents.parquet"), []
    columns = read.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, read, corpus).write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x.doc_id: x for x in read.collect()})
        if k < len(pipeline.STAGES) - 1:
            assert read.columns == columns, name
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    scores = toxicity.score(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
    assert set(kept[0]) == {x.doc_id for x in scores.collect() if not x.predicted}
    assert len(docs) * 0.6 < len(kept[0]) < len(docs)
    rows = [(i, docs[i]) for i in kept[0]]
    assert set(kept[1]) == {d for d, _, _, keep in near_brute(rows, 5, 80) if keep}
    assert set(kept[1]) - set(kept[2]) == {500}
    field = pii.trained()
    for i, x in kept[3].items():
        t = kept[2][i].text
        assert x.text == (None if t is None else pii.masked(t, pii.all_spans(t, field)[1])) and x.n_chars == (None if t is None else len(x.text))
    assert set(kept[3]) == set(kept[2]) and kept[3][501].text.startswith("write to [EMAIL] or [IP]")
    for i, x in kept[4].items():
        t = (kept[3][i].text or "").encode()
        assert x.decoded_sha256 == hashlib.sha256(t).hexdigest() and x.n_tokens == len(x.ids)
    assert set(kept[4]) == set(kept[3])


def test_stages_take_any_rows(spark, corpus, tmp_path):
    """Repeated rows, null ids and texts, empty texts, more columns with clashing names, and empty tables."""
    pipeline = importlib.import_module("corpus_pipeline")
    long = "word " * 30 + "and some more words so that it is a text of its own kind"
    rows = [(1, long, 1, "a"), (1, long, 1, "a"), (None, long, None, "b"), (None, "quite another text, with words that nothing else here has at all", 2, "b"), (3, None, None, None), (3, None, None, None), (4, "", 0, ""), (5, " \n", 2, "c"), (6, "write to a.b@c.org now", 22, "d")]
    kind = "doc_id long, text string, n_chars long, component string"
    docs = spark.createDataFrame(rows, kind).withColumns({x: F.lit(x) for x in ("_k", "_t", "_id", "score", "predicted", "item", "h", "_row", "__row")})
    read, kept = docs, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, read, corpus).write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert read.columns == docs.columns, name
            kept.append(sorted([(x.doc_id, x.text) for x in read.collect()], key=str))
    assert kept[0] == sorted([(i, t) for i, t, *_ in rows], key=str)
    # one of the copies, and one of each text without words of one id
    assert kept[1] == kept[2] == sorted([(1, long), (None, rows[3][1]), (3, None), (4, ""), (5, " \n"), (6, rows[8][1])], key=str)
    assert (6, "write to [EMAIL] now") in kept[3] and (3, None) in kept[3] and len(kept[3]) == 6
    assert read.count() == 6
    read = docs.limit(0)
    for _, stage in pipeline.STAGES:
        read = stage(spark, read, corpus)
    assert read.count() == 0


def test_run_and_registration(spark, corpus):
    pipeline, entry = importlib.import_module("corpus_pipeline"), importlib.import_module("__spark_entry__")
    assert pipeline.run(spark, corpus).count() > 0
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and set(Q.queries()) <= names
    _ = bpe, P, sys
