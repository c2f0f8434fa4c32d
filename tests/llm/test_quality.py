import random

import numpy as np
from pyspark.sql import functions as F

from tonearm.llm import common as C
from tonearm.llm import quality as Q


def test_em_recovers_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.9, 0.6, 0.75, 0.8])
    cover = np.array([0.9, 0.5, 0.8, 0.9, 0.4, 0.7, 0.9, 0.6, 0.5])
    correct = r.random((len(truth), 9)) < right
    v = np.where(r.random((len(truth), 9)) < cover, np.where(correct == truth[:, None], Q.GOOD, Q.BAD), Q.NONE)
    names, at, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    share, chance, good = Q.em(names, counts)
    assert abs(share[0] - 0.7) < 0.03
    assert np.abs(Q.accuracies(share, chance) - right).max() < 0.05
    assert ((good[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_em_estimates_labellers_of_one_fault():
    """Labellers that only speak against texts, each of its own fault, some often wrongly, beside four that see all texts."""
    r = np.random.default_rng(2)
    n = 40_000
    fault = r.choice(6, n, p=[0.7, 0.1, 0.08, 0.06, 0.04, 0.02])  # 0: good
    wrong = np.array([0.0, 0.002, 0.01, 0.02, 0.0])
    v = np.full((n, 9), Q.NONE)
    for i in range(5):
        v[:, i] = np.where((fault == i + 1) & (r.random(n) < 0.9) | (fault == 0) & (r.random(n) < wrong[i]), Q.BAD, Q.NONE)
    for i, right in ((5, 0.92), (6, 0.85), (7, 0.95), (8, 0.8)):
        ok = r.random(n) < right
        v[:, i] = np.where(ok == (fault == 0), Q.GOOD, Q.BAD)
    names, at, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    share, chance, good = Q.em(names, counts)
    spoke = v[:, :5] == Q.BAD
    true = [(spoke[:, i] & (fault > 0)).sum() / spoke[:, i].sum() for i in range(5)] + [0.92, 0.85, 0.95, 0.8]
    got = Q.accuracies(share, chance)
    assert np.abs(got - true).max() < 0.12, (got, true)
    assert got[3] < got[:3].min() and got[3] < got[4]  # the one that is wrong most often is seen to be
    assert ((good[at.ravel()] > 0.5) == (fault == 0)).mean() > 0.95


def test_figures_on_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(docs).join(labels, "doc_id").where("quality in (0, 1)").select("score", "keep", "quality").collect()
    y, keep = np.array([x.quality for x in got]), np.array([x.keep for x in got])
    assert (keep == (y == 1)).mean() > 0.97 and (~keep[y == 0]).mean() > 0.85


def test_sample_takes_copies_once_and_few_bytes(spark):
    rows = [("same text",)] * 500 + [(f"text {i} " * 20,) for i in range(100)]
    texts = spark.createDataFrame(rows, "_t string")
    keyed = texts.withColumn("_h", F.xxhash64("_t"))
    got = C.sampled(keyed, 40, 1 << 20)
    assert len(got) == len({x._t for x in got}) == 40
    assert [x._h for x in sorted(got)] == [x._h for x in sorted(C.sampled(keyed.repartition(5), 40, 1 << 20))]
    assert 0 < sum(len(x._t) for x in C.sampled(keyed, 40, 1000)) <= 1000
    assert len(C.sampled(keyed, 40, 1)) == 1 and C.sampled(keyed.limit(0), 40, 1000) == []


def corpus(seed, n=500):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfglmst" for b in ("a", "ei", "o") for c in ("r", "st", "nd", "ll")] + ["the", "of", "and", "to", "is"] * 12
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(40, 200))]
        bad = i % 5 == 0
        if not bad:
            t = ". ".join(" ".join(w[j : j + 9]).capitalize() for j in range(0, len(w), 9)) + "."
        elif i % 20 == 0:
            t = " | ".join(x for x in w if len(x) > 3)
        elif i % 20 == 5:
            t = " ".join(x + r.choice(["###", "$$$", "%%%"]) for x in w)
        elif i % 20 == 10:
            t = " ".join(x.upper() + "!!" for x in w)
        else:
            t = " ".join([w[0]] * len(w))
        rows.append((i, t, bad))
    return rows


def test_separates_without_labels(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (902, rows[1][1], 0.0), (None, rows[1][1], 0.0)], "doc_id long, text string, score double")
    got = {x.doc_id: x for x in Q.classify(docs).collect()}
    assert len(got) == 504
    assert sum(got[i].keep != bad for i, _, bad in rows) / len(rows) > 0.97
    assert got[900].score == got[901].score and got[902].score == got[1].score == got[None].score
    assert Q.classify(docs.limit(0)).collect() == []
    small = Q.train(docs, rows=50)[0]  # a bounded sample is enough
    import pyarrow as pa

    p = small.score(pa.array([t for _, t, _ in rows]))
    assert np.mean([(x >= 0.5) != bad for x, (_, _, bad) in zip(p, rows)]) > 0.9
