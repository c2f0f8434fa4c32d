import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tonearm.llm import toxicity as X


def clause(text, grammar):
    data = np.frombuffer(text.encode(), np.uint8)
    return grammar.features(data, np.array([0, len(data)]))[0, 1]


def test_grammar_composes():
    g = X.fit([], [])
    plain, aimed = clause("what an idiot", g), clause("you are an idiot", g)
    assert aimed > plain > 0
    assert clause("you are not an idiot", g) < plain
    assert clause("he said that they were idiot people", g) < aimed
    assert clause("I will kill you", g) > clause("to kill time", g) > 0
    assert clause("you. an idiot", g) == plain  # another clause
    assert clause("a fine day", g) == 0


def plain_sums(symbols):
    """By the definition: what is within reach of each word."""
    out = [0.0] * len(X.SUMS)
    near = lambda p, mark, both: any(t == mark and (0 < p - q <= X.SPAN or both and 0 < q - p <= X.SPAN) for q, t, _ in symbols)
    for p, s, w in symbols:
        if s not in (X.INSULT, X.THREAT):
            continue
        aimed, denied, told = near(p, X.TARGET, True), near(p, X.NEGATION, False), near(p, X.REPORT, False)
        if s == X.THREAT:
            w = X.THREAT_WEIGHT if aimed else X.THREAT_ALONE
        else:
            w *= X.FACTORS[X.AIMED] if aimed else 1
        w *= (X.FACTORS[X.DENIED] if denied else 1) * (X.FACTORS[X.TOLD] if told else 1)
        out[0] += w
        for i, flag in enumerate((aimed, denied, told), 1):
            out[i] += w * flag
    return out


def test_composed_transducer_against_distances():
    r = random.Random(4)
    for _ in range(600):
        symbols, place = [], 0
        for _ in range(r.randint(1, 8)):
            place += r.randint(1, 15)
            symbols.append((place, r.choice(X.SYMBOLS[1:]), r.choice([1.0, 2.0])))
        assert np.allclose(X.clause_sums(symbols), plain_sums(symbols))


def test_compose_runs_one_machine_after_the_other():
    r = random.Random(6)
    a, b = X.reaches(X.TARGET, X.AIMED, 3), X.reaches(X.REPORT, X.TOLD, 5)
    both = X.compose(a, b)
    assert len(both.step) == len(a.step) * len(b.step)
    for _ in range(100):
        symbols = [(p, r.choice(X.SYMBOLS)) for p in sorted(r.sample(range(40), 9))]
        assert both.read(symbols) == [x | y for x, y in zip(a.read(symbols), b.read(symbols), strict=True)]


def test_function_words_of_four_languages_are_known():
    g = X.fit([], [])
    for aimed, plain in (("you are an idiot", "what an idiot"), ("vous êtes un crétin", "un crétin"), ("du bist ein trottel", "ein trottel"), ("usted es un idiota", "un idiota")):
        assert clause(aimed, g) > clause(plain, g) > 0
    for denied, plain in (("ce n'est pas un crétin", "un crétin"), ("das ist kein trottel", "ein trottel"), ("nunca un idiota", "un idiota")):
        assert 0 < clause(denied, g) < clause(plain, g)


def test_grammar_decides_where_words_do_not():
    """Half of the texts with an insult tell or deny it, and are clean: only the grammar can learn that."""
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("r", "st", "nd", "")]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, labels = [], []
    for _ in range(900):
        kind = r.choice("aaabbc")
        insult = r.choice(["idiot", "moron", "scum", "trottel", "crétin"])
        middle = {"a": "", "b": f"{r.choice(['you', 'vous', 'ihr'])} {insult}", "c": f"{r.choice(['he said', 'selon', 'dijo', 'never a', 'nicht ein'])} {insult}"}[kind]
        # the function words stand in every text, in clauses of their own
        rest = " ".join(f"{x} {some(2)}." for x in r.sample(["you", "vous", "ihr", "he said", "selon", "dijo", "never a", "nicht ein"], 8))
        texts.append(f"{some(r.randint(5, 30))}. {some(3)} {middle} {some(2)}. {rest} {some(r.randint(5, 30))}")
        labels.append(int(kind == "b"))
    y = np.array(labels[600:])
    right = {}
    for grammar in (True, False):
        p = X.fit(texts[:600], labels[:600], grammar).score(pa.array(texts[600:])) >= X.THRESHOLD
        right[grammar] = (p == y).mean(), p[y == 1].mean(), y[p].mean()
    assert right[True][0] > 0.97 and right[True][1] > 0.97
    assert right[True][0] > right[False][0] + 0.1 and right[True][2] > right[False][2] + 0.15


def test_held_out_figures_on_the_documents():
    """Recall is read on the toxic texts that hold an insult at all; the labels call some others toxic, whose words nothing tells apart."""
    read = lambda t: pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pydict()
    d, labels = read("documents"), read("labels")
    texts = dict(zip(d["doc_id"], d["text"], strict=True))
    rows = [(texts[i] or "", y, zlib.crc32(str(i).encode()) % 4 == 2) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if i in texts and y in (0, 1)]
    g = X.fit([t for t, _, out in rows if not out], [y for _, y, out in rows if not out])
    held = [(t, y) for t, y, out in rows if out]
    p, y = g.score(pa.array([t for t, _ in held])) >= X.THRESHOLD, np.array([y for _, y in held])
    assert (p == y).mean() > 0.975 and p[y == 1].mean() >= 0.94 and y[p].mean() > 0.9


def corpus(seed, n=600):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("r", "st", "nd", "")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        y = r.random() < 0.2
        if y:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = "zorg" + r.choice(words) if r.random() < 0.7 else "idiot"
        rows.append((i, " ".join(w), "idiot"))
        if r.random() < 0.9:
            labels.append((i, 1, int(y)))
    return rows, labels


def test_learns_and_keeps_out(spark):
    rows, labels = corpus(1)
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, rows[0][1], "y"), (None, rows[0][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in X.score(docs, table).collect()}
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    out = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert sum(p == y for p, y in out) / len(out) > 0.97
    for i, x in got.items():
        assert x.held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
    assert got[9001].score == got[9002].score and got[9003].score == got[0].score == got[None].score
    # labels of held-out rows don't matter
    turned = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    assert {i: x.score for i, x in got.items()} == {x.doc_id: x.score for x in X.score(docs, turned).collect()}
    kept = X.reject(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, x in got.items() if not x.predicted)


def test_repeated_ids_do_not_change_with_the_order(spark):
    rows, labels = corpus(3, 200)
    rows += [(i, "zorg " + t, x) for i, t, x in rows[:150]] + rows[:20]
    labels += [(i, 0, 1 - y) for i, _, y in labels[:10]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    probe = pa.array([t for _, t, _ in rows])
    one, other = (X.train(spark.createDataFrame(r, "doc_id long, text string, score string").repartition(n), table, rows=120, size=30_000).score(probe) for r, n in ((rows, 3), (shuffled, 7)))
    assert (one == other).all()


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you are an idiot, you moron, you are worthless scum"), (2, "a fine day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in X.score(docs, none).collect()}
    assert got[1] > got[2]
    assert X.score(docs.limit(0), none).collect() == []
