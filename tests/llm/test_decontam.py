import random
import re

import pytest

from tonearm.llm import decontam as D

ITEM = "A train leaves the old station in Paris with 120 people, and after 3 hours it has travelled 450 km to Lyon; how fast did the train go on its way from Paris?"
MOVED = ITEM.replace("Paris", "Berlin").replace("120", "77").replace("450", "512").replace("Lyon", "Wien").replace("3 hours", "5 hours")
MIXED = ITEM.replace("in Paris", "in Berlin").replace("120", "9")  # Paris stands for two names


def plain(text):
    """Template tokens and values, a second way."""
    tokens, end, stop = [], 0, True
    for m in re.finditer(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text):
        gap, word = text[end : m.start()], m[0]
        first = stop or any(c in ".!?:\n|" for c in gap)
        if word[0].isdigit() and word[0].isascii():
            kind = "<number>"
        elif not first and tokens and tokens[-1][0] == "<number>" and word.lower() in D.UNITS:
            kind = "<unit>"
        elif not first and "A" <= word[0] <= "Z":
            kind = "<name>"
        else:
            kind = "".join(c.lower() if c.isascii() else c for c in word)
        tokens.append((kind, "".join(c.lower() if c.isascii() else c for c in word)))
        end, stop = m.end(), False
    return tokens


def brute(texts, items, size=8, literals=4, coverage=0.5, consistent=0.8):
    def windows(t):
        x = plain(t)
        out = {}
        for i in range(len(x) - size + 1):
            w = x[i : i + size]
            if sum(k[0] != "<" for k, _ in w) >= literals:
                out[i] = (tuple(k for k, _ in w), [v for k, v in w if k[0] == "<"])
        return out

    result = {}
    for d, t in texts.items():
        mine, hits = windows(t), []
        for n, it in items.items():
            theirs = windows(it)
            for shift in {i - j for i in mine for j in theirs if mine[i][0] == theirs[j][0]}:
                at = [j for j in theirs if j + shift in mine and mine[j + shift][0] == theirs[j][0]]
                pairs = {}
                for j in at:
                    for a, b in zip(theirs[j][1], mine[j + shift][1]):
                        pairs.setdefault(a, set()).add(b)
                agree = sum(len(v) == 1 for v in pairs.values()) / len(pairs) if pairs else 1
                if len(at) >= coverage * len(theirs) and agree >= consistent:
                    hits.append(n)
        result[d] = sorted(set(hits))
    return result


def test_template_as_the_plain_way():
    import numpy as np

    for t in [ITEM, MOVED, "Été 3.5 kg, 1,200 m. The End The 5 Mi", "5", "", "a.b 7..8 9, x"]:
        data = np.frombuffer(t.encode(), np.uint8)
        tokens, _, _ = D.template(data, np.array([0, len(data)]))
        kinds = [{int(D.NUMBER): "<number>", int(D.NAME): "<name>", int(D.UNIT): "<unit>"}.get(int(x), "word") for x in tokens]
        assert kinds == [k if k[0] == "<" else "word" for k, _ in plain(t)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["the", "train", "of", "Paris", "12", "km", "and", "runs", "fast", "to", "Rome", "3.5", "old", "Dr"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    items = {0: ITEM, 1: text(20), 2: text(15), 3: "too short", 4: ""}
    texts = {i: text(30) for i in range(20)}
    texts |= {50: text(10) + " " + ITEM + " " + text(5), 51: MOVED, 52: MIXED, 53: ITEM[:40], 54: items[1] + " and " + items[2], 55: "", 56: ITEM[: len(ITEM) * 3 // 4]}
    docs = spark.createDataFrame([(i, t, 0) for i, t in [*texts.items(), (57, None), (57, None)]], "doc_id long, text string, items int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {x.doc_id: x.items for x in D.decontaminate(docs, bench).collect()}
    assert got == brute(texts, items) | {57: []}
    assert got[50] and got[51] and not got[53]
    rows = {x.doc_id: x for x in D.decontaminate(docs, bench).collect()}
    assert rows[51].reworded and not rows[50].reworded
    left = [x.doc_id for x in D.clean(docs, bench).collect()]
    assert sorted(left) == sorted(i for i in [*texts, 57, 57] if not got[i])


def test_without_a_filter_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, MOVED), (2, "something else that is long enough to have some windows at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    monkeypatch.setattr(D, "BITMAP", 64)  # a bitmap that lets nearly all windows pass
    assert {x.doc_id: x.items for x in D.decontaminate(docs, bench).collect()} == {1: [5], 2: []}
    assert D.decontaminate(docs.limit(0), bench).collect() == []
    assert [x.contaminated for x in D.decontaminate(docs, bench.limit(0)).collect()] == [False, False]


EDITED = "a man who lives far from the old town of Paris wants to see the sea and the hills today"  # 20 tokens, the name amid


def test_names_of_other_lengths_and_an_inserted_word(spark):
    texts = {
        1: EDITED.replace("Paris", "New York"), 2: EDITED.replace("Paris", "Paris often"), 3: "we saw that " + EDITED.replace("Paris", "San Juan Bautista") + " as well",
        4: ITEM.replace("Paris", "New York").replace("450 km", "450"), 5: " ".join(EDITED.split()[:10]), 6: EDITED.replace("of Paris wants to see the", "near Rome where one can find a"),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, EDITED), (2, ITEM)], "item_id long, text string")
    rows = {x.doc_id: x for x in D.decontaminate(docs, bench).collect()}
    assert {k: x["items"] for k, x in rows.items()} == {1: [1], 2: [1], 3: [1], 4: [2], 5: [], 6: []}
    assert rows[1].reworded and rows[3].reworded and not rows[2].reworded
    assert all(x.coverage <= 1 for x in rows.values())
    assert not any(1 in v for v in brute(texts, {1: EDITED}).values())  # lost at one alignment of single names


def test_dense_and_short_items_and_a_first_word_inside_a_sentence(spark):
    items = {1: "Add 12 cm, 13 cm, 14 cm and 15 cm to 16 kg", 2: "How old is Anna Smith", 3: "Find the sum of all the odd numbers", 4: "Anna Smith and Paul Jones met Mary Brown", 5: "..."}
    texts = {
        10: "so " + items[1] + " now", 11: items[1].replace("12", "17").replace("16", "99").replace("14", "3"), 20: "we ask: how old is Anna Smith today", 21: "How old is Anna Jones",
        30: "we were told Find the sum of all the odd numbers", 40: "they say Anna Smith and Paul Jones met Mary Brown", 41: items[4], 50: "... nothing", 51: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {x.doc_id: x.items for x in D.decontaminate(docs, bench).collect()}
    assert got == {10: [1], 11: [], 20: [2], 21: [], 30: [3], 40: [4], 41: [4], 50: [], 51: []}
    assert not any(brute(texts, items)[d] for d in (10, 20, 30, 40, 41))  # lost by windows of enough literals alone
