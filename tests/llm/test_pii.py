import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq

from tonearm.llm import pii as P


def plain(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "phone": lambda: 10 <= len(d) <= 15,
                "card": lambda: 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0,
            }[kind]()
            if ok:
                out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_as_the_patterns():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.", "@", "@", "1", "23", ".", "-", " ", "+", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "10.0.0.255", "%_", "@x.y"]) for _ in range(r.randint(0, 25)))
        assert P.base_spans(t) == plain(t), t


def segmentations(n):
    """All ways to cut n tokens into segments of each type."""
    if n == 0:
        yield []
        return
    for i in range(max(0, n - P.LONGEST), n):
        for rest in segmentations(i):
            for t in range(len(P.TYPES)):
                if t or n - i == 1:
                    yield [*rest, (i, n, t)]


def value(field, text, tokens, segments):
    total, last = 0.0, 0
    for i, j, t in segments:
        total += field.scores(text, tokens, i, j)[t] + field.follow[last][t]
        last = t
    return total


def some_field(data, seed):
    likelihood, r = P.Likelihood(data), np.random.default_rng(seed)
    return likelihood, r.normal(size=(len(likelihood.names), len(P.TYPES))), r.normal(size=(len(P.TYPES), len(P.TYPES)))


def short(count, seed, most=5):
    for text, spans in P.sentences(count, seed):
        end = ([m.end() for m in P.TOKEN.finditer(text)][:most] or [0])[-1]
        yield text[:end], [s for s in spans if s[1] <= end]


def test_best_segmentation_is_the_best():
    data = list(short(12, 5))
    likelihood, weights, follow = some_field(data, 3)
    field = P.Field({n: weights[i].tolist() for n, i in likelihood.names.items()}, follow.tolist())
    for text, _ in data:
        tokens = [m.span() for m in P.TOKEN.finditer(text)]
        got, at, full = field.best(text, tokens), 0, []
        for i, j, kind in [*got, (len(tokens), len(tokens), "")]:
            full += [(x, x + 1, 0) for x in range(at, i)] + [(i, j, P.TYPES.index(kind))] * (j > i)
            at = j
        assert abs(value(field, text, tokens, full) - max(value(field, text, tokens, x) for x in segmentations(len(tokens)))) < 1e-9


def test_likelihood_sums_over_all_segmentations_and_its_gradient_fits():
    data = list(short(6, 9, 4))
    likelihood, weights, follow = some_field(data, 4)
    field = P.Field({n: weights[i].tolist() for n, i in likelihood.names.items()}, follow.tolist())
    want = 0.0
    for text, spans in data:
        tokens = [m.span() for m in P.TOKEN.finditer(text)]
        gold = [(i, j, P.TYPES.index(k)) for i, j, k in P.gold_segments(text, tokens, spans)]
        want += value(field, text, tokens, gold) - np.logaddexp.reduce([value(field, text, tokens, x) for x in segmentations(len(tokens))])
    got, by_weight, by_pair = likelihood(weights, follow)
    assert abs(got - want) < 1e-8
    r = np.random.default_rng(1)
    for _ in range(20):
        i, t, p, q = r.integers(len(weights)), *r.integers(len(P.TYPES), size=3)
        for x, grad, at in ((weights, by_weight, (i, t)), (follow, by_pair, (p, q))):
            x[at] += 1e-5
            up = likelihood(weights, follow)[0]
            x[at] -= 2e-5
            down = likelihood(weights, follow)[0]
            x[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_field_finds_held_out_spans():
    field, right, found, true = P.trained(), 0, 0, 0
    for text, spans in P.sentences(300, 77):
        got = set(field.spans(text))
        right, found, true = right + len(got & set(spans)), found + len(got), true + len(spans)
    assert right / found > 0.9 and right / true > 0.9, (right, found, true)


# Written by hand, in other forms than the made sentences; spans are marked by <kind ...>.
BY_HAND = [
    "Please ring our office on tel <phone (030) 555-1234> before noon.", "You can reach her at <email maria.lopez@uni-bonn.de>, she answers quickly.",
    "The crawler came from <ip 192.168.0.17> and asked for 400 pages.", "Ihre Karte <card 4111 1111 1111 1111> wurde belastet.",
    "export API_KEY=<secret 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b>", "Escribe a <email jose at ejemplo dot com> para saber más.",
    "password: <secret 5f4dcc3b5aa765d61d8327deb882cf99>", "Téléphone : <phone +33 1 42 68 53 00>, fermé le lundi.",
    "Invoice 2024-11-03 over 1,250.00 euros, item 88341.", "Version 4.2.1 was built on 12 servers in 36 minutes.", "On page 314 the dot marks the year 1592.", "Look at chapter 12, at the end.",
]


def test_hand_written_sentences():
    field, right, found, true = P.trained(), 0, 0, 0
    for line in BY_HAND:
        text, spans, at = "", set(), 0
        for m in re.finditer(r"<(\w+) ([^>]*)>", line):
            text += line[at : m.start()]
            spans.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = set(P.all_spans(text, field)[1])
        right, found, true = right + len(got & spans), found + len(got), true + len(spans)
    assert right / true >= 0.85 and right / found >= 0.85, (right, found, true)


def test_secrets_of_the_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    field, hit, n = P.trained(), 0, 0
    for t in filter(None, texts):
        planted = [(m.start(1), m.end(1), "secret") for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
        if planted:
            every = set(P.all_spans(t, field)[1])
            hit, n = hit + sum(s in every for s in planted), n + len(planted)
    assert n > 5 and hit / n >= 0.9


def test_long_runs_give_each_span_once():
    field = P.trained()
    for piece, kind in (("tel (030) 555-1234 ", "phone"), ("token " + "ab12" * 10 + " ", "secret"), ("4111 1111 1111 1112 ", "card")):
        spans = P.all_spans(piece * 80, field)[1]
        assert len(spans) == len(set(spans)) == 80 and all(k == kind for *_, k in spans)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))


def test_any_text_is_taken():
    r, field = random.Random(2), P.trained()
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isdigit()]
    some = [".", "@", " ", "-", "+", "(", ")", "1", "25", "at", " dot ", "\n", "\x00", "token", "é", "\U0001f600"]
    for text in ("v 1.2.3.²", "ip ².1.1.1 x 5", "".join(odd), " ".join(odd), ".".join(odd)):
        P.all_spans(text, field)
    for _ in range(1500):
        text = "".join(r.choice(odd) if r.random() < 0.2 else r.choice(some) if r.random() < 0.8 else chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(0, 30)))
        base, every = P.all_spans(text, field)
        assert set(base) <= set(every) and all(0 <= a < b <= len(text) for a, b, _ in every)
        added = sorted(set(every) - set(base))
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(added))
        assert not any(a < y and x < b for a, b, _ in added for x, y, _ in base)


def test_query_rows(spark):
    rows = [(1, "mail a.b@c.org, ip 10.0.0.1 and card 4111 1111 1111 1111, tel (030) 555-1234 x"), (2, None), (3, ""), (4, "é 'token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\" x"), (4, "x" * 200_000), (None, "+49 30 1234567")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(P.find(docs).collect(), key=str)
    assert len(got) == len(rows)
    for x in got:
        texts = [t or "" for i, t in rows if i == x.doc_id]
        assert any(x.base_sha256 == hashlib.sha256(P.joined(plain(t)).encode()).hexdigest() for t in texts)
    by = {x.doc_id: x for x in got if x.doc_id != 4}
    assert (by[1].n_email, by[1].n_ip, by[1].n_card, by[1].n_phone) == (1, 1, 1, 0)
    assert any("secret:" in x.spans for x in got if x.doc_id == 4)
    assert by[2].spans == by[3].spans == ""
    clean = P.mask(docs, "text")
    assert clean.columns == docs.columns
    texts = {x.doc_id: x.text for x in clean.collect() if x.doc_id != 4}
    assert texts[1].startswith("mail [EMAIL], ip [IP] and card [CARD]") and texts[2] is None and texts[None] == "[PHONE]"
    assert P.find(docs.limit(0)).collect() == []
