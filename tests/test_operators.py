"""Operators against naive versions and on hand-made rows."""

import itertools
import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.operators import clustering as K
from tonearm.operators import evaluation as E
from tonearm.operators import grouping as G
from tonearm.operators import identity as I
from tonearm.operators import matching as X
from tonearm.operators import playlists as P
from tonearm.operators import ranking as R
from tonearm.operators import similarity as D
from tonearm.plans import registry
from tonearm.sources import files
from tonearm.sources import library as L


def fingerprints(spark, arrays):
    return spark.createDataFrame([(i, [int(x) for x in a]) for i, a in arrays.items()], "content_id long, fp array<long>")


def naive_alignment(a, b, bits=24):
    votes = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if int(x) >> (32 - bits) == int(y) >> (32 - bits):
                votes[i - j] = votes.get(i - j, 0) + 1
    best = max(votes.items(), key=lambda v: (v[1], -v[0]), default=(0, 0))
    return (best[0], best[1], sum(votes.values())) if best[1] > 1 else (0, 0, 0)


def test_alignment_and_evidence(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**32, 800)
    arrays = {1: base, 2: base[200:400], 3: r.integers(0, 2**32, 400), 4: base ^ (1 << r.integers(0, 8, 800)), 5: base[:30], 6: np.concatenate([r.integers(0, 2**32, 200), base[:200], r.integers(0, 2**32, 200)]), 7: base[:1]}
    fps = fingerprints(spark, arrays)
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(arrays, 2)], "a long, b long")
    got = {(x.a, x.b): x for x in X.compare(pairs, fps).collect()}
    assert len(got) == pairs.count()
    for (a, b), x in got.items():
        assert (x.best_offset, x.peak_votes) == naive_alignment(arrays[a], arrays[b])[:2]
    assert got[1, 2].tier == 2 and got[1, 2].coverage_b > 0.9 and got[1, 2].coverage_a < 0.4
    assert got[1, 3].tier == -1 and got[1, 3].matched_span_items == 0
    assert got[1, 4].tier == 1 and got[1, 4].mean_bit_error == pytest.approx(1.0)
    assert got[1, 5].coverage_b == 1.0 and got[1, 5].tier != 1  # too short
    assert 100 < got[1, 6].matched_span_items < 320
    assert got[1, 7].tier == -1


def test_bit_errors():
    assert X.bit_errors(np.array([9, 1, 2, 3]), np.array([1, 2, 3]), 1).tolist() == [0, 0, 0]
    assert X.bit_errors(np.array([1]), np.array([0, 2**32 - 1]), -1).tolist() == [31]
    assert X.bit_errors(np.array([1]), np.array([1]), 5).tolist() == [] and X.cut(np.zeros(0, int)) == []


def naive_smooth(x, sigma):
    far = round(4 * sigma)
    share = [math.exp(-k * k / 2 / sigma**2) for k in range(-far, far + 1)]
    padded = [x[0]] * far + list(x) + [x[-1]] * far
    return [sum(w * v for w, v in zip(share, padded[i : i + 2 * far + 1], strict=True)) / sum(share) for i in range(len(x))]


def naive_cut(x, config):
    """By the definition, a place at a time."""
    n = len(x)
    if not n:
        return []
    s = [round(v, 9) for v in naive_smooth(x, config.sigma)]
    if n > 1:
        g = [s[1] - s[0]] + [(s[i + 1] - s[i - 1]) / 2 for i in range(1, n - 1)] + [s[-1] - s[-2]]
    g = [round(abs(v), 9) for v in g] if n > 1 else [0]
    peaks = [i for i in range(1, n - 1) if g[i] > config.gradient_peak and g[i] >= g[i - 1] and g[i] >= g[i + 1]]
    places = []
    for p in peaks:
        if not places or p - places[-1] > 1:
            places.append(p)
    out = []
    for a, b in zip([0, *places], [*places, n], strict=True):
        mean = sum(x[a:b]) / (b - a)
        if mean >= config.match_threshold:
            continue
        if out and out[-1][0] + out[-1][1] == a and abs(out[-1][2] / out[-1][1] - mean) < config.merge_delta:
            start, length, total = out.pop()
            out.append((start, length + b - a, total + sum(x[a:b])))
        else:
            out.append((a, b - a, sum(x[a:b])))
    return [(a, n, pytest.approx(t / n)) for a, n, t in out]


def test_cut_by_its_definition():
    r = np.random.default_rng(8)
    assert X.smooth(np.array([5, 1, 9]), 8.0) == pytest.approx(naive_smooth([5, 1, 9], 8.0))
    assert X.smooth(np.zeros(0), 8.0).tolist() == []
    for _ in range(60):
        levels = [(int(r.integers(1, 90)), float(r.choice([0, 0, 1, 3, 8, 9.5, 15]))) for _ in range(r.integers(1, 8))]
        x = np.concatenate([r.binomial(32, m / 32, n) for n, m in levels])
        assert X.cut(x) == naive_cut(x.tolist(), X.DEFAULT)
        close = X.DEFAULT.with_(sigma=1.0, gradient_peak=0.0, merge_delta=1.5)
        assert X.cut(x, close) == naive_cut(x.tolist(), close)


def test_votes_of_repeated_items():
    r = np.random.default_rng(5)
    for _ in range(30):
        a, b = (r.integers(0, 4, r.integers(0, 60)) << 28 for _ in range(2))
        want = {}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x == y:
                    want[i - j] = want.get(i - j, 0) + 1
        for piece in (1, 20, 1 << 20):  # all by convolution, some, none
            low, votes = X.histogram(a, b, 4, piece)
            assert {i + low: int(v) for i, v in enumerate(votes) if v} == want
        assert X.align(a, b, 4)[:2] == naive_alignment(a, b, 4)[:2]


def test_candidates(spark):
    r = np.random.default_rng(1)
    arrays = {i: r.integers(0, 2**32, 100) for i in range(60)}
    arrays[99] = arrays[7] ^ 1
    got = X.candidates(X.postings(fingerprints(spark, arrays))).collect()
    assert [(x.a, x.b) for x in got] == [(7, 99)]
    same = X.first_positions(spark.createDataFrame([(1, 5, i) for i in range(10)], "content_id long, key long, pos int"), 2)
    assert sorted(x.pos for x in same.collect()) == [0, 1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 150)], "a long, b long")
    assert {tuple(x) for x in G.components(edges).collect()} == {(i, 0) for i in range(71)} | {(150, 150), (200, 150)}


def test_cliques_and_chains(spark):
    tiers = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (10, 11, 1), (11, 12, 1), (10, 12, 2)], "a long, b long, tier int")
    tracks = spark.createDataFrame([(i, i // 2, True) for i in range(2, 40)] + [(100, 1, False)], "id long, content_id long, present boolean")
    got = {}
    for x in G.build_groups(tiers, tracks).collect():
        got.setdefault((x.tier, x.formed_by_chain, x.group_id), set()).add(x.content_id)
    assert got[1, False, 1] == {1, 2, 3} and got[2, True, 10] == {10, 11, 12}
    assert (0, False, 10) in got and (0, False, 2) not in got  # a chain doesn't hide identical files, a clique does


def test_pairs_without_evidence_are_verified(spark):
    # 1-2-3 and 11-12-13 lack a pair each; 21-22-23 are known whole; 31-32-33 have a known pair of tier 2, so nothing is asked
    known = [(1, 2, 1), (2, 3, 1), (11, 12, 1), (12, 13, 1), (21, 22, 1), (22, 23, 1), (21, 23, 1), (31, 32, 1), (32, 33, 1), (31, 33, 2), (1, 21, -1)]
    tiers = spark.createDataFrame(known, "a long, b long, tier int")
    tracks = spark.createDataFrame([], "id long, content_id long, present boolean")
    asked = []

    def verify(pairs):
        asked.extend(sorted((x.a, x.b) for x in pairs.collect()))
        return pairs.withColumn("tier", F.when(F.col("a") == 1, 1).otherwise(2))

    got = {(x.group_id, x.tier, x.formed_by_chain) for x in G.build_groups(tiers, tracks, verify).collect()}
    assert got == {(1, 1, False), (11, 2, True), (21, 1, False), (31, 2, True)} and asked == [(1, 3), (11, 13)]
    alone = {(x.group_id, x.tier) for x in G.build_groups(tiers, tracks).collect()}
    assert alone == {(1, 2), (11, 2), (21, 1), (31, 2)}


def test_keeper(spark):
    schema = "group_id long, id long, path string, bitrate long, tag_completeness int, duration double, mtime double, dev long, inode long, cutoff_hz double, cliff_db double"
    rows = [
        (1, 1, "/a.mp3", 320, 4, 10.0, 5.0, 1, 1, 16000.0, 20.0), (1, 2, "/b.mp3", 128, 4, 10.0, 5.0, 1, 2, 20000.0, 20.0),  # the wider one wins against bit rate
        (2, 3, "/a.mp3", 320, 1, 10.0, None, 1, 3, None, None), (2, 4, "/b.flac", None, 1, 10.0, 1.0, 1, 4, 9000.0, 20.0), (2, 5, "/c.flac", None, 1, 10.0, 1.0, 1, 4, 9000.0, 20.0),  # same file as 4
        (3, 6, "/x.mp3", 1, 1, 1.0, 1.0, None, None, 9000.0, 1.0),
    ]
    got = {x.id: x.is_keeper for x in R.ranked(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_scan_merge_and_pending(spark):
    before = spark.createDataFrame([("/a/1", 1, 1.0, 9), ("/a/2", 1, None, 9), ("/b/3", 1, 1.0, 9), ("/a/4", 1, 1.0, None)], "path string, size long, mtime double, content_id long")
    now = spark.createDataFrame([("/a/1", 1, 1.0), ("/a/2", 1, None), ("/a/4", 1, 1.0), ("/a/5", 3, 1.0)], "path string, size long, mtime double")
    assert {x.path: x.state for x in I.merge_scan(before, now, ["/a"]).collect()} == {"/a/1": "unchanged", "/a/2": "unchanged", "/b/3": "untouched", "/a/4": "changed", "/a/5": "new"}
    tracks = spark.createDataFrame([(2, 1, "/b", True), (1, 1, "/c", True), (3, 2, "/d", False), (4, 5, "/e", True)], "id long, content_id long, path string, present boolean")
    done = spark.createDataFrame([(5,)], "content_id long")
    assert [tuple(x) for x in I.pending(tracks, done).collect()] == [(1, 1, "/c")]
    assert [tuple(x) for x in I.pending(tracks, done, by_path=True).collect()] == [(1, 2, "/b")]


def test_normal_distribution(spark):
    xs = [-9.0, -3.0, -0.5, 0.0, 0.7, 2.5, 6.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-14)


def test_nearest_in_blocks(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((70, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "content_id long, vector array<double>")
    got = {}
    for n in D.nearest(rows, 5, blocks=5).collect():
        got.setdefault(n.i, {})[n.place] = n.j
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    for i in range(70):
        assert [got[i][p] for p in range(1, 6)] == np.argsort(d[i], kind="stable")[:5].tolist()
    moments = {m.i: (m.mean, m.sd) for m in D.row_moments(rows, blocks=5).collect()}
    for i in (0, 33):
        others = np.delete(d[i], i)
        assert moments[i] == pytest.approx((others.mean(), others.std()), abs=1e-7)


def test_incremental_lists_keep_old_rows_on_ties(spark):
    old = spark.createDataFrame([(1, 9, 0.5), (1, 8, 0.2)], "track_id long, neighbor_id long, combined_score double")
    new = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1)], "track_id long, neighbor_id long, combined_score double")
    assert [x.neighbor_id for x in D.merge_top_k(old, new, 3).orderBy("place").collect()] == [3, 8, 9]


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(2)
    for n in (1, 3, 6):
        cost = r.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(cost[i, j] for i, j in enumerate(K.assignment(cost))) == pytest.approx(best)


def test_spectral_finds_blocks():
    a = np.full((60, 60), 0.01)
    for s in (slice(0, 20), slice(20, 45), slice(45, 60)):
        a[s, s] = 1.0
    labels = K.spectral_labels(a, 3)
    assert len(set(labels[:20])) == len(set(labels[20:45])) == len(set(labels[45:])) == 1 and len(set(labels)) == 3
    assert (K.spectral_labels(a, 3) == labels).all() and K.eigengap(a) == 3


def test_walk():
    edges = {1: [(2, 0.1), (3, 0.2)], 3: [(4, 0.1), (1, 0.0)]}
    artist = {1: "a", 2: "a", 3: "b", 4: None, 5: "c", 6: "d"}
    assert P.walk(1, edges, artist, {}, 3) == [1, 3, 4]  # 2 has the artist of 1
    assert P.walk(1, edges, artist, {1: {3}}, 2) == [1, 2]
    full = P.walk(1, edges, artist, {}, 50)
    assert sorted(full) == [1, 2, 3, 4, 5, 6] and full == P.walk(1, edges, artist, {}, 50)


def test_cutoff_of_filtered_noise():
    r = np.random.default_rng(1)
    spectrum = np.fft.rfft(r.standard_normal(files.FRAME * 8))
    hz = np.fft.rfftfreq(files.FRAME * 8, 1 / files.RATE)
    assert files.cutoff(np.fft.irfft(spectrum))[0] is None and files.cutoff(np.zeros(files.FRAME)) == (None, None)
    spectrum[hz > 16_000] *= 1e-4
    at, fall = files.cutoff(np.fft.irfft(spectrum))
    assert abs(at - 16_000) <= 1000 and fall > 30


def test_percentile_rank_and_auc(spark):
    r = random.Random(1)
    rows = [(i, i + 1, round(r.random(), 2)) for i in range(200)]
    got = {(x.i, x.j): x["rank"] for x in E.percentile_rank(spark.createDataFrame(rows, "i long, j long, d double"), "d").collect()}
    for place, (i, j, _) in enumerate(sorted(rows, key=lambda x: (x[2], x[0], x[1]))):
        assert got[i, j] == pytest.approx(place / 199)


def test_stream_keeps_the_latest(spark, tmp_path):
    from tonearm.streaming.ingest import ingest

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = spark.createDataFrame([], "path string, size long, seen long").schema
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest(spark, source, schema, table, str(tmp_path / "ck"), ["path"], "seen").awaitTermination()
    write([("/a", 1, 1), ("/b", 1, 1), ("/a", 2, 2)])
    run()
    write([("/b", 5, 0), ("/c", 1, 3), ("/a", 9, 4)])
    run()
    assert {tuple(x) for x in files.read_table(spark, table).collect()} == {("/a", 9, 4), ("/b", 1, 1), ("/c", 1, 3)}


def test_a_table_survives_a_crash_at_any_moment(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(i, n) for i in range(5)], "id long, n long")
    path = str(tmp_path / "table")
    read = lambda: {x.n for x in files.read_table(spark, path).collect()}
    assert files.read_table(spark, path) is None
    files.replace_table(rows(1), path)
    # a crash after the new version's files, before the pointer; and one with a pointer half made
    rows(2).write.parquet(f"{path}/version-crashed")
    (tmp_path / "table" / "CURRENT-version-crashed").write_text("version-crashed")
    assert read() == {1}
    old = files.read_table(spark, path)
    files.replace_table(rows(3), path)
    assert read() == {3} and {x.n for x in old.collect()} == {1}  # a reader of the version before goes on
    files.replace_table(rows(4), path)
    assert read() == {4} and len([x for x in (tmp_path / "table").iterdir() if x.name.startswith("version-")]) == 2
    # what the pointer names is not there: an error, not an empty table
    (tmp_path / "table" / "CURRENT").write_text("version-nowhere")
    (tmp_path / "table" / ".CURRENT.crc").unlink()
    with pytest.raises(Exception, match="version-nowhere"):
        files.read_table(spark, path).collect()


def test_moves_and_back(spark):
    listing = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime double")
    plan = spark.createDataFrame([(1, "/a", 5, 1.0), (2, "/b", 5, None), (3, "/c", 5, 1.0), (4, "/d", 5, 1.0)], "id long, path string, size long, mtime double")
    log = G.apply_moves(plan, listing([("/a", 5, 1.0), ("/b", 5, None), ("/c", 6, 1.0)]))
    assert {x.id: x.state for x in log.collect()} == {1: "moved", 2: "moved", 3: "skipped", 4: "gone"}
    assert {x.id: x.state for x in G.undo_moves(log, listing([("/a", 9, 9.0), ("/c", 6, 1.0)])).collect()} == {1: "occupied", 2: "restored"}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """430 contents, and the vectors of all of them."""
    d, r = tmp_path_factory.mktemp("library"), np.random.default_rng(8)
    x = r.standard_normal((430, 6)).round(3)
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d), x


def test_queries_without_sql_read_all_vectors(spark, library):
    from tonearm.plans import registry

    path, x = library
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (1 - u @ u.T).round(9)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    want = {i: min((round(0.7 * d[i, j] - 0.3 * d[near[i, 0], j], 9), j) for j in near[i, 1:])[1] for i in range(430)}
    run = lambda name: registry.queries()[name](spark, path)
    assert {r.i: r.chosen for r in run("ev_playlist_mmr").collect()} == want
    assert run("sim_build_embedding").select("track_id").distinct().count() == 430
    assert {r.content_id for r in run("cls_spectral").collect()} == set(range(430))


def test_index_by_mutual_proximity_over_all_others(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((60, 24)), 0.05 * r.standard_normal((10, 24))]) + 1.0  # the last ten are hubs
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "content_id long, vector array<double>")
    got = {}
    for n in D.embedding_index(rows, 2, blocks=5).collect():
        got.setdefault(n.track_id, {})[n.place] = (n.neighbor_id, n.combined_score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (1 - u @ u.T).round(9)
    others = ~np.eye(70, dtype=bool)
    mean, sd = (np.array([f(d[i][others[i]]) for i in range(70)]) for f in (np.mean, np.std))
    above = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)))((d - mean[:, None]) / sd[:, None])
    mp = np.where(others, 1 - above * above.T, np.inf)
    order = np.argsort(mp, axis=1, kind="stable")[:, :2]
    near = np.argsort(np.where(others, d, np.inf), axis=1, kind="stable")[:, :8]
    pool = {(i, j) for i in range(70) for j in near[i].tolist()}
    assert any((i, j) not in pool and (j, i) not in pool for i in range(70) for j in order[i].tolist())  # lost by a pool of four times as many
    for i in range(70):
        assert [got[i][p][0] for p in (1, 2)] == order[i].tolist()
        assert [got[i][p][1] for p in (1, 2)] == pytest.approx(mp[i, order[i]].tolist(), abs=1e-7)


def test_whole_fingerprints_are_smoothed(spark):
    from tonearm.plans import registry
    from tonearm.sources.library import Library

    data = "/root/testdata/sf0.001"
    fps = {r.content_id: r.fp for r in Library(spark, data).fingerprint.collect()}
    assert max(map(len, fps.values())) > 200
    got = {r.content_id: r.total for r in registry.queries()["fp_smooth"](spark, data).collect()}
    assert got == {i: pytest.approx(X.smooth(np.asarray(x, float) % 32, 8.0).sum(), abs=1e-5) for i, x in fps.items()}


def test_stability_is_over_all_pairs_of_four_samples(spark, monkeypatch):
    from tonearm.plans import registry

    seeds = []

    def fake(matrix, k, seed):
        seeds.append(seed)
        return matrix.select("content_id", (F.col("content_id") % (seed + 2)).cast("int").alias("cluster_id"))

    monkeypatch.setattr(K, "kmeans", fake)
    data = "/root/testdata/sf0.001"
    got = registry.queries()["ev_stability"](spark, data).collect()[0].stability
    from tonearm.sources.library import Library

    lib = Library(spark, data)
    sample = [F.pmod(F.xxhash64("content_id", F.lit(i)), F.lit(10)) < 8 for i in range(4)]
    rows = [tuple(r) for r in K.feature_matrix(lib.features, lib.embedding).select("content_id", *sample).collect()]
    pairs, values = lambda xs: sum(n * (n - 1) / 2 for n in xs), []
    for i, j in itertools.combinations(range(4), 2):
        ids = [r[0] for r in rows if r[1 + i] and r[1 + j]]
        count = lambda f: pairs(np.unique([f(x) for x in ids], return_counts=True)[1].tolist())  # noqa: B023, E731
        both, a, b = count(lambda x: x % (i + 2) * 10 + x % (j + 2)), count(lambda x: x % (i + 2)), count(lambda x: x % (j + 2))  # noqa: B023
        expected = a * b / pairs([len(ids)])
        values.append((both - expected) / ((a + b) / 2 - expected))
    assert seeds == [0, 1, 2, 3] and got == pytest.approx(np.mean(values), abs=1e-6)


def test_index_by_components_over_all_others(spark):
    r = np.random.default_rng(6)
    pick = lambda *x: x[r.integers(len(x))]
    rows = [(i, r.standard_normal(13).tolist() if i % 9 else [0.0] * 13, pick(None, 0.0, 90.0, 128.5), pick(None, "", "C", "Db", "F#", "H"), pick(None, "minor", "major"), pick(None, 0.2, 0.9)) for i in range(60)]
    table = spark.createDataFrame(rows, "content_id long, mfcc array<double>, bpm double, key_name string, scale string, energy double")
    parts = D.components(bpm_scale=F.lit(25.0))
    every = D.paired(table, F.lit(True), blocks=4).select(F.col("a_content_id").alias("i"), F.col("b_content_id").alias("j"), F.round(parts["combined_score"], 6).alias("s")).collect()
    assert len(every) == 60 * 59
    want = {}
    for x in sorted(every, key=lambda x: (x.i, x.s, x.j)):
        want.setdefault(x.i, []).append((x.j, pytest.approx(x.s, abs=1e-6)))
    got = {}
    for x in sorted(D.score_index(table, 7, 25.0, blocks=4).collect(), key=lambda x: (x.track_id, x.place)):
        got.setdefault(x.track_id, []).append((x.neighbor_id, x.combined_score))
    assert got == {i: x[:7] for i, x in want.items()}


def test_ranks_and_apart(spark):
    r = np.random.default_rng(7)
    x = r.integers(-1, 2, (40, 4)).astype(float)  # many ties
    x[x.sum(1) == 0] += 1
    table = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "content_id long, vector array<double>, artist long")
    d = {(q.i, q.j): q.d for q in D.distances(table, blocks=3).collect()}
    assert len(d) == 40 * 39
    order = {i: sorted((d[i, j], j) for j in range(40) if j != i) for i in range(40)}
    known = [(i, j) for i in range(0, 40, 3) for j in (1, 7, 39) if i != j]
    got = {(q.i, q.j): q.place for q in D.ranks(table, spark.createDataFrame(known, "i long, j long"), blocks=3).collect()}
    assert got == {(i, j): 1 + order[i].index((d[i, j], j)) for i, j in known}
    near = {}
    for q in sorted(D.nearest(table, 4, apart="artist", blocks=3).collect(), key=lambda q: (q.i, q.place)):
        near.setdefault(q.i, []).append(q.j)
    assert near == {i: [j for _, j in order[i] if j % 5 != i % 5][:4] for i in range(40)}


def naive_linkage(x, k, method):
    """Clusters merged by the definition of their distance."""
    groups = [[i] for i in range(len(x))]

    def apart(a, b):
        d = [math.dist(x[i], x[j]) for i in a for j in b]
        if method == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * math.dist(x[a].mean(0), x[b].mean(0)) ** 2
        return max(d) if method == "complete" else sum(d) / len(d)

    while len(groups) > k:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: apart(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkages_by_their_definition():
    r = np.random.default_rng(3)
    for _ in range(6):
        x = r.standard_normal((24, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for method in ("ward", "average", "complete"):
            labels = K.linkage_labels(d, 4, method)
            assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(4)} == naive_linkage(x, 4, method)


def test_few_pairs_are_scored_for_the_index(monkeypatch):
    r = np.random.default_rng(6)
    scored = []
    cdf = D._normal_cdf
    monkeypatch.setattr(D, "_normal_cdf", lambda x: scored.append(x.size) or cdf(x))
    for x in (np.concatenate([r.standard_normal((700, 24)), 0.05 * r.standard_normal((30, 24))]) + 1.0, np.repeat(r.standard_normal((80, 8)), 9, axis=0), r.standard_normal((30, 3))):
        rows = pd.DataFrame({"content_id": np.arange(len(x)) * 2, "vector": list(x)})
        d = D.cosine_block(rows, rows)
        mean, sd = rows["mean"], rows["sd"] = d.mean(1), d.std(1)
        z = lambda c: 1 - cdf((d - mean.reshape(c)) / sd.reshape(c))
        mp = (1 - z((-1, 1)) * z((1, -1))).round(9)
        np.fill_diagonal(mp, np.inf)
        order = np.argsort(mp, axis=1, kind="stable")[:, :10]
        scored.clear()
        got = D.proximity_best(rows.iloc[:300], rows, 10)
        assert got["j"].tolist() == (2 * order[:300]).ravel()[np.isfinite(np.take_along_axis(mp, order, 1)[:300]).ravel()].tolist()
        assert got["mp"].tolist() == np.take_along_axis(mp, order, 1)[:300].ravel().tolist()
        if len(x) > 700:
            assert sum(scored) < 300 * len(x)  # 600 * len(x) before


def test_walks_make_the_index_once(spark, tmp_path, monkeypatch):
    from tonearm.plans import discovery
    from tonearm.sources.library import Library

    calls = spark.sparkContext.accumulator(0)
    made = D.embedding_index

    def counted(rows, k):
        def seen(batches):
            calls.add(1)
            yield from batches

        return made(rows, k).coalesce(1).mapInArrow(seen, "track_id long, neighbor_id long, raw double, combined_score double, place int")

    monkeypatch.setattr(D, "embedding_index", counted)
    assert discovery.walks(Library(spark, "/root/testdata/sf0.001"), 5).count()
    assert calls.value == 1


def test_order_of_spare_tracks_is_sorted_as_far_as_asked():
    ids = np.arange(0, 30_000, 3)
    x = (ids.astype(np.uint64) + np.uint64(5 * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    want = ids[np.argsort(x * np.uint64(0xBF58476D1CE4E5B9), kind="stable")].tolist()
    for first in (1, 256, 10**6):
        assert list(P.fallback_order(5, ids, first)) == want
    began, artist = time.process_time(), dict.fromkeys(range(200_000))
    for seed in range(200):  # over 10 s when each walk sorted all ids
        P.walk(seed, {}, artist, {}, 15, np.arange(200_000))
    assert time.process_time() - began < 8


def test_transitions_in_arrays():
    a = [np.array(c) for c in ([5, 2, 5, 9], [2, 1, 1, 3], [7, 5, 8, 2], [0.5, 0.25, 1.0, 2.0])]
    links = P.Links(*a)
    assert [list(links.get(t, ())) for t in (1, 2, 5, 9, 10)] == [[], [(5, 0.25)], [(8, 1.0), (7, 0.5)], [(2, 2.0)], []]
    assert list(P.Links(*[c[:0] for c in a]).get(5)) == []


def test_linkages_without_a_matrix(spark, monkeypatch):
    r = np.random.default_rng(5)
    for n in (2, 5, 60, 211):
        x = r.standard_normal((n, 3)) * (3, 1, 1)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for method, k, held in itertools.product(("ward", "average", "complete"), (1, 4), (1, 8 * n * 9, 10**7)):
            assert K.chain_labels(x, min(k, n), method, held).tolist() == K.linkage_labels(d, min(k, n), method).tolist()
    equal = np.repeat(r.integers(0, 3, (30, 3)).astype(float), 9, axis=0)  # many equal distances
    copies = equal + 100 * (np.arange(270) % 4 == 0)[:, None] + 700 * (np.arange(270) % 4 == 1)[:, None]
    for method in ("ward", "average", "complete"):
        groups = np.minimum(np.arange(270) % 4, 2)
        assert len({*zip(K.chain_labels(copies, 3, method, 10**4).tolist(), groups.tolist(), strict=True)}) == 3

    x = r.standard_normal((60, 3))
    rows = spark.createDataFrame([(i * 7 - 3, v) for i, v in enumerate(x.tolist())], "content_id long, x array<double>")
    want = sorted(map(tuple, K.linked(rows, 4).collect()))
    monkeypatch.setattr(K, "SPECTRAL_NODES", 40)  # a ValueError before
    assert sorted(map(tuple, K.linked(rows, 4).collect())) == want


def test_matched_is_what_candidates_finds(spark):
    r = np.random.default_rng(3)
    arrays = {int(i): r.integers(0, 900, r.integers(1, 260)) << 8 for i in r.choice(10**12, 70, replace=False)}
    arrays |= {-i - 1: np.concatenate([arrays[k], r.integers(0, 2**32, 5)]) for i, k in enumerate(list(arrays)[:8])}
    fps = fingerprints(spark, arrays)
    for config in (X.DEFAULT, X.DEFAULT.with_(k_cap=9, k_cap_floor=9)):
        want = {tuple(x) for x in X.candidates(X.postings(fps, config)).collect()}
        assert want
        for parts, split in ((None, None), (4, 3), (8, 1), (19, 2)):
            assert {tuple(x) for x in X.matched(fps, config, parts, split).collect()} == want


def test_sharing_is_what_candidates_finds(spark, monkeypatch):
    r = np.random.default_rng(8)
    arrays = {int(i): r.integers(0, 900, r.integers(1, 120)) << 8 for i in r.choice(10**12, 50, replace=False)}
    arrays |= {-i - 1: np.concatenate([arrays[k], r.integers(0, 2**32, 5)]) for i, k in enumerate(list(arrays)[:8])} | {3: np.array([], int), 4: np.array([2**32 - 1])}
    fps = fingerprints(spark, arrays).union(fingerprints(spark, dict(list(arrays.items())[:9])))  # some rows come twice
    monkeypatch.setattr(X, "STREAMED", 300)
    for config in (X.DEFAULT, X.DEFAULT.with_(k_cap=4, k_cap_floor=4)):
        want = sorted(map(tuple, X.candidates(X.postings(fps, config), 1).collect()))
        assert want
        for blocks in (None, 2, 5, 6):
            got = X.sharing(fps, config, blocks)
            assert sorted(map(tuple, got.collect())) == want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert X.sharing(fps.limit(0)).collect() == []


def test_jn_self_key_writes_no_row_for_each_shared_key(spark):
    plan = registry.queries()["jn_self_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "HashAggregate" not in plan


def test_fingerprints_are_sent_to_few_units(spark):
    sizes = spark.createDataFrame([(i, 1000) for i in range(40)], "content_id long, n int")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")  # 780 pairs of 40 contents
    rows = X._units(pairs, sizes, 20_000).collect()
    assert len({(x.u, c) for x in rows for c in (x.a, x.b)}) == 40  # one a content; two a pair would be 1560
    rows = X._units(pairs, sizes, 195).collect()
    assert len(rows) == 780 and len({x.u for x in rows}) > 1


def test_fingerprints_are_dealt_once(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**32, 60)
    fps = X.packed(fingerprints(spark, {i: np.concatenate([base[i:], r.integers(0, 2**32, 9)]) for i in range(12)}))
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "a long, b long")
    votes = X.offset_votes(pairs, fps)
    want = sorted(map(tuple, votes.collect()))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert want and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # before, all were also dealt by content
    monkeypatch.setattr(X, "FEW_WANTED", 0)
    assert sorted(map(tuple, X.offset_votes(pairs, fps).collect())) == want


def test_pairs_of_a_part_are_packed():
    a, b, n = np.array([-5, -5, 7]), np.array([2, 9, 8]), np.array([4, 300, 70_000])
    for far, size in ((0, 12), (2**40, 20)):
        base, data = X.packed_pairs(a, b + far, n)
        assert len(data) == 3 * size
        assert [x.tolist() for x in X.unpacked_pairs(base, data)] == [a.tolist(), (b + far).tolist(), n.tolist()]


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    texts = ["a b c d", "a b c", "a b c d", None, "x y", "", "a b c", "x  y\tz"]
    rows = [(i, x, "en", "web", len(x or "")) for i, x in zip((4, 2, 9, 5, 1, 0, 7, 7), texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for few in (10**6, 0):
        monkeypatch.setattr(L, "FEW_IDS", few)
        monkeypatch.setattr(L, "spread", lambda df: df)
        lib = L.Library(spark, str(tmp_path))
        got[few] = sorted((x.content_id, len(x.fp)) for x in lib.fingerprint.collect())
        plan = lib.fingerprint._jdf.queryExecution().executedPlan().toString()
        assert not few or "Exchange" not in plan.replace("BroadcastExchange", "")  # before, the texts were always dealt by id
    assert got[0] == got[10**6] == [(2, 1), (4, 2), (7, 1), (7, 1)]


def test_pairs_of_the_parts_are_added_up_packed(spark, monkeypatch):
    r = np.random.default_rng(11)
    a, part = r.integers(0, 9, 400) - 4, r.integers(0, 8, 400)
    rows = {(int(x), int(x) + d, int(p)): int(n) for x, p, d, n in zip(a, part, r.choice([1, 2, 2**40], 400), r.integers(2, 6, 400), strict=True)}
    blobs = [X.packed_pairs(*(np.array(c) for c in zip(*((*k[:2], n) for k, n in rows.items() if k[2] == p), strict=True))) for p in range(8)]
    found = spark.createDataFrame(blobs, "base long, pairs binary")
    want = set()
    for x in {k[:2] for k in rows}:
        said = [n for k, n in rows.items() if k[:2] == x]
        want |= {x} if sum(said) + 8 - len(said) >= 20 else set()
    assert want
    for heaps in (1, 5):
        dealt = found.mapInArrow(X.heaped(heaps), "heap int, base long, pairs binary")
        got = [tuple(x) for x in dealt.groupBy("heap").applyInArrow(X.added_up(20, 1, 8), "a long, b long").collect()]
        assert set(got) == want and len(got) == len(want)
    seen, settled = [], X.settled
    monkeypatch.setattr(X, "settled", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), settled(df))[1])
    X.matched(fingerprints(spark, {i: r.integers(0, 60, 50) << 8 for i in range(9)}))
    assert any("heap" in x for x in seen) and not any("sum(n" in x for x in seen[:3])  # before, each pair of a part was a row of the shuffle


def test_rare_keys_are_sent_in_place_of_fingerprints(spark):
    fps = X.packed(fingerprints(spark, {i: np.arange(i, i + 50) for i in range(6)}))
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "a long, b long")
    got = X._each_pair(pairs, fps, "n long", lambda _, a, b: [[len(a) * 100 + len(b)]], made=lambda x: x, sent_as=lambda x: x[x % 10 == 0])
    assert {x.n for x in got.collect()} == {505} and len(got.collect()) == 15
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("lighter(") > plan.index("REPARTITION")  # further down: before the rows are dealt


def test_groups_start_when_the_shuffles_of_their_pairs_are_gone(spark, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, components, left = files(), G.components, []

    def late(edges):
        end = time.time() + 10
        while (more := files() - before) and time.time() < end:
            time.sleep(0.1)
        left.append(more)
        return components(edges)

    monkeypatch.setattr(G, "components", late)
    tiers = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"), F.lit(1).alias("tier")).repartition(3, "a")
    tracks = spark.createDataFrame([], "id long, content_id long, present boolean")
    assert G.build_groups(tiers, tracks).count() == 200 and left == [set()]  # before, they stayed until the driver collected its garbage


def test_packed_fingerprints_take_four_bytes_an_item(spark):
    arrays = {1: np.array([2**32 - 1, 0, 7]), 2: np.array([], int), 3: np.array([5])}
    rows = X.packed(fingerprints(spark, arrays))
    assert {x.content_id: len(x["items"]) for x in rows.collect()} == {1: 12, 2: 0, 3: 4}
    assert {x.content_id: list(x.fp) for x in X.unpacked(rows).collect()} == {i: a.tolist() for i, a in arrays.items()}


def test_spectral_beyond_the_dense_bound(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.standard_normal((120, 3)) + 9 * (np.arange(120) % 3)[:, None]
    rows = spark.createDataFrame([(i * 5, v.tolist()) for i, v in enumerate(x)], "content_id long, vector array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edges = spark.createDataFrame([(i * 5, int(j) * 5, float(np.exp(-d[i, j]))) for i in range(120) for j in np.argsort(d[i])[1:8]], "i long, j long, w double")
    dense = K.suggested_clusters(edges, rows).first().k
    monkeypatch.setattr(K, "SPECTRAL_NODES", 20)
    assert K.suggested_clusters(edges, rows).first().k == dense
    got = {y.content_id // 5: y.cluster_id for y in K.spectral(edges, rows, 3).collect()}
    assert len(got) == 120 and len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)


def test_leading_finds_equal_eigenvalues():
    a = np.kron(np.eye(6), np.ones((15, 15)) - np.eye(15))
    i, j = np.nonzero(a)
    values, vectors = K.leading(90, i, j, a[i, j], 8)
    assert values[:6] == pytest.approx([1] * 6) and values[6:] == pytest.approx([-1 / 14] * 2)
    assert vectors.T @ vectors == pytest.approx(np.eye(8), abs=1e-9)


def test_distances_come_in_pieces(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((23, 5))
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "content_id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for blocks in (1, 4):
        out = D.distances(rows, blocks, piece=2)
        got = out.collect()
        assert len(got) == 23 * 22 and all(abs(y.d - (1 - u[y.i // 3] @ u[y.j // 3])) < 2e-9 for y in got)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" in plan  # no group of block pairs is held, none is shuffled


def test_playlist_judges(spark):
    r = random.Random(8)
    keys, n = [*S.SEMITONES, None, "H"], 60
    tracks = [(i, 1000 + i, r.choice(["x", "y", "", None]), r.choice([70.0, 141.0, 95.5, 0.0, None]), r.choice(keys), r.choice(["major", "minor", None]), r.choice(["A", " a", "b", "", None])) for i in range(n)]
    vectors = {1000 + i: [r.gauss(0, 1) for _ in range(4)] for i in range(n) if i % 7}
    lists = {s: [s, *r.sample([i for i in range(n) if i != s], k)] for s, k in ((3, 14), (7, 14), (20, 14), (33, 14), (41, 2), (50, 0))}
    spare = {(s, p) for s, x in lists.items() for p in range(1, len(x)) if r.random() < 0.3}
    known = D.with_moments(spark.createDataFrame(list(vectors.items()), "content_id long, vector array<double>"), 2)
    rows = spark.createDataFrame([(s, p, t, (s, p) in spare) for s, x in lists.items() for p, t in enumerate(x)], "seed long, position int, track_id long, fallback boolean")
    table = spark.createDataFrame(tracks, "track_id long, content_id long, label string, bpm double, key_name string, scale string, tag_artist string")
    got = E.playlist_judges(rows, table, known).first().asDict()

    ids = sorted(vectors)
    d = D.cosine_block(*[pd.DataFrame({"vector": [vectors[i] for i in ids]})] * 2)
    above = np.zeros(d.shape)
    for i in range(len(ids)):
        other = np.delete(d[i], i)
        above[i] = [1 - D.STANDARD.cdf((x - other.mean()) / other.std()) for x in d[i]]
    mp = 1 - above * above.T
    far = lambda a, b: mp[ids.index(1000 + a), ids.index(1000 + b)] if 1000 + a in vectors and 1000 + b in vectors else None
    place = lambda t: (S.SEMITONES[t[4]] + 3 * (t[5] == "minor")) * 7 % 12 if t[4] in S.SEMITONES else None
    artist = lambda i: (tracks[i][6] or "").strip().lower()
    coherence, smooth, variety, key, jump, repeat = [], [], [], [], [], []
    for x in lists.values():
        of = [tracks[i][2] for i in x]
        if of[0] and any(of[1:]):
            coherence.append(np.mean([o == of[0] for o in of[1:] if o]))
        smooth += [far(a, b) for a, b in itertools.pairwise(x)]
        some = [v for a, b in itertools.combinations(x, 2) if (v := far(a, b)) is not None]
        variety += [np.mean(some)] if some else []
        for p, (a, b) in enumerate(itertools.pairwise(x), 1):
            steps = None if None in (place(tracks[a]), place(tracks[b])) else abs(place(tracks[a]) - place(tracks[b]))
            key.append(steps is not None and min(steps, 12 - steps) <= 1)
            u, v = tracks[a][3] or 0, tracks[b][3] or 0
            jump += [min(abs(u - v), abs(2 * u - v), abs(u - 2 * v))] if u > 0 and v > 0 else []
            repeat += [artist(b) in [artist(t) for t in x[max(0, p - 3) : p]]] if artist(b) else []
    want = {
        "lists": 6, "length": np.mean([len(x) for x in lists.values()]), "coverage": len({t for x in lists.values() for t in x}) / n, "fallback": len(spare) / sum(len(x) - 1 for x in lists.values()), "coherence": np.mean(coherence),
        "smooth": np.mean([v for v in smooth if v is not None]), "variety": np.mean(variety), "key": np.mean(key), "jump": np.mean(jump), "repeat": np.mean(repeat),
    }
    assert got == pytest.approx(want, abs=1e-6) and list(got) == list(want)
    empty = E.playlist_judges(rows.limit(0), table.limit(0), known).first().asDict()
    assert empty.pop("lists") == 0 and set(empty.values()) == {None}

    edges, spared = {1: [(2, 0.1)], 2: [(1, 0.0)], 4: [(5, 0.1)]}, set()
    walk = P.walk(1, edges, dict.fromkeys(range(1, 6)), {}, 5, None, spared)
    assert spared == {p for p in range(1, 5) if walk[p] not in [t for t, _ in edges.get(walk[p - 1], ())]} and spared


def test_linkages_in_stages(monkeypatch):
    r = np.random.default_rng(6)
    done = 0
    for n in (2, 5, 60, 211):
        for x in (r.standard_normal((n, 3)) * (3, 1, 1), r.standard_normal((n, 3))[r.integers(0, n, n)], r.standard_normal((n, 8))):
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
            for method, k, held in itertools.product(("ward", "average", "complete"), (1, 4), (64 * n, 256 * n, 8 * 60 * 60, 10**7)):
                got = K.Agglomeration(x, method, held).labels(min(k, n))
                done += got is not None
                assert got is None or got.tolist() == K.linkage_labels(d, min(k, n), method).tolist()
                assert K.merged_labels(x, min(k, n), method, held).tolist() == K.linkage_labels(d, min(k, n), method).tolist()
    assert done > 200
    grid = np.array(list(itertools.product(range(7), repeat=3)), float)  # few different distances
    for method in ("ward", "average", "complete"):
        assert len({*K.merged_labels(grid, 3, method, 10**4).tolist()}) == 3

    x = r.standard_normal((6000, 12))
    monkeypatch.setattr(K, "chain_labels", None)
    for method in ("ward", "complete"):
        assert len({*K.merged_labels(x, 4, method, 20_000_000).tolist()}) == 4


def test_linkages_take_products_of_few_points(monkeypatch):
    r = np.random.default_rng(7)
    x, pairs = r.standard_normal((3000, 12)), [0]
    made = K.Agglomeration.points

    def counted(self, *a):
        d = made(self, *a)
        pairs[0] += d.size
        return d

    monkeypatch.setattr(K.Agglomeration, "points", counted)
    for method in ("average", "complete"):
        pairs[0] = 0
        assert K.Agglomeration(x, method, 10_000_000).labels(4) is not None
        assert 0 < pairs[0] < 4 * 3000**2


def test_matrix_is_made_without_a_written_copy(spark, monkeypatch):
    from tonearm import storage

    monkeypatch.setattr(storage, "checkpointed", None)  # the packed blocks were written before
    r = np.random.default_rng(4)
    short = r.standard_normal((40, 5)).astype(np.float32).astype(float)
    for x in (short, r.standard_normal((40, 5)), short * 1e200):
        rows = spark.createDataFrame([(i * 3 - 7, v) for i, v in enumerate(x.tolist())], "content_id long, vector array<double>")
        for blocks in (1, 3):
            got = {(i, j): d for i, j, d in D.distances(rows, blocks, 4).collect()}
            want = D.cosine_block(*[pd.DataFrame({"vector": list(x)})] * 2)
            assert len(got) == 40 * 39
            assert all(got[i * 3 - 7, j * 3 - 7] == pytest.approx(want[i, j], abs=2e-9, nan_ok=True) for i in range(40) for j in range(40) if i != j)
