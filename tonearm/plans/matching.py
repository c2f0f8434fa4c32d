"""Queries: fingerprint matching, groups, reports on pairs, calibration."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tonearm.operators import grouping as G
from tonearm.operators import matching as X
from tonearm.plans.registry import query
from tonearm.plans.views import smooth_sql
from tonearm.storage import checkpointed

col = F.col
one = "*"  # for F.count; a Column would need a session at import


def keyed(lib):
    return X.keyed(lib.fingerprint)


def candidates(lib):
    return X.matched(lib.fingerprints)


def aligned(lib):
    return X.best_alignment(candidates(lib), lib.fingerprints)


@query("fp_pack", "SELECT content_id, len(fp) AS n, fp[len(fp)] AS last FROM fingerprint")
def _(lib):
    return lib.fingerprint.select("content_id", F.size("fp").alias("n"), F.element_at("fp", -1).alias("last"))


@query("fp_vec_pack", "SELECT content_id, len(vector) AS dim, round(vector[64], 6) AS last FROM embedding")
def _(lib):
    return lib.embedding.select("content_id", F.size("vector").alias("dim"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query("fp_config_hash", """SELECT id, substr(sha256('{"bits":24,"cap":200,"run":' || id || '}'), 1, 16) AS hash FROM content""")
def _(lib):
    text = F.to_json(F.struct(F.lit(24).alias("bits"), F.lit(200).alias("cap"), col("id").alias("run")))
    return lib.content.select("id", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


@query("fp_key", "SELECT content_id, pos, key FROM keyed")
def _(lib):
    return keyed(lib).select("content_id", "pos", "key")


@query("fp_k_cap", "SELECT n, least(200, greatest(20, floor(0.02 * n)))::BIGINT AS cap FROM (SELECT unnest([3, 1000, 2000, 5000, 50000]) AS n)")
def _(lib):
    rows = lib.spark.createDataFrame([(n,) for n in (3, 1000, 2000, 5000, 50000)], "n int")
    return rows.select("n", X.k_cap(col("n")).cast("long").alias("cap"))


@query("win_first_m_positions", "SELECT content_id, key, pos FROM (SELECT *, row_number() OVER (PARTITION BY content_id, key ORDER BY pos) AS n FROM keyed) WHERE n <= 2")
def _(lib):
    return X.first_positions(keyed(lib).select("content_id", "key", "pos"), 2)


@query("fp_postings", "SELECT content_id, key, pos FROM posting")
def _(lib):
    return X.postings(lib.fingerprints)


@query("fp_candidates", "SELECT a, b, shared FROM candidate")
def _(lib):
    return candidates(lib)


@query("jn_self_key", "SELECT x.content_id AS a, y.content_id AS b, count(*) AS n FROM (SELECT DISTINCT content_id, key FROM posting) x JOIN (SELECT DISTINCT content_id, key FROM posting) y ON x.key = y.key AND x.content_id < y.content_id GROUP BY ALL")
def _(lib):
    return X.sharing(lib.fingerprints).select("a", "b", col("shared").alias("n"))


@query("jn_hash_positions", "SELECT c.a, c.b, count(*) AS met, min(x.pos - y.pos) AS low, max(x.pos - y.pos) AS high FROM candidate c JOIN keyed x ON x.content_id = c.a JOIN keyed y ON y.content_id = c.b AND y.key = x.key GROUP BY ALL")
def _(lib):
    return X.vote_range(candidates(lib), lib.fingerprints)


for name in ("fp_offset_hist", "agg_hist_offsets"):
    query(name, "SELECT a, b, delta, votes FROM offset_vote")(lambda lib: X.offset_votes(candidates(lib), lib.fingerprints))

for name in ("fp_best_alignment", "win_local_max_peak"):
    query(name, "SELECT a, b, best_offset, peak_votes, total_votes FROM alignment")(aligned)

HAMMING = "SELECT a, b, i AS pos_a, e AS bits FROM error"


@query("fp_hamming", HAMMING)
def _(lib):
    return X.overlaps(candidates(lib), lib.fingerprints, each=True)


@query("jn_shifted_positional", "SELECT a, b, count(*) AS overlap, sum(e)::BIGINT AS bits FROM error GROUP BY ALL")
def _(lib):
    return X.overlaps(candidates(lib), lib.fingerprints)


def evidence(lib):
    return X.evidence(candidates(lib), lib.fingerprints)


SMOOTHED = "(SELECT content_id, {smooth} AS s FROM (SELECT content_id, pos, (item % 32)::DOUBLE AS e, first_value((item % 32)::DOUBLE) OVER (PARTITION BY content_id ORDER BY pos) AS head, last_value((item % 32)::DOUBLE) OVER (PARTITION BY content_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM item) WINDOW w AS (PARTITION BY content_id ORDER BY pos))"


@query("fp_smooth", f"SELECT content_id, round(sum(s), 6) AS total FROM {SMOOTHED.format(smooth=smooth_sql())} GROUP BY content_id")
def _(lib):
    import numpy as np
    import pandas as pd

    def run(batches):
        for part in batches:
            sums = [float(X.smooth(np.asarray(x, float) % 32, 8.0).sum()) for x in part["fp"]]
            yield pd.DataFrame({"content_id": part["content_id"], "total": np.round(sums, 6)})

    return lib.fingerprint.mapInPandas(run, "content_id long, total double")


@query("fp_segments", "SELECT a, b, segment_count, span_items AS matched_span_items FROM evidence")
def _(lib):
    return evidence(lib).select("a", "b", "segment_count", "matched_span_items")


FULL = "a, b, best_offset, peak_votes, round(ratio, 9) AS peak_vote_ratio, span_items AS matched_span_items, round(span, 6) AS matched_span_seconds, round(coverage_a, 9) AS coverage_a, round(coverage_b, 9) AS coverage_b, round(bit_error, 9) AS mean_bit_error, segment_count, tier"
PLACES = {"peak_vote_ratio": 9, "matched_span_seconds": 6, "coverage_a": 9, "coverage_b": 9, "mean_bit_error": 9}


def rounded(rows):
    return rows.withColumns({c: F.round(c, n) for c, n in PLACES.items()})


@query("fp_compare", f"SELECT {FULL} FROM tiered")
def _(lib):
    return rounded(evidence(lib))


@query("fp_run_match", f"SELECT {FULL} FROM tiered WHERE tier >= 0")
def _(lib):
    return rounded(X.run_match(lib.fingerprints))


@query("fp_classify", "SELECT a, b, tier FROM tiered")
def _(lib):
    return evidence(lib).select("a", "b", "tier")


@query("fp_item_seconds", "SELECT content_id, round(len(fp) * (1365 / 11025.0::DOUBLE), 6) AS seconds FROM fingerprint")
def _(lib):
    return lib.fingerprint.select("content_id", F.round(F.size("fp") * X.ITEM_SECONDS, 6).alias("seconds"))


@query("fp_lookup_window", "SELECT content_id, least(len(fp), 948) AS n, list_sum(fp[1:948])::BIGINT AS total FROM fingerprint")
def _(lib):
    part = F.slice("fp", 1, 948)
    return lib.fingerprint.select("content_id", F.size(part).alias("n"), F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("fp_internal_algorithm", "SELECT n AS cli, n - 1 AS internal FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n)")
def _(lib):
    return lib.spark.createDataFrame([(n,) for n in range(1, 6)], "cli int").withColumn("internal", col("cli") - 1)


# --- groups -------------------------------------------------------------------------

LINKS = "(SELECT id AS a, id + 1 AS b FROM content WHERE id % 4 <> 3 AND id % 9 <> 0 UNION ALL SELECT id, id + 40 FROM content WHERE id % 40 = 5)"


def links(lib):
    first = lib.content.where("id % 4 <> 3 and id % 9 <> 0").select(col("id").alias("a"), (col("id") + 1).alias("b"))
    return first.unionByName(lib.content.where("id % 40 = 5").select(col("id").alias("a"), (col("id") + 40).alias("b")))


@query(
    "grp_components",
    f"""WITH RECURSIVE both_ways AS (SELECT a, b FROM {LINKS} UNION SELECT b, a FROM {LINKS}), reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT b, b FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY node""",
)
def _(lib):
    return G.components(links(lib))


def verifier(lib):
    """Direct comparison of pairs; a content without a fingerprint matches nothing."""
    return lambda pairs: pairs.join(X.compare(pairs, lib.fingerprints).select("a", "b", "tier"), ["a", "b"], "left").fillna(X.NO_MATCH, ["tier"])


def built(lib):
    return G.build_groups(evidence(lib), lib.track, verifier(lib))


BUILT = """SELECT component AS group_id, CASE WHEN clique THEN 1 ELSE 2 END AS tier, NOT clique AS formed_by_chain, node AS content_id FROM comp JOIN clique USING (component)
    UNION ALL SELECT content_id, 0, false, content_id FROM tier0 WHERE content_id NOT IN (SELECT node FROM comp JOIN clique USING (component) WHERE clique)"""


@query("grp_build", f"SELECT tier, formed_by_chain, count(DISTINCT group_id) AS groups, count(*) AS contents FROM ({BUILT}) GROUP BY ALL")
def _(lib):
    return built(lib).groupBy("tier", "formed_by_chain").agg(F.countDistinct("group_id").alias("groups"), F.count(one).alias("contents"))


@query("grp_build_groups", BUILT)
def _(lib):
    return built(lib)


PROBABLE = "SELECT a, b, least(coverage_a, coverage_b) AS coverage FROM tiered WHERE tier = 2 AND least(coverage_a, coverage_b) >= 0.3 AND bit_error <= 8 AND span >= 30"


def probable(lib):
    low = F.least("coverage_a", "coverage_b")
    known = col("coverage_a").isNotNull() & col("coverage_b").isNotNull()
    return evidence(lib).where((col("tier") == 2) & known & (low >= 0.3) & (col("mean_bit_error") <= 8) & (col("matched_span_seconds") >= 30)).select("a", "b", low.alias("coverage"))


@query("flt_probable", f"{PROBABLE} ORDER BY coverage DESC, a, b")
def _(lib):
    return probable(lib).orderBy(F.desc("coverage"), "a", "b")


@query("rep_probable", f"SELECT p.a, p.b, x.path AS path_a, y.path AS path_b FROM ({PROBABLE}) p JOIN track x ON x.id = p.a JOIN track y ON y.id = p.b")
def _(lib):
    path = lambda c: lib.track.select(col("id").alias(c), col("path").alias(f"path_{c}"))
    return probable(lib).join(path("a"), "a").join(path("b"), "b").select("a", "b", "path_a", "path_b")


# --- calibration --------------------------------------------------------------------

GRID = {"tier1_min_coverage": (0.75, 0.85, 0.92), "tier1_max_bit_error": (4.0, 6.0, 8.0), "tier1_min_overlap_seconds": (10.0, 20.0, 30.0), "tier2_min_overlap_seconds": (8.0, 15.0, 25.0)}
CONFIGS = [(i, *c) for i, c in enumerate(product(*(GRID[k] for k in sorted(GRID))))]
NAMES = sorted(GRID)


def tier_sql(c: str, e: str, s: str, s2: str) -> str:
    low, high = "least(coverage_a, coverage_b)", "greatest(coverage_a, coverage_b)"
    return f"CASE WHEN span_items = 0 OR ratio < 0.05 THEN -1 WHEN {low} >= {c} AND bit_error <= {e} AND span >= {s} THEN 1 WHEN ({high} >= {c} OR {low} > 0) AND span >= {s2} THEN 2 ELSE -1 END"


# what a pair should be, from its words alone: the share of rare keys that the shorter one has in common with the other; every fourth pair is held out
EXPECT = "CASE WHEN shared >= 0.8 * least(n_a, n_b) THEN 1 WHEN shared >= 0.1 * least(n_a, n_b) THEN 2 ELSE -1 END"
LABELLED = f"(SELECT e.*, {EXPECT} AS expect, CASE WHEN (e.a * 7 + e.b) % 4 = 0 THEN 'holdout' ELSE 'calibrate' END AS part FROM evidence e JOIN candidate c ON c.a = e.a AND c.b = e.b)"


def labelled(lib):
    """The candidates' evidence with what each pair should be."""
    pairs = checkpointed(candidates(lib))
    size = lambda c: lib.fingerprints.select(col("content_id").alias(c), col("n").alias(f"n_{c}"))
    low = F.least("n_a", "n_b")
    expect = F.when(col("shared") >= 0.8 * low, 1).when(col("shared") >= 0.1 * low, 2).otherwise(-1)
    part = F.when((col("a") * 7 + col("b")) % 4 == 0, "holdout").otherwise("calibrate")
    return X.evidence(pairs, lib.fingerprints).join(pairs.join(size("a"), "a").join(size("b"), "b").select("a", "b", expect.alias("expect"), part.alias("part")), ["a", "b"])


@query("cal_predict", f"SELECT part, expect, {tier_sql('0.85', '6', '20', '15')} AS predicted, count(*) AS n FROM {LABELLED} GROUP BY ALL")
def _(lib):
    return labelled(lib).groupBy("part", "expect", col("tier").alias("predicted")).agg(F.count(one).alias("n"))


SEARCH = f"""SELECT i, correct, held_out FROM (SELECT i, count(*) FILTER (expect = tier AND part = 'calibrate') AS correct, count(*) FILTER (expect = tier AND part = 'holdout') AS held_out FROM (SELECT g.i, expect, part, {tier_sql('g.tier1_min_coverage', 'g.tier1_max_bit_error', 'g.tier1_min_overlap_seconds', 'g.tier2_min_overlap_seconds')} AS tier
    FROM {LABELLED}, (VALUES {', '.join(str(c) for c in CONFIGS)}) g(i, {', '.join(NAMES)})) GROUP BY i) ORDER BY correct DESC, i LIMIT 1"""


@query("cal_search", SEARCH)
def _(lib):
    # 81 settings judged in one pass over the evidence
    right = lambda c: X.classify(X.DEFAULT.with_(**dict(zip(NAMES, c[1:], strict=True)))) == col("expect")
    judged = [F.struct(F.lit(c[0]).alias("i"), F.count_if(right(c) & (col("part") == "calibrate")).alias("correct"), F.count_if(right(c) & (col("part") == "holdout")).alias("held_out")) for c in CONFIGS]
    return labelled(lib).agg(F.array(*judged).alias("all")).select(F.explode("all").alias("x")).select("x.*").orderBy(F.desc("correct"), "i").limit(1)


@query("ev_trim_proposals", "SELECT a, b, CASE WHEN ratio < 0.05 THEN 'weak-match' WHEN abs(best_offset) > 100 THEN 'check-large' WHEN best_offset > 5 THEN 'trim' WHEN best_offset < -5 THEN 'ref-partial' ELSE 'no-trim' END AS flag FROM evidence")
def _(lib):
    o = col("best_offset")
    flag = F.when(col("peak_vote_ratio") < 0.05, "weak-match").when(F.abs(o) > 100, "check-large").when(o > 5, "trim").when(o < -5, "ref-partial").otherwise("no-trim")
    return evidence(lib).select("a", "b", flag.alias("flag"))
