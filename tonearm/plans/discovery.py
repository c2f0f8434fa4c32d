"""Queries: similarity, playlists, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.operators import clustering as K
from tonearm.operators import playlists as P
from tonearm.operators import similarity as D
from tonearm.plans.analysis import MATRIX, SPREAD, assigned
from tonearm.plans.registry import query
from tonearm.plans.relational import members
from tonearm.storage import settled

col = F.col
one = "*"  # for F.count; a Column would need a session at import
K_LIST = 20
ASKED = "content_id % 50 = 0"  # the queries of the pair scores, against all rows


# --- distances -----------------------------------------------------------------------

FIFTHS = "((CASE WHEN {s} = 'minor' THEN (idx({k}) + 3) % 12 ELSE idx({k}) END) * 7) % 12"
INDEX = "CASE {k} WHEN 'C' THEN 0 WHEN 'C#' THEN 1 WHEN 'Db' THEN 1 WHEN 'D' THEN 2 WHEN 'Eb' THEN 3 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'F#' THEN 6 WHEN 'G' THEN 7 WHEN 'Ab' THEN 8 WHEN 'A' THEN 9 WHEN 'Bb' THEN 10 WHEN 'B' THEN 11 END"


def fifths(k: str, s: str) -> str:
    i = INDEX.format(k=k)
    return f"((CASE WHEN {s} = 'minor' THEN (({i}) + 3) % 12 ELSE {i} END) * 7) % 12"


def key_distance(a: str, b: str) -> str:
    d = f"abs({fifths(f'{a}.key_name', f'{a}.scale')} - {fifths(f'{b}.key_name', f'{b}.scale')})"
    return f"coalesce(least({d}, 12 - {d}), 6)"


EVERY = "scored a JOIN scored b ON b.content_id <> a.content_id"
PAIRED = f"{EVERY} AND a.{ASKED}"


def paired(lib):
    return D.paired(lib.scored, F.expr(ASKED))


def spread(lib) -> float:
    return D.bpm_spread(lib.features).first()["spread"]  # one number


@query("sim_cosine", f"SELECT a.content_id AS a, b.content_id AS b, round(1 - list_cosine_similarity(a.mfcc, b.mfcc), 6) AS d FROM {PAIRED}")
def _(lib):
    return paired(lib).select(col("a_content_id").alias("a"), col("b_content_id").alias("b"), F.round(S.cosine_distance(col("a_mfcc"), col("b_mfcc")), 6).alias("d"))


@query("sim_key_distance", f"SELECT a.content_id AS a, b.content_id AS b, {key_distance('a', 'b')} AS d FROM {PAIRED}")
def _(lib):
    d = S.key_distance(col("a_key_name"), col("a_scale"), col("b_key_name"), col("b_scale"))
    return paired(lib).select(col("a_content_id").alias("a"), col("b_content_id").alias("b"), d.alias("d"))


NORMS = f"""SELECT a.content_id AS a, b.content_id AS b, least((1 - list_cosine_similarity(a.mfcc, b.mfcc)) / 2, 1) AS m, CASE WHEN a.bpm > 0 AND b.bpm > 0 THEN least(abs(a.bpm - b.bpm) / (SELECT spread FROM ({SPREAD})), 1) END AS t,
    CASE WHEN a.key_name IS NOT NULL AND b.key_name IS NOT NULL THEN {key_distance('a', 'b')} / 6.0 END AS k, CASE WHEN a.energy IS NOT NULL AND b.energy IS NOT NULL THEN least(abs(a.energy - b.energy), 1) END AS e FROM """


def scores(lib):
    parts = D.components(bpm_scale=F.lit(spread(lib)))
    return paired(lib).select(col("a_content_id").alias("a"), col("b_content_id").alias("b"), *[F.round(v, 6).alias(k) for k, v in parts.items()])


@query("sim_normalize", f"SELECT a, b, round(m, 6) AS mfcc_norm, round(t, 6) AS bpm_norm, round(k, 6) AS key_norm, round(e, 6) AS energy_norm FROM ({NORMS}{PAIRED})")
def _(lib):
    return scores(lib).drop("combined_score")


SCORE = f"SELECT a, b, round((0.5 * m + coalesce(0.25 * t, 0) + coalesce(0.15 * k, 0) + coalesce(0.1 * e, 0)) / (0.5 + CASE WHEN t IS NULL THEN 0 ELSE 0.25 END + CASE WHEN k IS NULL THEN 0 ELSE 0.15 END + CASE WHEN e IS NULL THEN 0 ELSE 0.1 END), 6) AS combined_score FROM ({NORMS}"


@query("sim_score", f"{SCORE}{PAIRED})")
def _(lib):
    return scores(lib).select("a", "b", "combined_score")


@query("sim_load", "SELECT e.content_id, len(vector) AS dim FROM embedding e WHERE content_id IN (SELECT content_id FROM track WHERE present)")
def _(lib):
    return lib.embedding.join(lib.track.where("present"), "content_id", "left_semi").select("content_id", F.size("vector").alias("dim"))


BOTH = f"(SELECT a AS track_id, b AS neighbor_id, combined_score FROM ({SCORE}{EVERY})))"
LISTS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY combined_score, neighbor_id) AS place FROM {BOTH}) WHERE place <= {K_LIST})"


def score_lists(lib, **which):
    return D.score_index(lib.scored, K_LIST, spread(lib), **which)


@query("sim_full_rebuild", f"SELECT * FROM {LISTS}")
def _(lib):
    return score_lists(lib)


@query(
    "sim_build_incremental",
    f"""SELECT track_id, neighbor_id, combined_score, place FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY combined_score, fresh, neighbor_id) AS place FROM
    (SELECT * EXCLUDE (p), 0 AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY combined_score, neighbor_id) AS p FROM {BOTH} WHERE neighbor_id % 3 <> 0) WHERE p <= {K_LIST} UNION ALL SELECT *, 1 FROM {BOTH} WHERE neighbor_id % 3 = 0)) WHERE place <= {K_LIST}""",
)
def _(lib):
    """Lists over the contents that were there, then a third of new ones."""
    new = col("content_id") % 3 == 0
    return D.merge_top_k(score_lists(lib, data=~new).drop("place"), score_lists(lib, data=new).drop("place"), K_LIST)


for name in ("win_topk_per_key", "jn_cross_all_pairs"):
    query(name, "SELECT i, j, round(d + 2e-10, 6) AS d, n AS place FROM neighbour")(lambda lib: D.nearest(lib.embedding, K_LIST).select("i", "j", F.round(col("d") + 2e-10, 6).alias("d"), "place"))


@query("sim_cosine_matrix", "SELECT i, j, round(d + 2e-10, 6) AS d FROM distance")
def _(lib):
    return D.distances(lib.embedding).select("i", "j", F.round(col("d") + 2e-10, 6).alias("d"))  # d has nine places: no ties


def cdf(x: str) -> str:
    a = f"abs({x})"
    horner = lambda cs: "(" * (len(cs) - 1) + str(cs[0]) + "".join(f" * {a} + {c})" for c in cs[1:])
    tail = f"CASE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {horner(S.NUMERATOR)} / {horner(S.DENOMINATOR)} ELSE 0 END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


MP = f"""SELECT i, j, round(1 - (1 - pi) * (1 - pj), 6) AS mp FROM (SELECT n.i, n.j, {cdf('zi')} AS pi, {cdf('zj')} AS pj FROM (SELECT n.*, (d - x.mean) / greatest(x.sd, 1e-12) AS zi, (d - y.mean) / greatest(y.sd, 1e-12) AS zj FROM neighbour n
    JOIN (SELECT i, avg(d) AS mean, stddev_pop(d) AS sd FROM distance GROUP BY i) x ON x.i = n.i JOIN (SELECT i, avg(d) AS mean, stddev_pop(d) AS sd FROM distance GROUP BY i) y ON y.i = n.j) n)"""


@query("sim_mutual_proximity", MP)
def _(lib):
    rows = lib.embedding
    return D.mutual_proximity(D.nearest(rows, K_LIST).select("i", "j", "d"), D.row_moments(rows)).select("i", "j", F.round("mp", 6).alias("mp"))


def index(lib, k: int = 100, **made):
    return D.embedding_index(lib.embedding, k, **made)


ALL_MP = MP.replace("FROM neighbour n\n", "FROM distance n\n").replace("SELECT i, j, round(1 - (1 - pi) * (1 - pj), 6) AS mp", "SELECT i, j, d, round(1 - (1 - pi) * (1 - pj), 9) AS mp").replace("SELECT n.i, n.j, ", "SELECT n.i, n.j, n.d, ")
INDEX_ROWS = f"(SELECT i AS track_id, j AS neighbor_id, round(d / 2, 6) AS raw, round(mp, 4) AS combined_score, place FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY mp, j) AS place FROM ({ALL_MP})) WHERE place <= 100)"


def shown(rows):
    return rows.select("track_id", "neighbor_id", F.round(col("raw") + 2e-10, 6).alias("raw"), F.round("combined_score", 4).alias("combined_score"), "place")


@query("sim_build_embedding", f"SELECT * REPLACE (round(raw + 2e-10, 6) AS raw) FROM {INDEX_ROWS}".replace("round(d / 2, 6) AS raw", "d / 2 AS raw"))
def _(lib):
    return shown(index(lib))


def build_index(lib, method: str = "auto", k: int | None = None):
    """(track_id, neighbor_id, raw, combined_score, place, method): by embeddings if there are any, else by the components' score."""
    if method not in ("auto", "embedding", "mfcc"):
        raise ValueError(f"no index method {method!r}: auto, embedding or mfcc")
    if method == "auto":
        method = "mfcc" if lib.embedding.isEmpty() else "embedding"
    rows = index(lib, k or 100) if method == "embedding" else D.score_index(lib.scored, k or K_LIST, spread(lib)).withColumn("raw", F.lit(None).cast("double"))
    return rows.select("track_id", "neighbor_id", "raw", "combined_score", "place", F.lit(method).alias("method"))


@query("sim_build_index", f"SELECT 'embedding' AS method, count(*) AS rows, count(DISTINCT track_id) AS tracks FROM {INDEX_ROWS} UNION ALL SELECT 'mfcc', count(*), count(DISTINCT track_id) FROM {LISTS}")
def _(lib):
    """What the choice by data and the other method build."""
    count = lambda rows: rows.groupBy("method").agg(F.count(one).alias("rows"), F.countDistinct("track_id").alias("tracks"))
    return count(build_index(lib)).unionByName(count(build_index(lib, "mfcc")))


@query(
    "sim_knn_affinity",
    "SELECT i, j, round(exp(-power(min(d) / (SELECT greatest(median(d), 1e-12) FROM neighbour WHERE n <= 10), 2)), 6) AS w FROM (SELECT i, j, d FROM neighbour WHERE n <= 10 UNION ALL SELECT j, i, d FROM neighbour WHERE n <= 10) GROUP BY i, j",
)
def _(lib):
    return D.affinity(D.nearest(lib.embedding, 10), 10).select("i", "j", F.round("w", 6).alias("w"))


@query("srt_similar", "SELECT j AS neighbor_id, round(d, 6) AS d FROM neighbour WHERE i = 7 AND j IN (SELECT content_id FROM track WHERE present) ORDER BY d, j LIMIT 10")
def _(lib):
    near = D.nearest(lib.embedding, K_LIST, queries=col("content_id") == 7)
    here = lib.track.where("present").select(col("content_id").alias("j"))
    return near.join(here, "j", "left_semi").orderBy("d", "j").limit(10).select(col("j").alias("neighbor_id"), F.round("d", 6).alias("d"))


# --- playlists ------------------------------------------------------------------------


@query("shf_resolve", "SELECT min(id) AS id, count(*) AS matches, count(*) = 1 AS found FROM track WHERE present AND path LIKE '%/7.%'")
def _(lib):
    hit = lib.track.where("present").where(S.like_nocase(col("path"), "/7."))
    return hit.agg(F.min("id").alias("id"), F.count(one).alias("matches"), (F.count(one) == 1).alias("found"))


CLOSE = 0.3  # these vectors hold no copies; the playlists use P.SAME_SONG


@query("shf_near_copies", f"SELECT i AS track_id, j AS neighbor_id FROM neighbour WHERE d / 2 < {CLOSE}")
def _(lib):
    rows = D.nearest(lib.embedding, K_LIST).select(col("i").alias("track_id"), col("j").alias("neighbor_id"), (col("d") / 2).alias("raw"))
    return P.near_copies(rows, CLOSE)


@query("shf_index_kind", "SELECT count(*) FILTER (method = 'embedding') > 0 AS embedding FROM cluster_run")
def _(lib):
    runs = lib.spark.createDataFrame([(1, "kmeans"), (2, "embedding"), (3, "embedding")], "run_id int, method string")
    return runs.agg((F.count_if(col("method") == "embedding") > 0).alias("embedding"))


LINKED = "(SELECT content_id // 8 AS g, * FROM member)"


@query("shf_dup_exclusions", f"SELECT DISTINCT a.id AS track_id, b.id AS excluded FROM {LINKED} a JOIN {LINKED} b ON a.g = b.g AND a.content_id <> b.content_id WHERE a.decision IN ('approved', 'applied') AND b.decision IN ('approved', 'applied')")
def _(lib):
    return P.duplicate_exclusions(members(lib).withColumn("group_id", F.floor(col("content_id") / 8)))


@query("shf_bpm_jump", f"SELECT a.content_id AS a, b.content_id AS b, round(least(abs(a.bpm - b.bpm), abs(2 * a.bpm - b.bpm), abs(a.bpm - 2 * b.bpm)), 6) AS jump FROM {PAIRED} WHERE a.bpm IS NOT NULL AND b.bpm IS NOT NULL")
def _(lib):
    rows = paired(lib).where("a_bpm is not null and b_bpm is not null")
    return rows.select(col("a_content_id").alias("a"), col("b_content_id").alias("b"), F.round(S.bpm_jump(col("a_bpm"), col("b_bpm")), 6).alias("jump"))


def pool(lib):
    features = lib.features.select("content_id", "bpm", "key_name", "scale")
    rows = lib.track.where("present and id = content_id").join(features, "content_id")
    return rows.select(col("id").alias("track_id"), "content_id", "bpm", "key_name", "scale", "tag_artist")


LIMIT = f"(SELECT spread * 0.25 FROM ({SPREAD}))"
JUMP = "least(abs(b.bpm - a.bpm), abs(2 * b.bpm - a.bpm), abs(b.bpm - 2 * a.bpm))"
KNOWN = "a.bpm > 0 AND b.bpm > 0"
POOL = "(SELECT id, f.* FROM track t JOIN features f USING (content_id) WHERE present AND id = content_id)"
TRANSITION = f"""SELECT n.i AS track_id, n.j AS neighbor_id, round(d + CASE WHEN {KNOWN} AND {JUMP} > {LIMIT} THEN 0.3 ELSE 0 END + CASE WHEN {KNOWN} THEN 0.3 * least({JUMP} / (2 * {LIMIT}), 1) ELSE 0 END
    - CASE WHEN a.key_name IS NOT NULL AND b.key_name IS NOT NULL AND {key_distance('a', 'b')} <= 1 THEN 0.2 ELSE 0 END, 6) AS score FROM neighbour n JOIN {POOL} a ON a.id = n.i JOIN {POOL} b ON b.id = n.j"""


@query("shf_transition_score", TRANSITION)
def _(lib):
    rows = D.nearest(lib.embedding, K_LIST).select(col("i").alias("track_id"), col("j").alias("neighbor_id"), col("d").alias("combined_score"), (col("d") / 2).alias("raw"))
    return P.transitions(rows, pool(lib), spread(lib)).select("track_id", "neighbor_id", F.round("score", 6).alias("score"))


def filtered(lib, tracks, genre: str | None = None, low: float | None = None, high: float | None = None):
    """Tracks of a genre (a part of its name will do) and a range of tempos."""
    if genre:
        tracks = tracks.join(lib.track.select(col("id").alias("track_id"), "tag_genre"), "track_id").where(S.like_nocase(col("tag_genre"), genre)).drop("tag_genre")
    if low is not None:
        tracks = tracks.where(col("bpm") >= low)
    return tracks if high is None else tracks.where(col("bpm") < high)


def walks(lib, n: int = 20, embedding: bool = True, genre: str | None = None, bpm: tuple[float, float] | None = None, **made):
    """Playlists from every 25th track of the pool; without embeddings by the components' score, and without exclusion of near copies.  ``made``: for ``D.embedding_index``."""
    tracks = filtered(lib, pool(lib), genre, *(bpm or ()))
    wide = spread(lib)
    rows = settled(index(lib, P.POOL, **made)) if embedding else D.score_index(lib.scored, P.LEGACY_POOL, wide).withColumn("raw", F.lit(None).cast("double"))
    scored = P.transitions(rows, tracks, wide, embedding).join(rows.select("track_id", "neighbor_id", "place"), ["track_id", "neighbor_id"])
    gone = P.duplicate_exclusions(members(lib))
    if embedding:
        gone = gone.unionByName(P.near_copies(rows).select("track_id", col("neighbor_id").alias("excluded")))
    seeds = tracks.where("track_id % 25 = 0").select(col("track_id").alias("seed"))
    return P.playlists(seeds, scored, tracks, gone, n)


@query("shf_smart_shuffle")
def _(lib):
    return walks(lib).drop("fallback")


@query("shf_filtered")
def _(lib):
    return walks(lib, genre="en", bpm=(60.0, 180.0)).drop("fallback")


@query("shf_legacy")
def _(lib):
    return walks(lib, embedding=False).drop("fallback")


# --- clusters ---------------------------------------------------------------------------


@query("cls_matrix", f"SELECT content_id, len(x) AS width, round(list_sum(x), 6) AS total FROM {MATRIX}")
def _(lib):
    m = K.feature_matrix(lib.features, lib.embedding)
    return m.select("content_id", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("cls_kmeans")
def _(lib):
    return K.kmeans(K.feature_matrix(lib.features, lib.embedding), 6)


@query("cls_small", f"SELECT content_id, CASE WHEN n < {K.SMALL} THEN 0 END AS cluster_id FROM (SELECT content_id, count(*) OVER (PARTITION BY key_name, scale) AS n FROM {MATRIX} JOIN features USING (content_id))")
def _(lib):
    """Contents by key: a key of too few is one cluster, the others are left to a clusterer."""
    rows = K.feature_matrix(lib.features, lib.embedding).join(lib.features.select("content_id", "key_name", "scale"), "content_id")
    return K.small(rows, "key_name", "scale")


CENTROIDS = "(SELECT cluster_id, list(v ORDER BY k) AS centroid FROM (SELECT cluster_id, k, avg(v) AS v FROM (SELECT a.cluster_id, unnest(vector) AS v, generate_subscripts(vector, 1) AS k FROM embedding e JOIN assignment a USING (content_id)) GROUP BY ALL) GROUP BY cluster_id)"
NEAREST = f"SELECT content_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, round(sqrt(min(d)), 6) AS distance FROM (SELECT e.content_id, c.cluster_id, round(list_sum(list_transform(list_zip(e.vector, c.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12) AS d FROM embedding e, {CENTROIDS} c WHERE e.content_id % 10 = 7) GROUP BY content_id"


def with_vectors(lib):
    return assigned(lib).join(lib.embedding.select("content_id", "vector"), "content_id")


for name in ("cls_incremental_kmeans", "jn_nearest_centroid"):

    @query(name, NEAREST)
    def _(lib):
        new = lib.embedding.where("content_id % 10 = 7")
        return K.nearest_centroid(new, K.mean_vectors(with_vectors(lib))).select("content_id", "cluster_id", F.round("distance", 6).alias("distance"))


VOTE = """SELECT i AS content_id, arg_max(cluster_id, (n, -first)) AS cluster_id FROM (SELECT i, cluster_id, count(*) AS n, min(r) AS first FROM (SELECT d.i, a.cluster_id, row_number() OVER (PARTITION BY d.i ORDER BY d.d, d.j) AS r
    FROM distance d JOIN assignment a ON a.content_id = d.j WHERE d.i % 10 = 7) WHERE r <= 10 GROUP BY ALL) GROUP BY i"""


for name in ("cls_assign_vote", "jn_knn_vote"):

    @query(name, VOTE)
    def _(lib):
        near = D.nearest(lib.embedding, K.VOTERS, queries=col("content_id") % 10 == 7, data=col("content_id") % 10 != 7)  # new ones against those in clusters
        return K.vote(near, assigned(lib))


@query("cls_method", "SELECT method, count(*) AS runs, max(run_id) AS latest FROM cluster_run GROUP BY method")
def _(lib):
    runs = lib.spark.createDataFrame([(1, "kmeans"), (2, "embedding"), (3, "embedding")], "run_id int, method string")
    return runs.groupBy("method").agg(F.count(one).alias("runs"), F.max("run_id").alias("latest"))


@query("cls_graph_neighbours", "SELECT n, least(20, greatest(10, n // 50)) AS k FROM (SELECT unnest([10, 400, 700, 5000]) AS n)")
def _(lib):
    return lib.spark.createDataFrame([(n, K.graph_neighbours(n)) for n in (10, 400, 700, 5000)], "n int, k int")


def spectral(lib, k: int = K.CLUSTERS):
    rows = lib.embedding
    near = D.embedding_index(rows, 10).select(col("track_id").alias("i"), col("neighbor_id").alias("j"), col("combined_score").alias("d"), "place")
    return K.spectral(D.affinity(near, 10), rows.select("content_id"), k)


@query("cls_spectral")
def _(lib):
    return spectral(lib)


UNIT = "list_transform({v}, lambda x: x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-12))"
RUN = f"""SELECT u.content_id, u.cluster_id, round(1 - list_sum(list_transform(list_zip(u.v, c.v), lambda p: p[1] * p[2])), 6) AS distance_to_centroid FROM (SELECT a.content_id, a.cluster_id, {UNIT.format(v='vector')} AS v FROM embedding e JOIN assignment a USING (content_id)) u
    JOIN (SELECT cluster_id, {UNIT.format(v='m')} AS v FROM (SELECT cluster_id, list(x ORDER BY k) AS m FROM (SELECT cluster_id, k, avg(x) AS x FROM (SELECT a.cluster_id, unnest({UNIT.format(v='vector')}) AS x, generate_subscripts(vector, 1) AS k FROM embedding e JOIN assignment a USING (content_id)) GROUP BY ALL) GROUP BY cluster_id)) c USING (cluster_id)"""


@query("cls_write_run", RUN)
def _(lib):
    return K.write_run(with_vectors(lib))[1].select("content_id", "cluster_id", F.round("distance_to_centroid", 6).alias("distance_to_centroid"))


@query("cls_present_sizes", "SELECT k AS cluster_id, count(a.content_id) AS n FROM (SELECT unnest(range(12))::INT AS k) LEFT JOIN assignment a ON a.cluster_id = k AND a.content_id IN (SELECT content_id FROM track WHERE present) GROUP BY k")
def _(lib):
    return K.present_sizes(assigned(lib), lib.track, 12)


def centroid_rows(df) -> list:
    return df.select("cluster_id", "centroid").orderBy("cluster_id").collect()  # k rows


def relabel(lib, new):
    import numpy as np

    old = centroid_rows(K.mean_vectors(with_vectors(lib)))
    fresh = centroid_rows(K.mean_vectors(new.join(lib.embedding.select("content_id", "vector"), "content_id")))
    table = K.relabelled(np.array([r["centroid"] for r in old]), np.array([r["centroid"] for r in fresh]))
    pairs = [(fresh[i]["cluster_id"], old[j]["cluster_id"] if j < len(old) else j) for i, j in table.items()]
    return lib.spark.createDataFrame(pairs, "new_id int, cluster_id int")


@query("cls_relabel", "SELECT DISTINCT 9 - cluster_id AS new_id, cluster_id FROM assignment")
def _(lib):
    return relabel(lib, assigned(lib).withColumn("cluster_id", 9 - col("cluster_id")))


@query("cls_rebuild_kmeans")
def _(lib):
    found = K.kmeans(K.feature_matrix(lib.features, lib.embedding), 6)
    return found.join(F.broadcast(relabel(lib, found).withColumnsRenamed({"new_id": "x"})), col("x") == found["cluster_id"]).select("content_id", found["cluster_id"].alias("new_id"), col("x"))  # k rows


@query("cls_embed_rebuild")
def _(lib):
    found = spectral(lib, 10)
    names = relabel(lib, found)
    return found.withColumnRenamed("cluster_id", "new_id").join(F.broadcast(names), "new_id").select("content_id", "cluster_id")  # k rows


MEDIAN = "list_sort(list({c}) FILTER ({c} IS NOT NULL))[count({c}) // 2 + 1]"
HERE = "features JOIN track USING (content_id) WHERE present"
LABEL = f"""SELECT cluster_id, CASE WHEN bpm < bl THEN 'Slow' WHEN bpm > bh THEN 'Upbeat' ELSE 'Mid-tempo' END || ' ' || CASE WHEN energy < el THEN 'Calm' WHEN energy > eh THEN 'Energetic' ELSE 'Moderate' END || ' ' || CASE WHEN major > scales / 2.0 THEN 'Major' ELSE 'Minor' END || ' ' ||
    CASE WHEN centroid > mid THEN 'Bright' ELSE 'Warm' END AS label FROM (SELECT cluster_id, {MEDIAN.format(c='bpm')} AS bpm, {MEDIAN.format(c='energy')} AS energy, {MEDIAN.format(c='centroid')} AS centroid, count(*) AS scales, count(*) FILTER (scale = 'major') AS major FROM assignment JOIN features USING (content_id) GROUP BY cluster_id),
    (SELECT quantile_cont(bpm, 0.33) AS bl, quantile_cont(bpm, 0.66) AS bh, quantile_cont(energy, 0.33) AS el, quantile_cont(energy, 0.66) AS eh, {MEDIAN.format(c='centroid')} AS mid FROM {HERE})"""


@query("cls_label", LABEL)
def _(lib):
    return K.cluster_labels(assigned(lib), lib.features, lib.track)


@query("cls_render", "SELECT cluster_id, string_agg(line, ' / ' ORDER BY id) AS examples FROM (SELECT cluster_id, t.id, coalesce(nullif(tag_artist, ''), '?') || ' - ' || coalesce(tag_title, '?') AS line, row_number() OVER (PARTITION BY cluster_id ORDER BY t.id) AS n FROM assignment a JOIN track t USING (content_id) WHERE present) WHERE n <= 3 GROUP BY cluster_id")
def _(lib):
    artist = F.when(F.coalesce("tag_artist", F.lit("")) != "", col("tag_artist")).otherwise("?")
    rows = assigned(lib).join(lib.track.where("present"), "content_id").select("cluster_id", "id", F.concat(artist, F.lit(" - "), F.coalesce("tag_title", F.lit("?"))).alias("line"))
    few = D.top_k(rows, "cluster_id", "id", "line", 3)
    lines = few.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("x"))
    return lines.select("cluster_id", F.array_join("x.line", " / ").alias("examples"))
