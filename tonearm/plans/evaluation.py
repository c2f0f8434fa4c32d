"""Queries: judging neighbours, clusters and playlists."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.operators import clustering as K
from tonearm.operators import evaluation as E
from tonearm.operators import similarity as D
from tonearm.plans.discovery import EVERY, K_LIST, LISTS, NORMS, pool, score_lists, spread, walks, with_vectors
from tonearm.plans.registry import query
from tonearm.storage import settled

col = F.col
one = "*"  # for F.count; a Column would need a session at import


@query("ev_subset", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 3")
def _(lib):
    rows = lib.table("documents").select("doc_id", "lang", "source", F.sha2(F.concat(F.lit("42:"), col("doc_id").cast("string")), 256).alias("h"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source").orderBy("h", "doc_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id")


@query("ev_pct_rank", "SELECT i, j, round((row_number() OVER (ORDER BY d, i, j) - 1) / (count(*) OVER () - 1)::DOUBLE, 9) AS rank FROM neighbour")
def _(lib):
    return E.percentile_rank(D.nearest(lib.embedding, K_LIST).select("i", "j", "d"), "d").select("i", "j", F.round("rank", 9).alias("rank"))


@query("ev_euclid", "SELECT x.content_id AS i, y.content_id AS j, round(list_distance(x.vector, y.vector), 6) AS d FROM embedding x JOIN embedding y ON y.content_id = x.content_id + 1")
def _(lib):
    a = lib.embedding.select(col("content_id").alias("i"), col("vector").alias("a"))
    b = lib.embedding.select((col("content_id") - 1).alias("i"), col("content_id").alias("j"), col("vector").alias("b"))
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return a.join(b, "i").select("i", "j", F.round(d, 6).alias("d"))


@query("ev_components", f"SELECT i, j, round(n.d / 2, 6) AS embedding_norm, round(m, 6) AS mfcc_norm, round(t, 6) AS bpm_norm, round(k, 6) AS key_norm, round(e, 6) AS energy_norm FROM neighbour n JOIN ({NORMS}{EVERY}) x ON x.a = n.i AND x.b = n.j")
def _(lib):
    """Each component's distance for the neighbours by embedding."""
    near = D.nearest(lib.embedding, K_LIST)
    rows = near.join(D.side(lib.scored, "a"), col("a_content_id") == col("i")).join(D.side(lib.scored, "b"), col("b_content_id") == col("j"))
    parts = D.components(bpm_scale=F.lit(spread(lib)))
    return rows.select("i", "j", F.round(col("d") / 2, 6).alias("embedding_norm"), *[F.round(v, 6).alias(k) for k, v in parts.items() if k != "combined_score"])


@query("ev_fusion", f"SELECT coalesce(n.i, l.track_id) AS i, coalesce(n.j, l.neighbor_id) AS j, (coalesce(n.n, {K_LIST + 1}) + coalesce(l.place, {K_LIST + 1})) / 2.0 AS fused FROM neighbour n FULL JOIN {LISTS} l ON l.track_id = n.i AND l.neighbor_id = n.j")
def _(lib):
    """Mean place in the lists by embedding and by components; what a list lacks comes after it."""
    return E.fused(D.nearest(lib.embedding, K_LIST), score_lists(lib).withColumnsRenamed({"track_id": "i", "neighbor_id": "j"}), K_LIST)


KNOWN = "(SELECT x.content_id AS i, y.content_id AS j FROM embedding x JOIN embedding y ON y.content_id = x.content_id + 10)"


def known(lib):
    """Pairs that are taken to be duplicates: ids ten apart."""
    later = lib.embedding.select((col("content_id") - 10).alias("i"), col("content_id").alias("j"))
    return later.join(lib.embedding.select(col("content_id").alias("i")), "i", "left_semi").select("i", "j")


@query("ev_hit_mrr", f"SELECT round(avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN n <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0 / n, 0)), 6) AS mrr FROM {KNOWN} k LEFT JOIN (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM distance) USING (i, j)")
def _(lib):
    out = E.hits(D.ranks(lib.embedding, known(lib)), known(lib))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


SIDES = "(SELECT content_id, label, content_id % 3 AS source, content_id % 50 AS artist FROM embedding)"


@query("ev_label_precision", f"SELECT round(avg((x.label = y.label)::INT), 6) AS precision, round(avg((x.label = y.label)::INT) FILTER (x.source <> y.source), 6) AS across_source, round(avg((x.source = y.source)::INT), 6) AS source_bias FROM (SELECT d.i, d.j, row_number() OVER (PARTITION BY d.i ORDER BY d.d, d.j) AS r FROM distance d WHERE d.i % 50 <> d.j % 50) p JOIN {SIDES} x ON x.content_id = p.i JOIN {SIDES} y ON y.content_id = p.j WHERE r <= 10")
def _(lib):
    labels = lib.embedding.select("content_id", "label", (col("content_id") % 3).alias("source"), (col("content_id") % 50).alias("artist"))
    near = D.nearest(lib.embedding.withColumn("artist", col("content_id") % 50), 10, apart="artist")
    out = E.label_precision(near, labels)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("ev_hubness", "SELECT round(sum((n - m) ** 3) / count(*) / power(sum((n - m) ** 2) / count(*), 1.5), 6) AS skew, round(avg((n = 0)::INT), 6) AS never, max(n) AS most FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT e.content_id, count(x.j) AS n FROM embedding e LEFT JOIN neighbour x ON x.j = e.content_id AND x.n <= 10 GROUP BY e.content_id))")
def _(lib):
    out = E.hubness(D.nearest(lib.embedding, 10), lib.embedding)
    return out.select(F.round("skew", 6).alias("skew"), F.round("never", 6).alias("never"), "most")


PAIR = "(SELECT label AS a, content_id % 4 + label % 3 AS b FROM embedding)"
TABLE = f"(SELECT a, b, count(*) AS n FROM {PAIR} GROUP BY ALL)"


def table(lib):
    return E.contingency(lib.embedding.select(col("label").alias("a"), (col("content_id") % 4 + col("label") % 3).alias("b")), "a", "b")


@query("ev_purity", f"SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT a, max(n) AS m, sum(n) AS n FROM {TABLE} GROUP BY a)")
def _(lib):
    return E.purity(table(lib), "a").select(F.round("purity", 6).alias("purity"))


ENTROPY = "(SELECT -sum(n / t * ln(n / t)) FROM (SELECT {c}, sum(n) AS n, (SELECT sum(n) FROM {T}) AS t FROM {T} GROUP BY {c}))"


@query("ev_nmi", f"SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM {TABLE})) / (({ENTROPY.format(c='a', T=TABLE)} + {ENTROPY.format(c='b', T=TABLE)}) / 2), 6) AS nmi")
def _(lib):
    return E.normalised_information(table(lib), "a", "b").select(F.round("nmi", 6).alias("nmi"))


ARI = f"SELECT round((x - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM {TABLE}), (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM {TABLE} GROUP BY a)), (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM {TABLE} GROUP BY b))"


@query("ev_ari", ARI)
def _(lib):
    return E.adjusted_rand(table(lib), "a", "b").select(F.round("ari", 6).alias("ari"))


@query("ev_stability")
def _(lib):
    """Mean ARI of k-means on four samples of 80%, over all pairs of them on their common contents."""
    matrix = K.feature_matrix(lib.features, lib.embedding)
    parts = [K.kmeans(matrix.where(F.pmod(F.xxhash64("content_id", F.lit(i)), F.lit(10)) < 8), 6, seed=i) for i in range(4)]
    out = None
    for p, q in combinations(parts, 2):
        both = p.withColumnRenamed("cluster_id", "a").join(q.withColumnRenamed("cluster_id", "b"), "content_id")
        one_ari = E.adjusted_rand(E.contingency(both, "a", "b"), "a", "b")
        out = one_ari if out is None else out.unionByName(one_ari)
    return out.agg(F.round(F.avg("ari"), 6).alias("stability"))


@query("ev_dup_together", f"SELECT round(avg((x.cluster_id = y.cluster_id)::INT), 6) AS together FROM {KNOWN} k JOIN assignment x ON x.content_id = k.i JOIN assignment y ON y.content_id = k.j")
def _(lib):
    from tonearm.plans.analysis import assigned

    return E.together(known(lib), assigned(lib)).select(F.round("together", 6).alias("together"))


@query("ev_alt_clusterers")
def _(lib):
    """Gaussian mixture, bisecting k-means and three linkages on the standardised matrix."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
    from pyspark.ml.functions import array_to_vector

    matrix = K.standardised(K.feature_matrix(lib.features, lib.embedding))
    rows = matrix.select("content_id", array_to_vector("x").alias("features"))
    mixture = GaussianMixture(k=4, seed=42, maxIter=10).fit(rows).transform(rows).select("content_id", col("prediction").alias("mixture"))
    bisecting = BisectingKMeans(k=4, seed=42).fit(rows).transform(rows).select("content_id", col("prediction").alias("bisecting"))
    return mixture.join(bisecting, "content_id").join(K.linked(matrix, 4), "content_id")


@query("ev_silhouette_k")
def _(lib):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = K.standardised(K.feature_matrix(lib.features, lib.embedding)).select("content_id", array_to_vector("x").alias("features"))
    scores = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=42, maxIter=10).fit(rows).transform(rows)))) for k in K.TRIES]
    return lib.spark.createDataFrame(scores, "k int, silhouette double").select("k", F.round("silhouette", 6).alias("silhouette"))


@query("ev_eigengap")
def _(lib):
    rows = lib.embedding
    near = D.nearest(rows, 10)
    return K.suggested_clusters(D.affinity(near, 10), rows.select("content_id"))


@query("ev_merge_small")
def _(lib):
    rows = with_vectors(lib).withColumn("cluster_id", F.when(col("content_id") % 97 == 0, 50).otherwise(col("cluster_id")))
    return K.merged_small(rows.select("content_id", "cluster_id"), K.mean_vectors(rows))


@query("ev_playlist_judges")
def _(lib):
    known = D.with_moments(lib.embedding)
    tracks = pool(lib).join(lib.embedding.select("content_id", "label"), "content_id", "left")
    out = E.playlist_judges(settled(walks(lib, 15, known=known)), tracks, known)
    return out.select("lists", *[F.round(c, 6).alias(c) for c in out.columns if c != "lists"])


@query("ev_playlist_mmr")
def _(lib):
    """A step of maximal marginal relevance: of each track's ten nearest, the one that is close to it and far from its nearest."""
    near = D.nearest(lib.embedding, 10).select("i", "j", "d", "place")
    first = near.where("place = 1").select("i", col("j").alias("first"))
    vector = lambda c, name: lib.embedding.select(col("content_id").alias(c), col("vector").alias(name))
    rows = near.where("place > 1").join(first, "i").join(vector("first", "a"), "first").join(vector("j", "b"), "j")
    rows = rows.withColumn("d2", F.round(S.cosine_distance(col("a"), col("b")), 9))
    return rows.groupBy("i").agg(F.min_by("j", F.struct(F.round(0.7 * col("d") - 0.3 * col("d2"), 9), "j")).alias("chosen"))


@query("ev_stability_pairs", "SELECT k, round(median(abs(x.bpm - y.bpm)), 6) AS bpm, round(median(abs(x.centroid - y.centroid)), 6) AS centroid FROM (SELECT content_id, unnest([1, 2, 5]) AS k, bpm, centroid FROM features) x JOIN features y ON y.content_id = x.content_id + x.k GROUP BY k")
def _(lib):
    x = lib.features.select("content_id", F.explode(F.array(*map(F.lit, (1, 2, 5)))).alias("k"), col("bpm").alias("b"), col("centroid").alias("c"))
    y = lib.features.select("content_id", "bpm", "centroid")
    rows = x.withColumn("content_id", col("content_id") + col("k")).join(y, "content_id")
    return rows.groupBy("k").agg(F.round(F.median(F.abs(col("b") - col("bpm"))), 6).alias("bpm"), F.round(F.median(F.abs(col("c") - col("centroid"))), 6).alias("centroid"))


@query("ev_auc", "SELECT round(sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT n_chars, sum(quality)::DOUBLE AS pos, sum(1 - quality)::DOUBLE AS neg FROM labels JOIN documents USING (doc_id) GROUP BY n_chars))")
def _(lib):
    rows = lib.table("labels").join(lib.table("documents").select("doc_id", "n_chars"), "doc_id")
    return E.auc(rows, "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


@query("ev_redundancy")
def _(lib):
    """Share of one feature's variance that the others explain, by ridge regression on four fifths at a time, judged on the fifth left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = lib.features.na.drop(subset=["bpm", "energy"]).withColumn("fold", F.pmod(F.xxhash64("content_id"), F.lit(5)))
    inputs = VectorAssembler(inputCols=["energy", "danceability", "loudness", "centroid"], outputCol="features").transform(rows)
    judged = None
    for fold in range(5):
        model = LinearRegression(labelCol="bpm", regParam=1.0, elasticNetParam=0.0).fit(inputs.where(col("fold") != fold))
        part = model.transform(inputs.where(col("fold") == fold)).select("fold", "bpm", "prediction")
        judged = part if judged is None else judged.unionByName(part)
    per = judged.groupBy("fold").agg((1 - F.sum((col("bpm") - col("prediction")) ** 2) / (F.count(one) * F.var_pop("bpm"))).alias("r2"))
    return per.agg(F.lit("bpm").alias("feature"), F.round(F.avg("r2"), 6).alias("r2"))


@query("ev_mood_heads", "SELECT round(corr(x, y), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY centroid) + (count(*) OVER (PARTITION BY centroid) - 1) / 2.0 AS x, rank() OVER (ORDER BY loudness) + (count(*) OVER (PARTITION BY loudness) - 1) / 2.0 AS y FROM features)")
def _(lib):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=["centroid", "loudness"], outputCol="v").transform(lib.features).select("v")
    value = float(Correlation.corr(rows, "v", "spearman").head()[0].toArray()[0, 1])
    return lib.spark.createDataFrame([(value,)], "spearman double").select(F.round("spearman", 6).alias("spearman"))


SHEET = "(SELECT '| ' || doc_id || ' | ' || lang || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no ' END || ' |' AS line FROM documents)"


@query("ev_sheet_parse", f"SELECT regexp_extract(line, '^\\| *([0-9]+) *\\|', 1)::BIGINT AS id, regexp_extract(line, '\\| *([a-z]+) *\\|$', 1) AS verdict FROM {SHEET}")
def _(lib):
    d = col("doc_id")
    line = F.concat(F.lit("| "), d.cast("string"), F.lit(" | "), "lang", F.lit(" | "), F.when(d % 3 == 0, "yes").otherwise("no "), F.lit(" |"))
    rows = lib.table("documents").select(line.alias("line"))
    return rows.select(F.regexp_extract("line", r"^\| *([0-9]+) *\|", 1).cast("long").alias("id"), F.regexp_extract("line", r"\| *([a-z]+) *\|$", 1).alias("verdict"))

