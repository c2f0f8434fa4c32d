"""Queries: aggregations, scalar functions, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.operators import clustering as K
from tonearm.operators import metadata as M
from tonearm.operators import similarity as D
from tonearm.plans.registry import query

col = F.col
one = "*"  # for F.count; a Column would need a session at import


@query("agg_count_filter", "SELECT count(*) AS files, count(*) FILTER (present) AS here, count(*) FILTER (bitrate IS NULL) AS no_rate, count(*) FILTER (tag_genre = 'en' AND present) AS english FROM track")
def _(lib):
    return lib.track.agg(F.count(one).alias("files"), F.count_if("present").alias("here"), F.count_if(col("bitrate").isNull()).alias("no_rate"), F.count_if((col("tag_genre") == "en") & col("present")).alias("english"))


@query("agg_count_distinct", "SELECT count(DISTINCT content_id) AS contents, count(DISTINCT tag_album) AS albums, count(DISTINCT tag_artist) AS artists FROM track")
def _(lib):
    return lib.track.agg(F.countDistinct("content_id").alias("contents"), F.countDistinct("tag_album").alias("albums"), F.countDistinct("tag_artist").alias("artists"))


@query("agg_min_max_avg", "SELECT min(bitrate) AS low, max(bitrate) AS high, round(avg(bitrate), 6) AS mean FROM track WHERE present")
def _(lib):
    return lib.track.where("present").agg(F.min("bitrate").alias("low"), F.max("bitrate").alias("high"), F.round(F.avg("bitrate"), 6).alias("mean"))


@query("agg_sum_join", "SELECT round(coalesce(sum(c.duration), 0), 3) AS duration, coalesce(sum(t.size), 0)::BIGINT AS size FROM track t JOIN content c ON c.id = t.content_id WHERE t.present")
def _(lib):
    c = lib.content.select(col("id").alias("content_id"), "duration")
    return lib.track.where("present").join(c, "content_id").agg(F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 3).alias("duration"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


@query("agg_group_count", "SELECT codec, sample_rate, count(*) AS n FROM track t JOIN content c ON c.id = t.content_id WHERE present GROUP BY ALL")
def _(lib):
    c = lib.content.select(col("id").alias("content_id"), "codec", "sample_rate")
    return lib.track.where("present").join(c, "content_id").groupBy("codec", "sample_rate").agg(F.count(one).alias("n"))


@query("agg_having", "SELECT content_id, count(*) AS n FROM track WHERE present GROUP BY content_id HAVING count(*) > 2")
def _(lib):
    return lib.track.where("present").groupBy("content_id").agg(F.count(one).alias("n")).where("n > 2")


BUCKETS = [(60, 80), (80, 100), (100, 120), (120, 140), (140, 160), (160, 200), (200, 100000)]
BANDS = [(0.0, 0.5), (0.5, 0.9), (0.9, 1.01)]


def histogram(spark, rows, value: str, edges: list[tuple]):
    """Counts of each [low, high), zeros included: each value finds its bucket without a join, and the counts meet the short list."""
    place = F.lit(None).cast("int")
    for i, (low, high) in enumerate(edges):
        place = F.when((col(value) >= low) & (col(value) < high), i).otherwise(place)
    counts = rows.groupBy(place.alias("i")).agg(F.count(one).alias("n"))
    every = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(edges)], "i int, low double, high double")
    return every.join(counts, "i", "left").fillna(0, ["n"]).select("low", "high", "n")


def values(edges):
    return ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in edges)


@query("agg_histogram_fixed", f"SELECT low, high, count(bpm) AS n FROM (VALUES {values(BUCKETS)}) b(low, high) LEFT JOIN features f ON f.bpm >= low AND f.bpm < high GROUP BY low, high")
def _(lib):
    return histogram(lib.spark, lib.features, "bpm", BUCKETS)


@query("agg_score_bands", f"SELECT low, high, count(score) AS n FROM (VALUES {values(BANDS)}) b(low, high) LEFT JOIN (SELECT json_extract(best, '$.score')::DOUBLE AS score FROM parsed WHERE outcome = 'parsed') ON score >= low AND score < high GROUP BY low, high")
def _(lib):
    return histogram(lib.spark, M.parse(lib.lookup).where("outcome = 'parsed'"), "score", BANDS)


SPREAD = "SELECT CASE WHEN count(*) < 4 THEN 60.0 ELSE greatest(10.0, quantile_cont(bpm, 0.75) - quantile_cont(bpm, 0.25)) END AS spread FROM features WHERE bpm > 0"
for name in ("agg_percentile_linear", "sim_bpm_spread"):
    query(name, SPREAD.replace("END AS", "END::DOUBLE AS").replace("SELECT CASE", "SELECT round(CASE").replace("END::DOUBLE AS", "END, 9) AS"))(lambda lib: D.bpm_spread(lib.features).select(F.round("spread", 9).alias("spread")))

TERCILES = "SELECT round(CASE WHEN count(*) < 6 THEN {a} ELSE quantile_cont({c}, 0.33) END, 9) AS low, round(CASE WHEN count(*) < 6 THEN {b} ELSE quantile_cont({c}, 0.66) END, 9) AS high FROM features JOIN track USING (content_id) WHERE present AND {c} IS NOT NULL"


@query("agg_terciles", TERCILES.format(a=80.0, b=120.0, c="bpm"))
def _(lib):
    return K.terciles(lib.features, lib.track, "bpm", K.BPM_TERCILES).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("agg_upper_median", "SELECT scale, list_sort(list(bpm))[count(bpm) // 2 + 1] AS bpm FROM features WHERE bpm IS NOT NULL GROUP BY scale")
def _(lib):
    return lib.features.where("bpm is not null").groupBy("scale").agg(K.upper_median("bpm").alias("bpm"))


@query("agg_majority", "SELECT cluster_id, CASE WHEN count(*) FILTER (scale = 'major') > count(*) / 2.0 THEN 'major' ELSE 'minor' END AS mode FROM assignment JOIN features USING (content_id) GROUP BY cluster_id")
def _(lib):
    major = F.count_if(col("scale") == "major") > F.count(one) / 2
    return assigned(lib).join(lib.features, "content_id").groupBy("cluster_id").agg(F.when(major, "major").otherwise("minor").alias("mode"))


def assigned(lib):
    return lib.embedding.where("content_id % 10 <> 7").select("content_id", col("label").alias("cluster_id"))


@query("agg_mode_vote", "SELECT source, arg_max(lang, (n, -first)) AS lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) GROUP BY source")
def _(lib):
    counts = lib.table("documents").groupBy("source", "lang").agg(F.count(one).alias("n"), F.min("doc_id").alias("first"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("n", -col("first"))).alias("lang"))


@query("agg_collect", "SELECT content_id, list(id ORDER BY id) AS ids FROM track GROUP BY content_id")
def _(lib):
    return lib.track.groupBy("content_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))


@query("agg_confusion", "SELECT quality AS expect, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def _(lib):
    rows = lib.table("labels").join(lib.table("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(col("quality").alias("expect"), F.when(col("n_chars") > 800, 1).otherwise(0).alias("predicted")).agg(F.count(one).alias("n"))


@query("agg_mean_vector", "SELECT label AS cluster_id, k, round(avg(v), 6) AS v FROM (SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS k FROM embedding) GROUP BY ALL")
def _(lib):
    rows = K.mean_vectors(lib.embedding, "label").select(col("label").alias("cluster_id"), F.posexplode("centroid").alias("k", "v"))
    return rows.select("cluster_id", "k", F.round("v", 6).alias("v"))


MATRIX = "(SELECT content_id, [bpm, energy, danceability, loudness, centroid, 1.0::DOUBLE] || vector[1:13] AS x FROM features JOIN embedding USING (content_id) WHERE bpm IS NOT NULL AND energy IS NOT NULL)"


@query("agg_mean_std_scaler", f"SELECT k, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END, 6) AS sd FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) - 1 AS k FROM {MATRIX}) GROUP BY k")
def _(lib):
    return K.scaler(K.feature_matrix(lib.features, lib.embedding)).select("k", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("agg_row_moments", "SELECT i, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM distance GROUP BY i")
def _(lib):
    return D.row_moments(lib.embedding).select("i", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def near(lib, k: int = 20):
    return D.nearest(lib.embedding, k)


@query("agg_median_neighbours", "SELECT round(median(d), 6) AS sigma FROM neighbour WHERE n <= 10")
def _(lib):
    return near(lib, 10).agg(F.round(F.median("d"), 6).alias("sigma"))


HEALTH = {
    "files": "count(*)", "present": "count(*) FILTER (present)", "contents": "count(DISTINCT content_id) FILTER (present)", "missing_tags": "count(*) FILTER (present AND (tag_title IS NULL OR tag_artist = '' OR tag_album IS NULL OR tag_genre IS NULL))",
    "low_rate": "count(*) FILTER (present AND bitrate IS NULL)", "size": "coalesce(sum(size) FILTER (present), 0)::BIGINT",
}


@query("agg_health", f"SELECT * FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in HEALTH.items())} FROM track), (SELECT count(*) AS dup_groups FROM tier0), (SELECT count(*) FILTER (clipping) AS clipping, count(*) FILTER (low_volume) AS quiet FROM quality_flag)")
def _(lib):
    missing = col("tag_title").isNull() | (col("tag_artist") == "") | col("tag_album").isNull() | col("tag_genre").isNull()
    here = col("present")
    first = lib.track.agg(F.count(one).alias("files"), F.count_if(here).alias("present"), F.countDistinct(F.when(here, col("content_id"))).alias("contents"), F.count_if(here & F.coalesce(missing, F.lit(False))).alias("missing_tags"), F.count_if(here & col("bitrate").isNull()).alias("low_rate"), F.coalesce(F.sum(F.when(here, col("size"))), F.lit(0)).alias("size"))
    groups = lib.track.where(here).groupBy("content_id").agg(F.count(one).alias("n")).where("n > 1").agg(F.count(one).alias("dup_groups"))
    flags = lib.quality_flag.agg(F.count_if("clipping").alias("clipping"), F.count_if("low_volume").alias("quiet"))
    return first.join(F.broadcast(groups)).join(F.broadcast(flags))  # one row each


STATS = "SELECT 'genre' AS kind, tag_genre AS name, count(*) AS n FROM track WHERE present GROUP BY ALL UNION ALL SELECT 'key', key_name || ' ' || scale, count(*) FROM features WHERE key_name IS NOT NULL GROUP BY ALL UNION ALL SELECT 'artist', tag_artist, count(*) FROM track WHERE present GROUP BY ALL"


@query("agg_stats", STATS)
def _(lib):
    part = lambda rows, kind, name: rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count(one).alias("n"))
    here = lib.track.where("present")
    keys = lib.features.where("key_name is not null")
    return part(here, "genre", col("tag_genre")).unionByName(part(keys, "key", F.concat("key_name", F.lit(" "), "scale"))).unionByName(part(here, "artist", col("tag_artist")))


# --- scalar functions -------------------------------------------------------------


@query("fn_ext", r"SELECT id, lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1)) AS ext FROM track UNION ALL SELECT -1, lower(regexp_extract('/a/.Hidden', '[^/.][^/]*(\.[^./]*)$', 1)) UNION ALL SELECT -2, lower(regexp_extract('/a.b/Name.MP3', '[^/.][^/]*(\.[^./]*)$', 1))")
def _(lib):
    more = lib.spark.createDataFrame([(-1, "/a/.Hidden"), (-2, "/a.b/Name.MP3")], "id long, path string")
    return lib.track.select("id", "path").unionByName(more).select("id", S.extension(col("path")).alias("ext"))


@query("fn_escape_path", "SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r') AS x FROM documents")
def _(lib):
    return lib.table("documents").select("doc_id", S.escape_path(col("text")).alias("x"))


@query(
    "fn_fmt",
    """SELECT id, CASE WHEN d >= 3600 THEN (d // 3600)::BIGINT || 'h ' || ((d % 3600) // 60)::BIGINT || 'm' ELSE ((d % 3600) // 60)::BIGINT || 'm' END AS duration, CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1e9) WHEN b >= 1000000 THEN printf('%.1f MB', b / 1e6) ELSE printf('%.1f KB', b / 1e3) END AS size,
    CASE WHEN bitrate IS NULL THEN '-' ELSE (bitrate // 1000) || ' kbps' END AS rate FROM (SELECT id, n_chars * 10 AS d, size * 40000 AS b, bitrate FROM track)""",
)
def _(lib):
    return lib.track.select("id", S.duration_text(col("n_chars") * 10).alias("duration"), S.size_text(col("size") * 40_000).alias("size"), S.bitrate_text(col("bitrate")).alias("rate"))


@query("fn_correct_bpm", "SELECT content_id, CASE WHEN bpm < 60 THEN bpm * 2 WHEN bpm > 200 THEN bpm / 2 ELSE bpm END AS bpm FROM features")
def _(lib):
    return lib.features.select("content_id", S.corrected_bpm(col("bpm")).alias("bpm"))


@query("fn_rms_energy", "SELECT id, round(CASE WHEN id % 50 <= 0 THEN 0 ELSE least(sqrt(n_chars / 100.0 / (id % 50)), 1) END, 9) AS rms FROM track")
def _(lib):
    return lib.track.select("id", F.round(S.rms_energy(col("n_chars") / 100.0, col("id") % 50), 9).alias("rms"))


@query("fn_effective_cutoff", "SELECT content_id, CASE WHEN cliff_db IS NOT NULL THEN coalesce(cutoff_hz, 21000) END AS cutoff FROM bandwidth")
def _(lib):
    return lib.bandwidth.select("content_id", S.effective_cutoff(col("cutoff_hz"), col("cliff_db")).alias("cutoff"))


@query("fn_unit", "SELECT content_id, round(vector[1] / (sqrt(list_sum(list_transform(vector, lambda x: x * x))) + 1e-12), 9) AS first, round(list_sum(list_transform(vector, lambda x: x)) / (sqrt(list_sum(list_transform(vector, lambda x: x * x))) + 1e-12), 6) AS total FROM embedding")
def _(lib):
    u = lib.embedding.select("content_id", S.unit(col("vector")).alias("u"))
    return u.select("content_id", F.round(col("u")[0], 9).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("fn_normalize_key", "SELECT content_id, CASE key_name WHEN 'Db' THEN 'C#' WHEN 'D#' THEN 'Eb' WHEN 'Gb' THEN 'F#' WHEN 'G#' THEN 'Ab' WHEN 'A#' THEN 'Bb' ELSE key_name END AS key FROM features")
def _(lib):
    return lib.features.select("content_id", S.normal_key(col("key_name")).alias("key"))


# --- metadata ----------------------------------------------------------------------

PARSED = """SELECT content_id, outcome, json_extract(best, '$.score')::DOUBLE AS score, json_extract_string(best, '$.recordings[0].id') AS recording_id, json_extract_string(best, '$.recordings[0].title') AS title,
    json_extract_string(best, '$.recordings[0].releasegroups[0].title') AS release_title FROM parsed"""


@query("json_parse_response", PARSED)
def _(lib):
    return M.parse(lib.lookup).select("content_id", "outcome", "score", "recording_id", "title", "release_title")


ARTISTS = "SELECT content_id, k AS position, json_extract_string(best, '$.recordings[0].artists[' || k || '].id') AS artist_id, json_extract_string(best, '$.recordings[0].artists[' || k || '].name') AS name FROM parsed, (SELECT unnest([0, 1]) AS k) WHERE outcome = 'parsed'"


@query("json_parse_all", f"SELECT outcome, count(*) AS n, coalesce(sum(artists), 0)::BIGINT AS artists FROM parsed p LEFT JOIN (SELECT content_id, count(*) AS artists FROM ({ARTISTS}) GROUP BY content_id) a USING (content_id) GROUP BY outcome")
def _(lib):
    rows = M.parse(lib.lookup)
    return rows.groupBy("outcome").agg(F.count(one).alias("n"), F.coalesce(F.sum(F.when(col("outcome") == "parsed", F.size("artists"))), F.lit(0)).alias("artists"))


@query("json_backfill", ARTISTS)
def _(lib):
    rows = M.parse(lib.lookup).where("outcome = 'parsed'").select("content_id", F.to_json("artists").alias("artists_json"))
    return M.backfill(rows, "artists_json")


@query("net_enrich", "SELECT id AS content_id, sha256('request ' || id) AS request_hash FROM content WHERE sha256('request ' || id) NOT IN (SELECT request_hash FROM lookup WHERE content_id % 2 = 0)")
def _(lib):
    asked = lib.content.select(col("id").alias("content_id"), F.sha2(F.concat(F.lit("request "), col("id").cast("string")), 256).alias("request_hash"))
    return asked.join(lib.lookup.where("content_id % 2 = 0"), "request_hash", "left_anti").select("content_id", "request_hash")
