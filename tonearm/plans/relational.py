"""Queries: sources, state changes, filters, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.operators import grouping as G
from tonearm.operators import identity as I
from tonearm.operators import ranking as R
from tonearm.plans.registry import query
from tonearm.sources import files
from tonearm.sources.library import Library

ROOTS = ["/lib", "/lib/src1", "/lib/src2"]
col = F.col

# --- sources ----------------------------------------------------------------


@query("src_walk_files")
def _(lib: Library):
    return files.walk(lib.spark, [lib.directory], extensions=(".parquet",)).select("name", "size")


@query(
    "src_should_retry",
    """SELECT t.id, coalesce(NOT (e.path IS NOT NULL AND e.size IS NOT DISTINCT FROM t.size AND e.mtime IS NOT DISTINCT FROM t.mtime AND e.dev IS NOT DISTINCT FROM t.dev AND e.inode IS NOT DISTINCT FROM t.inode), true) AS retry
    FROM track t LEFT JOIN (SELECT path, size + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS size, mtime, dev, inode FROM track WHERE id % 2 = 0) e ON e.path = t.path""",
)
def _(lib):
    errors = lib.track.where("id % 2 = 0").withColumn("size", col("size") + F.when(col("id") % 4 == 0, 1).otherwise(0))
    return I.retry(errors, lib.track).select("id", "retry")


ERRORS = "SELECT path, CASE WHEN id % 3 = 0 THEN 'hash' ELSE 'tags' END AS stage, 'error ' || (id % 5) AS message, k AS moment, id * 4 + k AS id FROM track, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE id % 7 = 0 AND (id + k) % 3 <> 0"


@query("src_record_error", f"SELECT path, arg_max(stage, (moment, id)) AS stage, arg_max(message, (moment, id)) AS message, count(*) AS attempts, max(moment) AS last_at FROM ({ERRORS}) GROUP BY path")
def _(lib):
    rows = lib.track.where("id % 7 = 0").withColumn("at", F.explode(F.array(*map(F.lit, range(4))))).where((col("id") + col("at")) % 3 != 0)
    events = rows.select("path", F.when(col("id") % 3 == 0, "hash").otherwise("tags").alias("stage"), F.concat(F.lit("error "), (col("id") % 5).cast("string")).alias("message"), "at", (col("id") * 4 + col("at")).alias("id"))
    return I.record_errors(events)


@query("src_content_id", "SELECT id, content_id FROM track")
def _(lib):
    return lib.track.select("id", "content_id")


BEFORE = "SELECT * FROM track WHERE id % 5 <> 0"
NOW = "SELECT path, id, size + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS size, mtime FROM track WHERE id % 4 <> 0"


@query(
    "src_scan",
    f"""SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN CASE WHEN starts_with(a.path, '/lib/src1/') OR starts_with(a.path, '/lib/src2/') THEN 'absent' ELSE 'untouched' END
    WHEN a.size IS NOT DISTINCT FROM b.size AND a.mtime IS NOT DISTINCT FROM b.mtime AND a.content_id IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS state, coalesce(b.size, a.size) AS size, b.path IS NOT NULL AS seen
    FROM ({BEFORE}) a FULL JOIN ({NOW}) b ON a.path = b.path""",
)
def _(lib):
    now = lib.track.where("id % 4 <> 0").select("path", (col("size") + F.when(col("id") % 6 == 0, 1).otherwise(0)).alias("size"), "mtime")
    return I.merge_scan(lib.track.where("id % 5 <> 0"), now, ROOTS[1:])


@query("src_whole_hash", "SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def _(lib):
    return lib.hashed.select(col("doc_id").alias("id"), col("audio_hash").alias("hash"))


@query(
    "src_identity",
    """SELECT id, CASE WHEN id % 3 <> 0 THEN 's' || audio_hash WHEN codec IS NOT NULL AND rate > 0 THEN audio_hash END AS hash, CASE WHEN id % 3 <> 0 THEN 'stream' WHEN codec IS NOT NULL AND rate > 0 THEN 'whole_file' END AS method
    FROM (SELECT id, audio_hash, CASE WHEN id % 9 <> 0 THEN 'mp3' END AS codec, id % 4 AS rate FROM track)""",
)
def _(lib):
    stream, codec = F.when(col("id") % 3 != 0, F.concat(F.lit("s"), "audio_hash")), F.when(col("id") % 9 != 0, "mp3")
    found, method = I.identity(stream, col("audio_hash"), codec, col("id") % 4)
    return lib.track.select("id", found.alias("hash"), method.alias("method"))


@query("src_fpcalc", "SELECT content_id, len(fp) AS n, fp[1] AS first_item, list_sum(fp)::BIGINT AS total FROM fingerprint")
def _(lib):
    return lib.fingerprint.select("content_id", F.size("fp").alias("n"), col("fp")[0].alias("first_item"), F.aggregate("fp", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


PENDING = "SELECT content_id, arg_min(id, {order}) AS track_id, arg_min(path, {order}) AS path FROM track WHERE present AND content_id NOT IN (SELECT content_id FROM {done}) GROUP BY content_id"


def pending_query(name: str, done_sql: str, done, by_path: bool = False):
    body = PENDING.format(order="path" if by_path else "id", done=done_sql)
    query(name, body)(lambda lib: I.pending(lib.track, done(lib), by_path=by_path))


pending_query("src_fp_pending", "(SELECT content_id FROM fingerprint WHERE content_id % 3 <> 0) d", lambda lib: lib.fingerprint.where("content_id % 3 <> 0"), by_path=True)
pending_query("src_feature_scan", "features", lambda lib: lib.features)
pending_query("src_embed_scan", "embedding", lambda lib: lib.embedding)
pending_query("src_quality_scan", "quality_flag", lambda lib: lib.quality_flag)
pending_query("src_bandwidth_scan", "bandwidth", lambda lib: lib.bandwidth)


@query("src_load_fps", "SELECT content_id, len(fp) AS n FROM fingerprint WHERE content_id IN (SELECT content_id FROM track WHERE present)")
def _(lib):
    return lib.fingerprint.join(lib.track.where("present"), "content_id", "left_semi").select("content_id", F.size("fp").alias("n"))


REPORTS = "SELECT id, 'mean_volume: -' || (id % 40) || '.' || (id % 10) || ' dB' || chr(10) || 'max_volume: ' || CASE WHEN id % 6 = 0 THEN '0.0' ELSE '-' || (id % 9) || '.5' END || ' dB' || chr(10) || repeat('silence_start: 1' || chr(10), (id % 3)::BIGINT) AS log FROM content"


@query(
    "src_quality_analyze",
    f"""SELECT id, peak_db, mean_db, peak_db >= 0 AS clipping, mean_db < -30 AS low_volume, silences AS silence_sections FROM (SELECT id, regexp_extract(log, 'max_volume: (-?[0-9.]+) dB', 1)::DOUBLE AS peak_db,
    regexp_extract(log, 'mean_volume: (-?[0-9.]+) dB', 1)::DOUBLE AS mean_db, len(regexp_extract_all(log, 'silence_start')) AS silences FROM ({REPORTS}))""",
)
def _(lib):
    i = col("id")
    text = lambda c: c.cast("string")
    log = F.concat(F.lit("mean_volume: -"), text(i % 40), F.lit("."), text(i % 10), F.lit(" dB\nmax_volume: "), F.when(i % 6 == 0, "0.0").otherwise(F.concat(F.lit("-"), text(i % 9), F.lit(".5"))), F.lit(" dB\n"), F.expr("repeat('silence_start: 1\n', cast(id % 3 as int))"))
    return files.volume_flags(lib.content.select("id", log.alias("log")), "log").drop("log")


@query("src_bandwidth_measure")
def _(lib):
    return files.measure_bandwidth(lib.embedding.select(col("content_id").alias("id"), "vector"))


@query("src_json_cache", "SELECT request_hash, content_id FROM lookup WHERE content_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def _(lib):
    done = lib.table("part").where("p_partkey % 3 = 0").select(col("p_partkey").alias("content_id"))
    return lib.lookup.join(done, "content_id", "left_anti").select("request_hash", "content_id")


@query("src_pairs_json", """SELECT "set", list_sort(list(DISTINCT expect)) AS labels, list_sort(list(DISTINCT expect)) = [0, 1, 2] AS complete FROM (SELECT doc_id % 3 AS expect, CASE WHEN doc_id % 4 = 0 THEN 'holdout' ELSE 'calibrate' END AS "set" FROM documents) GROUP BY "set" """)
def _(lib):
    text = F.to_json(F.struct(col("doc_id").cast("string").alias("a"), (col("doc_id") % 3).cast("int").alias("expect"), F.when(col("doc_id") % 4 == 0, "holdout").otherwise("calibrate").alias("set")))
    return files.labelled_pairs(lib.table("documents").select(text.alias("line")), "line")


# --- sinks and state ---------------------------------------------------------

NEW = "SELECT content_id, bpm + 1 AS bpm FROM features WHERE content_id % 3 = 0 UNION ALL SELECT id, 99.0 FROM content WHERE id % 8 = 5"


@query("snk_upsert", f"SELECT content_id, bpm FROM features WHERE content_id NOT IN (SELECT content_id FROM ({NEW})) UNION ALL {NEW}")
def _(lib):
    new = lib.features.where("content_id % 3 = 0").select("content_id", (col("bpm") + 1).alias("bpm")).unionByName(lib.content.where("id % 8 = 5").select(col("id").alias("content_id"), F.lit(99.0).alias("bpm")))
    return I.upsert(lib.features.select("content_id", "bpm"), new, ["content_id"])


@query("snk_snapshot", "SELECT 7 AS run_id, t.id AS track_id, t.path, t.size, t.mtime, c.audio_hash, c.hash_method FROM track t JOIN content c ON c.id = t.content_id WHERE t.present")
def _(lib):
    c = lib.content.select(col("id").alias("content_id"), col("audio_hash").alias("hash"), "hash_method")
    return lib.track.where("present").join(c, "content_id").select(F.lit(7).alias("run_id"), col("id").alias("track_id"), "path", "size", "mtime", col("hash").alias("audio_hash"), "hash_method")


def groups(lib):
    g = col("content_id")
    return G.identical(lib.track).select(
        g.alias("group_id"), F.when(g % 3 == 0, 0).when(g % 3 == 1, 1).otherwise(2).alias("tier"), (g % 5 == 0).alias("chain"), F.element_at(F.array(*map(F.lit, ("pending", "approved", "applied", "rejected"))), (g % 4 + 1).cast("int")).alias("decision"), g.alias("content_id")
    )


def members(lib):
    return groups(lib).join(lib.track.where("present"), "content_id")


@query("snk_txn")
def _(lib):
    return files.replace_table(lib.features.select("content_id", "bpm"))


@query("snk_approve", "SELECT group_id, CASE WHEN decision = 'pending' AND tier IN (0, 1) AND NOT chain THEN 'approved' ELSE decision END AS decision FROM grp")
def _(lib):
    return groups(lib).select("group_id", G.approved(col("decision"), col("tier"), col("chain")).alias("decision"))


@query("snk_approve_tier", "SELECT group_id FROM grp WHERE tier = 1 AND NOT chain AND decision = 'pending' ORDER BY group_id")
def _(lib):
    return groups(lib).where("tier = 1 and decision = 'pending'").where(G.eligible(col("tier"), col("chain"))).select("group_id").orderBy("group_id")


TAGS = "(CASE WHEN coalesce(tag_title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(tag_artist, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(tag_album, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(tag_genre, '') <> '' THEN 1 ELSE 0 END)"
SUFFIX = "lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1))"
LOSSLESS = f"{SUFFIX} IN ('.flac', '.wav', '.alac', '.ape', '.wv')"
CUT = "CASE WHEN cliff_db IS NOT NULL THEN coalesce(cutoff_hz, 21000) END"
RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY contender DESC, lossless DESC, coalesce(bitrate, 0) DESC, tags DESC, coalesce(duration, 0) DESC, mtime IS NULL, mtime ASC, path ASC) AS place FROM
  (SELECT m.*, c.duration, {TAGS} AS tags, {LOSSLESS} AS lossless, {CUT} AS cutoff, count(*) OVER (PARTITION BY group_id) AS members,
   bool_or({CUT} IS NULL) OVER (PARTITION BY group_id) OR coalesce({CUT} >= max({CUT}) OVER (PARTITION BY group_id) - 1500, false) OR {LOSSLESS} AS contender
   FROM member m JOIN content c ON c.id = m.content_id LEFT JOIN bandwidth b ON b.content_id = m.content_id) WHERE members > 1)"""
KEEPERS = f"(SELECT r.*, r.place = 1 OR (r.dev IS NOT DISTINCT FROM k.dev AND r.inode IS NOT DISTINCT FROM k.inode) AS is_keeper FROM {RANKED} r JOIN (SELECT group_id, dev, inode FROM {RANKED} WHERE place = 1) k USING (group_id))"


def ranked(lib):
    rows = members(lib).join(lib.content.select(col("id").alias("content_id"), "duration"), "content_id").join(lib.bandwidth, "content_id", "left")
    return R.ranked(rows.withColumn("tag_completeness", I.tag_completeness("tag_title", "tag_artist", "tag_album", "tag_genre")))


@query("snk_quarantine_plan", f"SELECT id, group_id FROM {KEEPERS} x WHERE decision = 'approved' AND NOT is_keeper AND group_id IN (SELECT group_id FROM {KEEPERS} WHERE is_keeper GROUP BY group_id HAVING bool_and(id % 7 <> 0))")
def _(lib):
    return G.quarantine_plan(ranked(lib), col("id") % 7 != 0).select("id", "group_id")


# the listing when the plan is carried out, in which some files have grown or are gone; and later, when it is undone
FOUND = "(SELECT path, size + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS size, mtime FROM track WHERE id % 5 <> 0)"
LATER = "(SELECT path FROM track WHERE id % 2 = 0)"
LOSERS = f"(SELECT x.* FROM {KEEPERS} x WHERE decision = 'approved' AND NOT is_keeper)"
MOVED = f"(SELECT l.*, CASE WHEN n.path IS NULL THEN 'gone' WHEN n.size IS NOT DISTINCT FROM l.size AND n.mtime IS NOT DISTINCT FROM l.mtime THEN 'moved' ELSE 'skipped' END AS state FROM {LOSERS} l LEFT JOIN {FOUND} n ON n.path = l.path)"


def applied(lib):
    now = lib.track.where("id % 5 <> 0").select("path", (col("size") + F.when(col("id") % 3 == 0, 1).otherwise(0)).alias("size"), "mtime")
    return G.apply_moves(ranked(lib).where("decision = 'approved' and not is_keeper"), now)


@query("snk_quarantine_apply", f"SELECT id, path, state, 'applied' AS decision, present AND state <> 'moved' AS present FROM {MOVED}")
def _(lib):
    return applied(lib).select("id", "path", "state", F.lit("applied").alias("decision"), (col("present") & (col("state") != "moved")).alias("present"))


@query("snk_undo", f"SELECT m.id, CASE WHEN n.path IS NULL THEN 'restored' ELSE 'occupied' END AS state, n.path IS NULL AS present FROM {MOVED} m LEFT JOIN {LATER} n ON n.path = m.path WHERE m.state = 'moved'")
def _(lib):
    rows = G.undo_moves(applied(lib), lib.track.where("id % 2 = 0").select("path"))
    return rows.select("id", "state", (col("state") == "restored").alias("present"))


@query(
    "snk_quarantine_dest",
    """SELECT id, CASE WHEN root IS NOT NULL THEN root || '/.quarantine' || substr(path, length(root) + 1) ELSE substr(path, 1, length(path) - length(name)) || '.quarantine/' || name END AS dst FROM
    (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN starts_with(path, '/lib/src1/') THEN '/lib/src1' WHEN starts_with(path, '/lib/src2/') THEN '/lib/src2' WHEN starts_with(path, '/lib/src3/en/') THEN '/lib/src3/en' END AS root FROM track)""",
)
def _(lib):
    return lib.track.select("id", I.quarantine_path(col("path"), ["/lib/src1", "/lib/src2", "/lib/src3/en"]).alias("dst"))


@query("snk_render", "SELECT id, rpad(coalesce(tag_artist, '?'), 12, ' ') || ' ' || replace(replace(replace(path, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r') AS line FROM track WHERE present")
def _(lib):
    return lib.track.where("present").select("id", F.concat(F.rpad(F.coalesce("tag_artist", F.lit("?")), 12, " "), F.lit(" "), S.escape_path(col("path"))).alias("line"))


@query("snk_json", """SELECT id, '{"id":' || id || ',"path":"' || path || '","present":' || present || '}' AS json FROM track""")
def _(lib):
    return lib.track.select("id", F.to_json(F.struct("id", "path", "present")).alias("json"))


# --- filters and projections -----------------------------------------------------

BROWSE = "track t LEFT JOIN features f USING (content_id)"


def browse(lib):
    return lib.track.join(lib.features, "content_id", "left")


@query("flt_present", "SELECT id FROM track WHERE present")
def _(lib):
    return lib.track.where("present").select("id")


@query("flt_browse_dynamic", f"SELECT id, bpm, key_name FROM {BROWSE} WHERE present AND translate(tag_genre, 'EN', 'en') LIKE '%en%' AND bpm >= 60 AND bpm < 180 AND key_name = 'C'")
def _(lib):
    rows = browse(lib).where("present")
    for condition in (S.like_nocase(col("tag_genre"), "EN"), (col("bpm") >= 60) & (col("bpm") < 180), col("key_name") == "C"):
        rows = rows.where(condition)
    return rows.select("id", "bpm", "key_name")


@query("flt_like", "SELECT id FROM track WHERE translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%src_/e%.mp3%'")
def _(lib):
    return lib.track.where(S.like_nocase(col("path"), "SRC_/E%.mp3")).select("id")


@query("flt_range_half_open", "SELECT content_id, bpm FROM features WHERE bpm >= 100 AND bpm < 140")
def _(lib):
    return lib.features.where((col("bpm") >= 100) & (col("bpm") < 140)).select("content_id", "bpm")


@query("flt_prefix_exact", "SELECT id FROM track WHERE substr(path, 1, 10) = '/lib/src1/'")
def _(lib):
    return lib.track.where(col("path").startswith("/lib/src1/")).select("id")


@query("flt_in_list", "SELECT id, path FROM track WHERE content_id IN (0, 2, 3, 5, 8, 13, 21, 34)")
def _(lib):
    return lib.track.where(col("content_id").isin(0, 2, 3, 5, 8, 13, 21, 34)).select("id", "path")


@query("flt_is_missing", "SELECT content_id, coalesce(bpm IS NULL OR bpm <= 0, true) AS no_bpm, coalesce(key_name IS NULL OR key_name = '', true) AS no_key, energy IS NULL AS no_energy FROM features")
def _(lib):
    return lib.features.select("content_id", S.is_missing(col("bpm"), positive=True).alias("no_bpm"), S.is_missing(col("key_name"), text=True).alias("no_key"), S.is_missing(col("energy")).alias("no_energy"))


@query("flt_bare_min_row", "SELECT content_id, min(id) AS id, arg_min(path, id) AS path FROM track GROUP BY content_id")
def _(lib):
    return lib.track.groupBy("content_id").agg(F.min("id").alias("id"), F.min_by("path", "id").alias("path"))


@query("prj_generated", f"SELECT id, {TAGS} AS tag_completeness FROM track")
def _(lib):
    return lib.track.select("id", I.tag_completeness("tag_title", "tag_artist", "tag_album", "tag_genre").alias("tag_completeness"))


@query("prj_case_labels", "SELECT content_id, CASE WHEN bpm < 80 THEN 'Slow' WHEN bpm > 120 THEN 'Upbeat' ELSE 'Mid-tempo' END AS tempo, CASE WHEN energy < 0.3 THEN 'Calm' WHEN energy > 0.7 THEN 'Energetic' ELSE 'Moderate' END AS energy_word FROM features")
def _(lib):
    return lib.features.select("content_id", S.tempo_word(col("bpm"), F.lit(80.0), F.lit(120.0)).alias("tempo"), S.energy_word(col("energy"), F.lit(0.3), F.lit(0.7)).alias("energy_word"))


# --- joins ----------------------------------------------------------------------


@query("jn_inner", "SELECT t.id, c.codec, f.bpm FROM track t JOIN content c ON c.id = t.content_id JOIN features f ON f.content_id = c.id")
def _(lib):
    return lib.track.join(lib.content.select(col("id").alias("content_id"), "codec"), "content_id").join(lib.features, "content_id").select("id", "codec", "bpm")


@query("jn_left", "SELECT t.id, f.bpm, b.cutoff_hz FROM track t LEFT JOIN features f USING (content_id) LEFT JOIN bandwidth b USING (content_id)")
def _(lib):
    return browse(lib).join(lib.bandwidth, "content_id", "left").select("id", "bpm", "cutoff_hz")


@query("jn_anti_left_null", "SELECT c.id FROM content c LEFT JOIN bandwidth b ON b.content_id = c.id WHERE b.content_id IS NULL")
def _(lib):
    return lib.content.join(lib.bandwidth.select(col("content_id").alias("id")), "id", "left_anti").select("id")


@query("jn_anti_not_exists", "SELECT id FROM content c WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.content_id = c.id)")
def _(lib):
    return lib.content.join(lib.features.select(col("content_id").alias("id")), "id", "left_anti").select("id")


@query("jn_semi_exists", "SELECT id FROM content c WHERE EXISTS (SELECT 1 FROM track t WHERE t.content_id = c.id AND t.present)")
def _(lib):
    return lib.content.join(lib.track.where("present").select(col("content_id").alias("id")), "id", "left_semi").select("id")


@query("jn_semi_in", "SELECT id FROM track WHERE content_id IN (SELECT content_id FROM assignment WHERE cluster_id = (SELECT max(cluster_id) FROM assignment))")
def _(lib):
    a = lib.embedding.where("content_id % 10 <> 7").select("content_id", col("label").alias("cluster_id"))
    last = a.agg(F.max("cluster_id").alias("cluster_id"))
    return lib.track.join(a.join(F.broadcast(last), "cluster_id", "left_semi"), "content_id", "left_semi").select("id")  # one row


MOVES = "(SELECT id AS track_id, k, '/lib/.quarantine/' || k || '/' || id AS dst FROM track, (SELECT unnest([1, 2, 3]) AS k) WHERE id % 6 = 0 AND (id + k) % 2 = 0)"


def moves(lib):
    rows = lib.track.where("id % 6 = 0").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where((col("id") + col("k")) % 2 == 0)
    return rows.select(col("id").alias("track_id"), "k", F.concat(F.lit("/lib/.quarantine/"), col("k").cast("string"), F.lit("/"), col("id").cast("string")).alias("dst"))


@query("jn_correlated_latest", f"SELECT id, (SELECT dst FROM {MOVES} m WHERE m.track_id = t.id ORDER BY k DESC LIMIT 1) AS dst FROM track t")
def _(lib):
    last = moves(lib).groupBy(col("track_id").alias("id")).agg(F.max_by("dst", "k").alias("dst"))
    return lib.track.select("id").join(last, "id", "left")


@query("jn_combinations", "SELECT a.group_id, a.id AS a, b.id AS b FROM member a JOIN member b ON a.group_id = b.group_id AND a.id < b.id")
def _(lib):
    m = members(lib).select("group_id", "id")
    return m.select("group_id", col("id").alias("a")).join(m.select("group_id", col("id").alias("b")), "group_id").where("a < b")


@query("jn_null_safe_inode", "SELECT a.id AS a, b.id AS b FROM member a JOIN member b ON a.group_id = b.group_id AND a.id < b.id AND a.dev IS NOT DISTINCT FROM b.dev AND a.inode IS NOT DISTINCT FROM b.inode")
def _(lib):
    m = members(lib).select("group_id", "id", "dev", "inode")
    a, b = m.alias("a"), m.alias("b")
    on = (col("a.group_id") == col("b.group_id")) & col("a.dev").eqNullSafe(col("b.dev")) & col("a.inode").eqNullSafe(col("b.inode")) & (col("a.id") < col("b.id"))
    return a.join(b, on).select(col("a.id").alias("a"), col("b.id").alias("b"))


# --- ranking ----------------------------------------------------------------------


@query("win_keeper_rank", f"SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {LOSSLESS} DESC, coalesce(bitrate, 0) DESC, {TAGS} DESC, n_chars / 10.0 DESC, mtime IS NULL, mtime ASC, path ASC) AS place FROM member")
def _(lib):
    rows = members(lib).withColumn("duration", col("n_chars") / 10.0).withColumn("tag_completeness", I.tag_completeness("tag_title", "tag_artist", "tag_album", "tag_genre"))
    return rows.select("id", "group_id", F.row_number().over(Window.partitionBy("group_id").orderBy(*R.keeper_order())).alias("place"))


@query("win_bandwidth_contenders", f"SELECT id, contender FROM (SELECT id, bool_or({CUT} IS NULL) OVER w OR coalesce({CUT} >= max({CUT}) OVER w - 1500, false) OR {LOSSLESS} AS contender FROM (SELECT m.*, b.cutoff_hz, b.cliff_db, m.content_id // 20 AS g FROM member m LEFT JOIN bandwidth b USING (content_id)) WINDOW w AS (PARTITION BY g))")
def _(lib):
    rows = members(lib).join(lib.bandwidth, "content_id", "left").withColumn("g", F.floor(col("content_id") / 20))
    return R.contenders(rows, "g").select("id", "contender")


@query("win_rank_group", f"SELECT group_id, id, path, place, is_keeper FROM {KEEPERS} x WHERE tier IN (0, 1) AND NOT chain")
def _(lib):
    return ranked(lib).where(G.eligible(col("tier"), col("chain"))).select("group_id", "id", "path", "place", "is_keeper")


@query("win_latest_run", "SELECT method, max(run_id) AS run_id FROM cluster_run GROUP BY method")
def _(lib):
    runs = lib.spark.createDataFrame([(1, "kmeans"), (2, "embedding"), (3, "embedding")], "run_id int, method string")
    return I.latest(runs, ["method"], "run_id").select("method", "run_id")


FOLD = "translate(tag_artist, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("srt_browse", f"SELECT id, tag_artist, bpm FROM {BROWSE} WHERE present ORDER BY {FOLD} NULLS FIRST, id LIMIT 40 OFFSET 20")
def _(lib):
    return browse(lib).where("present").orderBy(S.nocase(col("tag_artist")).asc_nulls_first(), "id").select("id", "tag_artist", "bpm").offset(20).limit(40)


@query("srt_topn_counts", "SELECT tag_artist, count(*) AS n FROM track GROUP BY tag_artist ORDER BY n DESC, tag_artist NULLS FIRST LIMIT 10")
def _(lib):
    return lib.track.groupBy("tag_artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col("tag_artist").asc_nulls_first()).limit(10)


@query("set_subset_actionable", "SELECT content_id FROM tier0 WHERE content_id NOT IN (SELECT group_id FROM grp WHERE tier = 1 AND NOT chain)")
def _(lib):
    actionable = groups(lib).where("tier = 1 and not chain").select("content_id")
    return G.identical(lib.track).join(actionable, "content_id", "left_anti").select("content_id")


@query("rep_content_paths", f"SELECT content_id, list(coalesce(m.dst, t.path) ORDER BY t.id) AS paths FROM track t LEFT JOIN (SELECT track_id, arg_max(dst, k) AS dst FROM {MOVES} GROUP BY track_id) m ON m.track_id = t.id GROUP BY content_id")
def _(lib):
    last = moves(lib).groupBy(col("track_id").alias("id")).agg(F.max_by("dst", "k").alias("dst"))
    rows = lib.track.join(last, "id", "left").select("content_id", "id", F.coalesce("dst", "path").alias("path"))
    return rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("id", "path"))).alias("x")).select("content_id", col("x.path").alias("paths"))


@query(
    "rep_report",
    """SELECT g.group_id, g.tier, count(*) AS n_members, string_agg(m.path, '|' ORDER BY m.path) AS paths, string_agg(DISTINCT CASE WHEN m.bitrate IS NULL THEN 'no bit rate' WHEN m.mtime IS NULL THEN 'no time' END, '|' ORDER BY CASE WHEN m.bitrate IS NULL THEN 'no bit rate' WHEN m.mtime IS NULL THEN 'no time' END) AS warnings
    FROM grp g JOIN member m ON m.group_id = g.group_id GROUP BY g.group_id, g.tier""",
)
def _(lib):
    warning = F.when(col("bitrate").isNull(), "no bit rate").when(col("mtime").isNull(), "no time")
    rows = members(lib).groupBy("group_id", "tier").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.sort_array(F.collect_list("path")), "|").alias("paths"), F.sort_array(F.collect_set(warning)).alias("w"))
    return rows.select("group_id", "tier", "n_members", "paths", F.when(F.size("w") > 0, F.array_join("w", "|")).alias("warnings"))


@query("grp_tier0", "SELECT content_id, n FROM tier0")
def _(lib):
    return G.identical(lib.track)


@query("grp_write", "SELECT group_id, id AS track_id FROM member")
def _(lib):
    return G.members(groups(lib), lib.track).select("group_id", col("id").alias("track_id"))
