"""The library's tables as SQL over the driver's tables, for the checks against another engine."""

from __future__ import annotations

import math
import re

def smooth_sql(sigma: float = 8.0) -> str:
    """Mean of e under a normal curve along window w; head and tail stand beyond the ends."""
    far = round(4 * sigma)
    share = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(far + 1)}
    total = share[0] + 2 * sum(share[k] for k in range(1, far + 1))
    beside = " + ".join(f"{share[k]!r}::DOUBLE * (coalesce(lag(e, {k}) OVER w, head) + coalesce(lead(e, {k}) OVER w, tail))" for k in range(1, far + 1))
    return f"(e + {beside}) / {total!r}::DOUBLE"


def evidence_views(p: str, pairs: str) -> dict[str, str]:
    """Alignment, bit errors, segments and evidence of the pairs (a, b) of a view."""
    ends = "OVER (PARTITION BY a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    piece = "{'c': 1::BIGINT, 's': start::BIGINT, 'z': (start + n)::BIGINT, 'n': n::BIGINT, 'e': wrong::BIGINT}"
    return {
        f"{p}offset_vote": f"SELECT c.a, c.b, x.pos - y.pos AS delta, count(*) AS votes FROM {pairs} c JOIN keyed x ON x.content_id = c.a JOIN keyed y ON y.content_id = c.b AND y.key = x.key GROUP BY ALL",
        f"{p}alignment": f"""SELECT c.a, c.b, coalesce(v.delta, 0) AS best_offset, coalesce(v.votes, 0) AS peak_votes, coalesce(v.total, 0) AS total_votes FROM {pairs} c LEFT JOIN
            (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, delta) AS n, sum(votes) OVER (PARTITION BY a, b)::BIGINT AS total FROM {p}offset_vote) v
            ON v.a = c.a AND v.b = c.b AND v.n = 1 AND v.votes > 1""",
        f"{p}overlap": f"SELECT v.*, x.fp AS fa, y.fp AS fb, greatest(best_offset, 0) AS lo, least(len(x.fp), len(y.fp) + best_offset) AS hi FROM {p}alignment v JOIN fingerprint x ON x.content_id = v.a JOIN fingerprint y ON y.content_id = v.b",
        f"{p}error": f"SELECT a, b, i, bit_count(xor(x, y))::INT AS e FROM (SELECT a, b, unnest(range(lo, hi)) AS i, unnest(fa[lo + 1:hi]) AS x, unnest(fb[lo - best_offset + 1:hi - best_offset]) AS y FROM {p}overlap WHERE hi > lo)",
        f"{p}smoothed": f"SELECT a, b, i, e, round({smooth_sql()}, 9) AS s FROM (SELECT *, first_value(e) {ends} AS head, last_value(e) {ends} AS tail FROM {p}error) WINDOW w AS (PARTITION BY a, b ORDER BY i)",
        f"{p}slope": f"SELECT a, b, i, round(abs(CASE WHEN p IS NULL THEN n - s WHEN n IS NULL THEN s - p ELSE (n - p) / 2 END), 9) AS g FROM (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n FROM {p}smoothed WINDOW w AS (PARTITION BY a, b ORDER BY i))",
        f"{p}top": f"SELECT a, b, i, i - row_number() OVER (PARTITION BY a, b ORDER BY i) AS level FROM (SELECT *, lag(g) OVER w AS p, lead(g) OVER w AS n FROM {p}slope WINDOW w AS (PARTITION BY a, b ORDER BY i)) WHERE g > 0.15 AND g >= p AND g >= n",
        f"{p}steep": f"SELECT a, b, i FROM (SELECT *, min(i) OVER (PARTITION BY a, b, level) AS first FROM {p}top) WHERE (i - first) % 2 = 0",
        f"{p}piece": f"SELECT a, b, min(i) AS start, count(*) AS n, sum(e) AS wrong FROM (SELECT x.a, x.b, x.i, x.e, count(y.i) OVER (PARTITION BY x.a, x.b ORDER BY x.i) AS k FROM {p}error x LEFT JOIN {p}steep y ON y.a = x.a AND y.b = x.b AND y.i = x.i) GROUP BY a, b, k",
        f"{p}segment": f"""SELECT a, b, sum(n)::BIGINT AS span_items, sum(wrong)::BIGINT AS wrong, list_reduce(list({piece} ORDER BY start), lambda x, y: CASE WHEN x.z = y.s AND abs(x.e / x.n - y.e / y.n) < 0.7
            THEN {{'c': x.c, 's': x.s, 'z': y.z, 'n': x.n + y.n, 'e': x.e + y.e}} ELSE {{'c': x.c + 1, 's': y.s, 'z': y.z, 'n': y.n, 'e': y.e}} END).c::INT AS segment_count FROM {p}piece WHERE wrong / n < 10 GROUP BY a, b""",
        f"{p}evidence": f"""SELECT o.a, o.b, best_offset, peak_votes, CASE WHEN total_votes > 0 THEN peak_votes / total_votes ELSE 0 END AS ratio, coalesce(span_items, 0) AS span_items, coalesce(span_items, 0) * (1365 / 11025.0::DOUBLE) AS span, len(fa) AS n_a, len(fb) AS n_b,
            coalesce(span_items, 0) / len(fa) AS coverage_a, coalesce(span_items, 0) / len(fb) AS coverage_b, coalesce(wrong / span_items, 0) AS bit_error, coalesce(segment_count, 0) AS segment_count FROM {p}overlap o LEFT JOIN {p}segment s ON s.a = o.a AND s.b = o.b AND peak_votes > 0""",
    }


def tiered_sql(view: str) -> str:
    return f"""SELECT *, CASE WHEN span_items = 0 OR ratio < 0.05 THEN -1 WHEN least(coverage_a, coverage_b) >= 0.85 AND bit_error <= 6 AND span >= 20 THEN 1
        WHEN greatest(coverage_a, coverage_b) >= 0.85 AND span >= 15 THEN 2 WHEN least(coverage_a, coverage_b) > 0 AND span >= 15 THEN 2 ELSE -1 END AS tier FROM {view}"""


#: Views that refer to themselves.
RECURSIVE = {"grown"}

VIEWS: dict[str, str] = {
    "track0": """SELECT doc_id AS id, '/lib/' || source || '/' || lang || '/' || doc_id || '.' || (['flac','mp3','m4a','ogg','opus','wav','aiff','wv'])[doc_id % 8 + 1] AS path,
        n_chars AS size, CASE WHEN doc_id % 11 <> 0 THEN (1700000000 + (doc_id * 37) % 1000)::DOUBLE END AS mtime, CASE WHEN doc_id % 13 <> 0 THEN 1::BIGINT END AS dev,
        CASE WHEN doc_id % 13 <> 0 THEN doc_id - doc_id % 2 END AS inode, CASE WHEN doc_id % 7 <> 0 THEN 128000 + (doc_id % 5) * 48000 END AS bitrate,
        CASE WHEN doc_id % 4 <> 0 THEN 'Title ' || doc_id END AS tag_title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS tag_artist,
        CASE WHEN doc_id % 6 <> 0 THEN 'Album ' || (doc_id % 50) END AS tag_album, CASE WHEN doc_id % 9 <> 0 THEN lang END AS tag_genre, doc_id % 10 <> 3 AS present, n_chars, sha256(text) AS audio_hash
        FROM documents""",
    "track": "SELECT *, min(id) OVER (PARTITION BY audio_hash) AS content_id FROM track0",
    "content": """SELECT id, audio_hash, CASE WHEN id % 6 = 0 THEN 'whole_file' ELSE 'stream' END AS hash_method, n_chars / 10.0::DOUBLE AS duration,
        (['flac','mp3','aac'])[id % 3 + 1] AS codec, CASE WHEN id % 2 = 0 THEN 44100 ELSE 48000 END AS sample_rate FROM track WHERE id = content_id""",
    "features": """SELECT id AS content_id, CASE WHEN id % 17 <> 0 THEN 50 + (id * 31 % 1700) / 10.0::DOUBLE END AS bpm,
        CASE WHEN id % 14 <> 0 THEN (['C','C#','Db','D','Eb','E','F','F#','G','Ab','A','Bb'])[id % 12 + 1] END AS key_name, CASE WHEN id % 2 = 0 THEN 'major' ELSE 'minor' END AS scale,
        CASE WHEN id % 19 <> 0 THEN (id * 7 % 100) / 100.0::DOUBLE END AS energy, (-30 + id % 25)::DOUBLE AS loudness, (1000 + id * 13 % 3000)::DOUBLE AS centroid, (id * 11 % 100) / 100.0::DOUBLE AS danceability
        FROM content WHERE id % 8 <> 5""",
    "embedding": "SELECT vec_id AS content_id, embedding::DOUBLE[] AS vector, label FROM embeddings",
    "scored": "SELECT content_id, bpm, key_name, scale, energy, vector[1:13] AS mfcc FROM features JOIN embedding USING (content_id)",
    "bandwidth": "SELECT id AS content_id, CASE WHEN id % 5 <> 0 THEN (12000 + (id % 17) * 500)::DOUBLE END AS cutoff_hz, CASE WHEN id % 23 <> 0 THEN (12 + id % 20)::DOUBLE END AS cliff_db FROM content WHERE id % 9 <> 4",
    "quality_flag": "SELECT doc_id AS content_id, toxic = 1 AS clipping, quality = 0 AS low_volume, doc_id % 3 AS silence_sections FROM labels",
    "word_list": """SELECT doc_id AS content_id, list_filter(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' '), lambda x: x <> '') AS words
        FROM documents WHERE doc_id IN (SELECT id FROM content)""",
    "fingerprint": """SELECT content_id, list_transform(range(0, len(words) - 2), lambda i: concat('0x', substr(md5(concat_ws(' ', words[i + 1], words[i + 2], words[i + 3])), 1, 8))::BIGINT) AS fp
        FROM word_list WHERE len(words) >= 3""",
    "item": "SELECT content_id, unnest(fp) AS item, generate_subscripts(fp, 1) - 1 AS pos FROM fingerprint",
    "keyed": "SELECT content_id, pos, item, item >> 8 AS key FROM item",
    "capped": "SELECT content_id, key, pos FROM (SELECT *, row_number() OVER (PARTITION BY content_id, key ORDER BY pos) AS n FROM keyed) WHERE n <= 8",
    "posting": """SELECT * FROM capped WHERE key IN (SELECT key FROM capped GROUP BY key HAVING count(DISTINCT content_id) <=
        (SELECT least(200, greatest(20, floor(0.02 * count(*)))) FROM fingerprint))""",
    "candidate": """SELECT a.content_id AS a, b.content_id AS b, count(*) AS shared FROM (SELECT DISTINCT content_id, key FROM posting) a JOIN (SELECT DISTINCT content_id, key FROM posting) b
        ON a.key = b.key AND a.content_id < b.content_id GROUP BY ALL HAVING count(*) >= 20""",
    "lookup": """SELECT sha256('request ' || p_partkey) AS request_hash, p_partkey AS content_id, CASE WHEN p_partkey % 11 = 0 THEN '{broken' WHEN p_partkey % 7 = 0 THEN '{"status":"ok","results":[]}'
        WHEN p_partkey % 13 = 0 THEN '{"status":"error"}' ELSE '{"status":"ok","results":[' || r1 || ',' || r2 || ']}' END AS response FROM
        (SELECT *, """
    + ", ".join(
        f"""'{{"id":"r' || (p_partkey * 10 + {k}) || '","score":' || ((p_partkey * {s} % 100) / 100.0::DOUBLE) || ',"recordings":[{{"id":"m' || (p_partkey * 10 + {k}) || '","title":"' || p_name || '","artists":[{{"id":"a' || (p_partkey * 3 % 40) || '","name":"Artist ' || (p_partkey * 3 % 40) || '"}},{{"id":"a' || (p_partkey * 7 % 40) || '","name":"Artist ' || (p_partkey * 7 % 40) || '"}}],"releasegroups":[{{"id":"g' || (p_partkey % 30) || '","title":"Album ' || (p_partkey % 30) || '","type":"Album"}}]}}]}}' AS r{k}"""
        for k, s in ((1, 17), (2, 29))
    )
    + " FROM part)",
    "parsed": """SELECT request_hash, content_id, CASE WHEN NOT json_valid(response) OR json_extract_string(response, '$.status') <> 'ok' THEN 'failed' WHEN json_array_length(response, '$.results') = 0 THEN 'no_match' ELSE 'parsed' END AS outcome,
        CASE WHEN json_valid(response) AND json_array_length(response, '$.results') > 0 THEN CASE WHEN json_extract(response, '$.results[1].score')::DOUBLE > json_extract(response, '$.results[0].score')::DOUBLE THEN json_extract(response, '$.results[1]') ELSE json_extract(response, '$.results[0]') END END AS best
        FROM lookup""",
    "tier0": "SELECT content_id, count(*) AS n FROM track WHERE present GROUP BY content_id HAVING count(*) > 1",
    **evidence_views("", "candidate"),
    "tiered": tiered_sql("evidence"),
    "tier_one": "SELECT a, b FROM tiered WHERE tier = 1",
    "grown": "SELECT x AS node, x AS seen FROM (SELECT a AS x FROM tier_one UNION SELECT b FROM tier_one) UNION SELECT r.node, e.y FROM grown r JOIN (SELECT a AS x, b AS y FROM tier_one UNION ALL SELECT b, a FROM tier_one) e ON e.x = r.seen",
    "comp": "SELECT node, min(seen) AS component FROM grown GROUP BY node",
    # all pairs of members, verified directly
    "member_pair": "SELECT x.component, x.node AS a, y.node AS b FROM comp x JOIN comp y ON x.component = y.component AND x.node < y.node",
    **evidence_views("m_", "member_pair"),
    "m_tiered": tiered_sql("m_evidence"),
    "clique": "SELECT p.component, bool_and(t.tier = 1) AS clique FROM member_pair p JOIN m_tiered t ON t.a = p.a AND t.b = p.b GROUP BY p.component",
    # groups over the files of one content, with a decision by rule
    "grp": "SELECT content_id AS group_id, CASE WHEN content_id % 3 = 0 THEN 0 WHEN content_id % 3 = 1 THEN 1 ELSE 2 END AS tier, content_id % 5 = 0 AS chain, (['pending','approved','applied','rejected'])[content_id % 4 + 1] AS decision FROM tier0",
    "member": "SELECT g.group_id, g.tier, g.chain, g.decision, t.* FROM grp g JOIN track t ON t.content_id = g.group_id WHERE t.present",
    "cluster_run": "SELECT * FROM (VALUES (1, 'kmeans'), (2, 'embedding'), (3, 'embedding')) t(run_id, method)",
    "assignment": "SELECT content_id, label AS cluster_id FROM embedding WHERE content_id % 10 <> 7",
    "pairwise": "SELECT x.content_id AS i, y.content_id AS j, list_cosine_similarity(x.vector, y.vector) AS cosine FROM embedding x JOIN embedding y ON x.content_id <> y.content_id",
    "distance": "SELECT i, j, round(1 - cosine, 9) AS d FROM pairwise",
    "neighbour": "SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM distance) WHERE n <= 20",
}


def needed(body: str) -> list[str]:
    """Views that ``body`` refers to, in an order that defines each before its use."""
    out: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and name not in seen and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(body)
    return out


def sql(body: str) -> str:
    """``body`` with the views that it needs as common table expressions."""
    views = needed(body)
    body = body.strip()
    if not views:
        return body
    defined = ",\n".join(f"{v} AS {'' if v in RECURSIVE else 'MATERIALIZED '}({VIEWS[v]})" for v in views)
    again = any(v in RECURSIVE for v in views)
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' * (recursive or again)}{defined},\n{rest[10:] if recursive else rest}"
    return f"WITH {'RECURSIVE ' * again}{defined}\n{body}"
