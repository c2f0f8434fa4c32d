"""Responses of a metadata service, parsed into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERSON = "struct<id:string,name:string>"
RESPONSE = f"struct<status:string,results:array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:array<{PERSON}>,releasegroups:array<struct<id:string,title:string,type:string>>>>>>>"


def best_result(parsed: Column) -> Column:
    """The best-scoring result with recordings, the first of equals; a missing score is 0."""
    some = F.filter(F.coalesce(parsed["results"], F.array().cast(RESPONSE.split("results:", 1)[1][:-1])), lambda r: F.size(r["recordings"]) > 0)
    top = F.array_max(F.transform(some, lambda r: F.coalesce(r["score"], F.lit(0.0))))
    return F.element_at(F.filter(some, lambda r: F.coalesce(r["score"], F.lit(0.0)) == top), 1)


def parse(cache: DataFrame) -> DataFrame:
    """(request_hash, content_id, outcome, score, recording_id, title, artists, release_id, release_title).

    failed: not JSON, not ok, or an artist without id or name; no_match: no result with recordings.
    """
    rows = cache.withColumn("p", F.from_json("response", RESPONSE))
    rows = rows.withColumn("best", F.when(F.size(F.col("p.results")) > 0, best_result(F.col("p"))))
    recording = F.col("best.recordings")[0]
    broken = F.exists(F.coalesce(recording["artists"], F.array().cast(f"array<{PERSON}>")), lambda a: a["id"].isNull() | a["name"].isNull())
    outcome = F.when(F.col("p").isNull() | (F.coalesce("p.status", F.lit("")) != "ok") | F.coalesce(broken, F.lit(False)), "failed").when(F.col("best").isNull(), "no_match").otherwise("parsed")
    ok = lambda c: F.when(outcome == "parsed", c)
    release = F.get(recording["releasegroups"], F.lit(0))
    return rows.select(
        "request_hash", "content_id", outcome.alias("outcome"), ok(F.coalesce(F.col("best.score"), F.lit(0.0))).alias("score"), ok(recording["id"]).alias("recording_id"), ok(recording["title"]).alias("title"),
        ok(recording["artists"]).alias("artists"), ok(release["id"]).alias("release_id"), ok(release["title"]).alias("release_title"),
    )


def recording_artists(parsed: DataFrame) -> DataFrame:
    """(content_id, position, artist_id, name)."""
    return parsed.where("outcome = 'parsed'").select("content_id", F.posexplode("artists").alias("position", "x")).select("content_id", "position", F.col("x.id").alias("artist_id"), F.col("x.name").alias("name"))


def backfill(rows: DataFrame, json_col: str) -> DataFrame:
    """Artists of a JSON array column, in order."""
    people = F.from_json(F.col(json_col), f"array<{PERSON}>")
    return rows.select("content_id", F.posexplode(people).alias("position", "x")).select("content_id", "position", F.col("x.id").alias("artist_id"), F.col("x.name").alias("name"))
