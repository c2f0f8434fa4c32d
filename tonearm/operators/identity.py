"""Identity of contents and files, incremental merges and pending sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_content_id(rows: DataFrame, hash_col: str, id_col: str, name: str = "content_id") -> DataFrame:
    """Each row with the smallest id that has its hash.  An aggregation and a join, so that a hash with very many rows is combined before it is shuffled."""
    least = rows.groupBy(hash_col).agg(F.min(id_col).alias(name))
    return rows.join(least, hash_col)


def identity(stream_hash: Column, whole_hash: Column, codec: Column, sample_rate: Column) -> tuple[Column, Column]:
    """(hash, method): the stream's hash, or the file's if the stream is valid audio, or nothing."""
    valid = codec.isNotNull() & (sample_rate > 0)
    found = F.coalesce(stream_hash, F.when(valid, whole_hash))
    return found, F.when(stream_hash.isNotNull(), "stream").when(found.isNotNull(), "whole_file")


def retry(errors: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("dev", "inode", "size", "mtime")) -> DataFrame:
    """Files to try: those without an unresolved error, or changed since it (nulls compare as equal)."""
    old = errors.select("path", *[F.col(k).alias(f"old_{k}") for k in keys], F.lit(True).alias("failed"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"old_{k}"))
    both = seen.join(old, "path", "left")
    return both.withColumn("retry", F.coalesce(~(F.col("failed") & same), F.lit(True))).drop("failed", *[f"old_{k}" for k in keys])


def record_errors(events: DataFrame) -> DataFrame:
    """(path, stage, message, at): the last of each path, and how many there were."""
    last = F.max_by(F.struct("stage", "message"), F.struct("at", "id"))
    return events.groupBy("path").agg(last.alias("x"), F.count(F.lit(1)).alias("attempts"), F.max("at").alias("last_at")).select("path", "x.stage", "x.message", "attempts", "last_at")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; within a side the keys are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_scan(before: DataFrame, now: DataFrame, roots: list[str]) -> DataFrame:
    """State of every file after a scan: unchanged (size and mtime equal and content known), changed, new, or absent (under a root but not seen)."""
    a, b = before.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    under = F.lit(False)
    for root in roots:
        under = under | F.col("a.path").startswith(root.rstrip("/") + "/")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.content_id").isNotNull()
    state = F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), F.when(under, "absent").otherwise("untouched")).when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce("b.path", "a.path").alias("path"), state.alias("state"), F.coalesce("b.size", "a.size").alias("size"), F.col("b.path").isNotNull().alias("seen"))


def pending(tracks: DataFrame, done: DataFrame, on: list[str] | None = None, by_path: bool = False) -> DataFrame:
    """(content_id, track_id, path) of contents with a present file and no artifact: the first file by id, or by path."""
    todo = tracks.where("present").join(done.select("content_id"), "content_id", "left_anti")
    order = "path" if by_path else "id"
    return todo.groupBy("content_id").agg(F.min_by("id", order).alias("track_id"), F.min_by("path", order).alias("path"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def tag_completeness(*tags: str) -> Column:
    """How many tags are neither null nor empty."""
    total = F.lit(0)
    for t in tags:
        total = total + F.when(F.coalesce(F.col(t), F.lit("")) != "", 1).otherwise(0)
    return total


def longest_root(path: Column, roots: list[str]) -> Column:
    """The longest root that the path is under, or null."""
    found = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        found = F.when(path.startswith(root.rstrip("/") + "/"), root).otherwise(found)
    return found


def quarantine_path(path: Column, roots: list[str], folder: str = ".quarantine") -> Column:
    """Where a file goes: under its root with the same relative path, else beside it."""
    root = longest_root(path, roots)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    parent = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.when(root.isNotNull(), F.concat(root, F.lit(f"/{folder}"), F.substring(path, F.length(root) + 1, F.length(path)))).otherwise(F.concat(parent, F.lit(f"{folder}/"), name))
