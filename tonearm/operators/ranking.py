"""Which copy of a group to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import scalars as S

TOLERANCE_HZ = 1500.0


def lossless(path: Column) -> Column:
    return S.extension(path).isin(*S.LOSSLESS)


def keeper_order() -> list[Column]:
    """Best first: lossless, bit rate, tags, length, known and oldest time; then the path."""
    return [F.desc(lossless(F.col("path"))), F.desc(F.coalesce("bitrate", F.lit(0))), F.desc(F.coalesce("tag_completeness", F.lit(0))), F.desc(F.coalesce("duration", F.lit(0.0))), F.col("mtime").isNull(), F.asc("mtime"), F.asc("path")]


def contenders(members: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds ``contender``: within the tolerance of the widest band of its group, or lossless; everyone if a member is unmeasured."""
    w = Window.partitionBy(group)
    rows = members.withColumn("cutoff", S.effective_cutoff(F.col("cutoff_hz"), F.col("cliff_db")))
    unmeasured = F.max(F.col("cutoff").isNull()).over(w)
    wide = F.col("cutoff") >= F.max("cutoff").over(w) - TOLERANCE_HZ
    return rows.withColumn("contender", unmeasured | F.coalesce(wide, F.lit(False)) | lossless(F.col("path")))


def ranked(members: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds ``is_keeper``: the best contender, and files that are the same file; groups of one drop out."""
    w = Window.partitionBy(group)
    rows = contenders(members, group).withColumn("_size", F.count(F.lit(1)).over(w)).where("_size > 1")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("contender"), *keeper_order())))
    best = F.max(F.when(F.col("place") == 1, F.struct("dev", "inode"))).over(w)
    same = F.col("dev").eqNullSafe(best["dev"]) & F.col("inode").eqNullSafe(best["inode"])
    return rows.withColumn("is_keeper", (F.col("place") == 1) | same).drop("_size")
