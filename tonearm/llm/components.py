"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """Each link (u, v) with ``m``, the least v of its u.  A hub's links are dealt to many tasks."""
    return C.salted_join(links, links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), ["u"], F.xxhash64("v"), total=total)


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest of its neighbours and itself; there are at most ``total`` edges."""
    return _with_least(_both(edges), 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    star = _with_least(down, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.unionByName(down.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``edges`` has bigint columns u and v; loops and repeats do no harm.  The lineage is cut by checkpoint() in each round.
    """
    C.shared_dir(edges.sparkSession)
    edges = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    mark, total = None, edges.count()
    for _ in range(rounds):
        edges = small_star(large_star(edges, total), total).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
