"""Duplicate groups from matched pairs, and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.storage import checkpointed, settled


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that a node is linked with, by links (a, b).

    Labels spread to neighbours, and then to what the label's own label is (pointer jumping), so a chain takes
    a logarithmic number of rounds.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "other").alias("new"), "label")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = checkpointed(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("new"), "label"))
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def identical(tracks: DataFrame) -> DataFrame:
    """(content_id, n) of contents with more than one present file."""
    return tracks.where("present").groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def member_pairs(labels: DataFrame) -> DataFrame:
    """(component, a, b): the pairs of members of each component."""
    a, b = labels.select("component", F.col("node").alias("a")), labels.select("component", F.col("node").alias("b"))
    return a.join(b, "component").where("a < b")


def build_groups(tiers: DataFrame, tracks: DataFrame, verify=None) -> DataFrame:
    """(group_id, tier, formed_by_chain, content_id).

    ``tiers`` has (a, b, tier), a < b, of the pairs that a run has compared, matches or not.  A component of tier-1 pairs whose members all
    match each other directly at tier 1 is a clique; any other was formed by a chain and is of tier 2.  A component with a known pair of
    another tier is a chain, and one whose known tier-1 pairs are as many as its pairs is a clique, both by counts alone.  Only the pairs
    that the run hasn't compared, in the components that are left, go to ``verify``, which maps (component, a, b) to the same with a
    tier; without it they count as no match.  Contents with several files that aren't within a clique are groups of tier 0.
    """
    tiers = settled(tiers.select("a", "b", "tier"))  # the fingerprints that were sent for them are deleted before the groups are made
    labels = components(tiers.where("tier = 1"))
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    inner = tiers.join(side("a"), "a").join(side("b"), "b").where("of_a = of_b").select(F.col("of_a").alias("component"), "a", "b", "tier")
    known = inner.groupBy("component").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("tier") == 1).alias("ones"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    every = F.col("m") * (F.col("m") - 1) / 2
    state = sizes.join(known, "component").select("component", (F.col("ones") == every).alias("clique"), ((F.col("ones") == F.col("known")) & (F.col("ones") < every)).alias("open"))
    if verify:
        asked = member_pairs(labels.join(state.where("open"), "component", "left_semi")).join(inner, ["component", "a", "b"], "left_anti")
        passed = verify(asked).groupBy("component").agg((F.min((F.col("tier") == 1).cast("int")) == 1).alias("passed"))
        state = state.join(passed, "component", "left").select("component", (F.col("clique") | (F.col("open") & F.coalesce("passed", F.lit(False)))).alias("clique"))
    near = labels.join(state, "component").select(F.col("component").alias("group_id"), F.when(F.col("clique"), 1).otherwise(2).alias("tier"), (~F.col("clique")).alias("formed_by_chain"), F.col("node").alias("content_id"))
    same = identical(tracks).join(near.where("tier = 1").select("content_id"), "content_id", "left_anti")
    return near.unionByName(same.select(F.col("content_id").alias("group_id"), F.lit(0).alias("tier"), F.lit(False).alias("formed_by_chain"), "content_id"))


def members(groups: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every present file of each group."""
    return groups.join(tracks.where("present"), "content_id")


def eligible(tier: Column, chain: Column) -> Column:
    """Only identical or verified groups may be acted on."""
    return tier.isin(0, 1) & ~chain


def approved(decision: Column, tier: Column, chain: Column) -> Column:
    return F.when((decision == "pending") & eligible(tier, chain), "approved").otherwise(decision)


def quarantine_plan(ranked: DataFrame, verified: Column) -> DataFrame:
    """Files to move: the losers of approved groups with a keeper whose keepers are all still what they were."""
    keepers = ranked.where("is_keeper").groupBy("group_id").agg(F.min(verified.cast("int")).alias("sound"))
    return ranked.where((F.col("decision") == "approved") & ~F.col("is_keeper")).join(keepers.where("sound = 1").select("group_id"), "group_id", "left_semi")


def apply_moves(plan: DataFrame, now: DataFrame) -> DataFrame:
    """``plan`` (path, size, mtime as they were) with ``state``, by the listing ``now``: moved, skipped if the file has changed, gone if it isn't there.

    A file that is skipped or gone doesn't keep its group from being applied.
    """
    seen = now.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_here"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return plan.join(seen, "path", "left").withColumn("state", F.when(F.col("_here").isNull(), "gone").when(same, "moved").otherwise("skipped")).drop("_size", "_mtime", "_here")


def undo_moves(log: DataFrame, now: DataFrame) -> DataFrame:
    """What comes back of a log of moves: restored, or occupied if there is a file at the old path again."""
    back = log.where("state = 'moved'").join(now.select("path", F.lit(True).alias("_here")), "path", "left")
    return back.withColumn("state", F.when(F.col("_here"), "occupied").otherwise("restored")).drop("_here")
