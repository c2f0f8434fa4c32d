"""Playlists: exclusions, transition scores and the greedy walk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions import scalars as S

# Fixed values of the walk.
POOL, ARTIST, STEP, CONTINUOUS, KEY_BONUS = 80, 0.5, 0.3, 0.3, 0.2
LEGACY_POOL = 40
SAME_SONG = 0.025
JUMP_SHARE = 0.25


def near_copies(index: DataFrame, limit: float = SAME_SONG) -> DataFrame:
    """(track_id, neighbor_id) that are the same song: raw distance below the limit."""
    return index.where(F.col("raw") < limit).select("track_id", "neighbor_id")


def duplicate_exclusions(members: DataFrame) -> DataFrame:
    """(track_id, excluded): files of other contents in the same approved or applied group."""
    rows = members.where(F.col("decision").isin("approved", "applied")).select("group_id", "id", "content_id")
    other = rows.select("group_id", F.col("id").alias("excluded"), F.col("content_id").alias("other"))
    return rows.join(other, "group_id").where("content_id <> other").select(F.col("id").alias("track_id"), "excluded").distinct()


def transitions(index: DataFrame, tracks: DataFrame, spread: float, embedding: bool = True) -> DataFrame:
    """Every (track, candidate) of the index with the score that doesn't depend on the walk; the artist's penalty is added in it."""
    t = lambda c: tracks.select(F.col("track_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("bpm", "key_name", "scale", "tag_artist")])
    rows = index.join(t("track_id"), "track_id").join(t("neighbor_id"), "neighbor_id")
    a, b = (lambda x: F.col(f"track_id_{x}")), (lambda x: F.col(f"neighbor_id_{x}"))
    known = ~S.is_missing(a("bpm"), positive=True) & ~S.is_missing(b("bpm"), positive=True)
    limit = spread * JUMP_SHARE
    jump = S.bpm_jump(b("bpm"), a("bpm")) if embedding else F.abs(b("bpm") - a("bpm"))
    score = F.col("combined_score") + F.when(known & (jump > limit), STEP).otherwise(0.0)
    if embedding:
        score = score + F.when(known, CONTINUOUS * F.least(jump / (2 * limit), F.lit(1.0))).otherwise(0.0)
    keys = ~S.is_missing(a("key_name"), text=True) & ~S.is_missing(b("key_name"), text=True)
    near = S.key_distance(a("key_name"), F.coalesce(a("scale"), F.lit("major")), b("key_name"), F.coalesce(b("scale"), F.lit("major"))) <= 1
    score = score - F.when(keys & near, KEY_BONUS).otherwise(0.0)
    return rows.select("track_id", "neighbor_id", score.alias("score"), F.col("neighbor_id_tag_artist").alias("artist"), "raw")


def fallback_order(seed: int, ids: np.ndarray, first: int = 256) -> Iterator[int]:
    """A fixed order in place of a random choice: by a hash of seed and id (no two ids share one).  Only as much of it is sorted as is asked for."""
    x = (ids.astype(np.uint64) + np.uint64(seed * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    done = 0
    while done < len(ids):
        upto = min(len(ids), max(first, 8 * done))
        least = np.argpartition(x, upto - 1)[:upto] if upto < len(ids) else np.arange(len(ids))
        yield from ids[least[np.argsort(x[least])][done:]].tolist()
        done = upto


def walk(seed: int, edges: dict[int, list[tuple[int, float]]], artist: dict[int, str | None], excluded: dict[int, set[int]], n: int, ids: np.ndarray | None = None, spared: set[int] | None = None) -> list[int]:
    """Greedy: the cheapest candidate that is not excluded; an artist of the last three costs more; else the first by ``fallback_order`` of ``ids``, all with an artist in order; the positions of those are added to ``spared``."""
    out, used = [seed], {seed} | excluded.get(seed, set())
    spare = None
    while len(out) < n:
        recent = [artist[t] for t in out[-3:]]
        best, chosen = float("inf"), None
        for t, score in edges.get(out[-1], ()):
            if t in used or t not in artist:
                continue
            score += ARTIST if artist[t] is not None and artist[t] in recent else 0.0
            if score < best:
                best, chosen = score, t
        if chosen is None:
            if spare is None:
                spare = fallback_order(seed, np.array(sorted(artist), np.int64) if ids is None else ids)
            chosen = next((t for t in spare if t not in used), None)  # what is used stays so
            if chosen is None:
                break
            if spared is not None:
                spared.add(len(out))
        out.append(chosen)
        used |= {chosen} | excluded.get(chosen, set())
    return out


class Links:
    """Transitions by track, in arrays: ``get`` has (neighbour, score) in the order of their places."""

    def __init__(self, track: np.ndarray, place: np.ndarray, neighbour: np.ndarray, score: np.ndarray):
        by = np.lexsort((place, track))
        self.tracks, self.starts = np.unique(track[by], return_index=True)
        self.ends, self.neighbour, self.score = np.append(self.starts[1:], len(by)), neighbour[by], score[by]

    def get(self, track: int, default: Iterable = ()) -> Iterable[tuple[int, float]]:
        k = int(np.searchsorted(self.tracks, track))
        if k == len(self.tracks) or self.tracks[k] != track:
            return default
        some = slice(self.starts[k], self.ends[k])
        return zip(self.neighbour[some].tolist(), self.score[some].tolist(), strict=True)


def playlists(seeds: DataFrame, scored: DataFrame, pool: DataFrame, excluded: DataFrame, n: int = 20) -> DataFrame:
    """(seed, position, track_id, fallback) of a walk from each seed; fallback: no candidate was left for this position.

    The scored transitions are computed once by Spark; the walks, which depend on their own past, run a seed at a time on
    the executors with the transitions of one library as arrays, whose lists are bounded by the index's k.
    """
    tracks = pool.select(F.col("track_id").cast("long"), "tag_artist").toArrow()
    artist = dict(zip(tracks["track_id"].to_pylist(), tracks["tag_artist"].to_pylist(), strict=True))
    rows = scored.select(F.col("track_id").cast("long"), F.col("place").cast("int"), F.col("neighbor_id").cast("long"), F.col("score").cast("double")).toArrow()  # one library's index
    mine = [np.asarray(rows[c]) for c in ("track_id", "place", "neighbor_id", "score")]
    out_of: dict[int, set[int]] = {}
    gone = excluded.select("track_id", "excluded").distinct().toArrow()
    for t, x in zip(gone["track_id"].to_pylist(), gone["excluded"].to_pylist(), strict=True):
        if t in artist:
            out_of.setdefault(t, set()).add(x)
    shared = seeds.sparkSession.sparkContext.broadcast((Links(*mine), artist, out_of))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, artist, out_of = shared.value
        ids = np.array(sorted(artist), np.int64)
        for part in batches:
            for seed in part["seed"].tolist():
                if seed in artist:
                    spared: set[int] = set()
                    tracks = walk(seed, links, artist, out_of, n, ids, spared)
                    yield pd.DataFrame({"seed": seed, "position": np.arange(len(tracks), dtype=np.int32), "track_id": tracks, "fallback": [i in spared for i in range(len(tracks))]})

    dealt = seeds.select("seed").repartition(seeds.sparkSession.sparkContext.defaultParallelism)  # else a few thousand seeds are one task
    return dealt.mapInPandas(task, "seed long, position int, track_id long, fallback boolean")
