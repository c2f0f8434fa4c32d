"""Distances, neighbour lists and their correction for hubs.

All-pairs work is done in blocks: rows are dealt to pairs of blocks, and each task multiplies two
blocks in numpy and passes on only the nearest of each row (or sums), never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.storage import checkpointed, small_batches

# Weights of the components, and the scale of a tempo difference.
WEIGHTS = {"mfcc": 0.5, "bpm": 0.25, "key": 0.15, "energy": 0.1}
BPM_SCALE, MIN_SPREAD, MIN_ROWS = 60.0, 10.0, 4
STANDARD = NormalDist()


def components(weights: dict[str, float] | None = None, bpm_scale: Column | float = BPM_SCALE) -> dict[str, Column]:
    """Normalised distances between the rows named a_* and b_*; a component that a side lacks is null, and the weights of the rest are scaled up."""
    w, a, b = weights or WEIGHTS, (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    one = F.lit(1.0)
    parts = {
        "mfcc": F.least(S.cosine_distance(a("mfcc"), b("mfcc")) / 2, one),
        "bpm": F.when(~S.is_missing(a("bpm"), positive=True) & ~S.is_missing(b("bpm"), positive=True), F.least(F.abs(a("bpm") - b("bpm")) / bpm_scale, one)),
        "key": F.when(~S.is_missing(a("key_name"), text=True) & ~S.is_missing(b("key_name"), text=True), F.least(S.key_distance(a("key_name"), F.coalesce(a("scale"), F.lit("major")), b("key_name"), F.coalesce(b("scale"), F.lit("major"))) / 6.0, one)),
        "energy": F.when(~S.is_missing(a("energy")) & ~S.is_missing(b("energy")), F.least(F.abs(a("energy") - b("energy")), one)),
    }
    total, mass = F.lit(0.0), F.lit(0.0)
    for name, value in parts.items():
        total = total + F.coalesce(value * w[name], F.lit(0.0))
        mass = mass + F.when(value.isNotNull(), w[name]).otherwise(0.0)
    return {f"{k}_norm": v for k, v in parts.items()} | {"combined_score": total / F.when(mass == 0, 1.0).otherwise(mass)}


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns])


def bpm_spread(features: DataFrame) -> DataFrame:
    """One row: the interquartile range of the tempos, 10 at least; 60 for fewer than four."""
    q = F.percentile("bpm", F.array(F.lit(0.25), F.lit(0.75)))
    got = features.where("bpm > 0").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return got.select(F.when(F.col("n") < MIN_ROWS, BPM_SCALE).otherwise(F.greatest(F.lit(MIN_SPREAD), F.col("q")[1] - F.col("q")[0])).alias("spread"))


def block_count(rows: DataFrame, most: int = 8192, least: int = 256) -> int:
    """Into how many blocks: enough pairs of blocks for all cores, and no block of more than ``most`` rows on average."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / most), min(math.ceil(n / least), math.ceil(math.sqrt(4 * cores))))


def block_pairs(rows: DataFrame, id_col: str, queries: Column, blocks: int, data: Column | None = None) -> DataFrame:
    """Rows dealt to (query block, data block) groups, so that a group's size is bounded whatever the table's."""
    part = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    role = lambda x, name, here, there: x.select(*rows.columns, F.lit(name).alias("_role"), part.cast("int").alias(here), F.explode(every).alias(there))
    return role(rows.where(F.lit(True) if data is None else data), "data", "_d", "_q").unionByName(role(rows.where(queries), "query", "_q", "_d"))


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def cosine_block(asked: pd.DataFrame, data: pd.DataFrame) -> np.ndarray:
    return np.clip(1 - unit_rows(asked["vector"]) @ unit_rows(data["vector"]).T, 0, 2).round(9)


def in_blocks(rows: DataFrame, queries: Column, schema: str, work, data: Column | None = None, blocks: int | None = None, piece: int = 512) -> DataFrame:
    """``work(asked, data)`` on every pair of blocks, ``piece`` queries at a time; data come sorted by id."""

    def task(part: pd.DataFrame) -> pd.DataFrame:
        known, asked = part[part["_role"] == "data"].sort_values("content_id"), part[part["_role"] == "query"]
        some = [work(asked.iloc[a : a + piece], known) for a in range(0, len(asked), piece)] if len(known) else []
        return pd.concat(some) if some else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return block_pairs(rows, "content_id", queries, blocks or block_count(rows), data).groupBy("_q", "_d").applyInPandas(task, schema)


def _best(asked: pd.DataFrame, data: pd.DataFrame, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k lowest scores of each query, ties by id; infinite ones are none."""
    i, j = asked["content_id"].to_numpy(), data["content_id"].to_numpy()
    score[i[:, None] == j[None, :]] = np.inf
    limit = np.partition(score, k - 1, axis=1)[:, k - 1 : k] if k < score.shape[1] else np.inf
    row, at = np.nonzero(~(score > limit) & np.isfinite(score))
    found = score[row, at]
    take = _first(row, at, found, k)
    return pd.DataFrame({"i": i[row[take]], "j": j[at[take]], "score": found[take]})


def _first(row: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest scores of each row, ties to the first column."""
    by = np.lexsort((at, score, row))
    mine = row[by]
    begin = np.flatnonzero(np.diff(mine, prepend=-1))
    return by[np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by)))) < k]


def nearest(rows: DataFrame, k: int, queries: Column | None = None, data: Column | None = None, apart: str | None = None, blocks: int | None = None) -> DataFrame:
    """(i, j, d, place): the k nearest others of each query among the data by cosine distance, ties by id; rows with equal ``apart`` aren't compared."""

    def work(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        d = cosine_block(asked, known)
        if apart:
            d[asked[apart].to_numpy()[:, None] == known[apart].to_numpy()[None, :]] = np.inf
        return _best(asked, known, d, k).rename(columns={"score": "d"})

    some = in_blocks(rows.select("content_id", "vector", *[apart] * bool(apart)), F.lit(True) if queries is None else queries, "i long, j long, d double", work, data, blocks)
    return top_k(some, "i", "d", "j", k)


def distances(rows: DataFrame, blocks: int | None = None, piece: int = 128) -> DataFrame:
    """(i, j, d): the whole matrix without its diagonal; a task holds two blocks of vectors and passes on ``piece`` rows of the matrix at a time."""
    small_batches(rows.sparkSession)
    total = rows.count()
    n = blocks or max(1, math.ceil(total / 1024))
    block = max(1, math.ceil(total / n))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, len(part), block):
                some = part.slice(a, block).to_pandas()
                x = np.stack([np.asarray(v, np.float64) for v in some["vector"]])
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                size = 4 if (short == x).all() else 8  # bytes a number, without loss
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (some["content_id"].to_numpy(np.int64), short if size == 4 else x)] + [pa.array([v], pa.int32()) for v in (len(some), size)], ["ids", "vectors", "n", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for x in part.to_pylist():
                (i, u), (j, v) = ((np.frombuffer(x[f"{s}ids"], np.int64), unit_rows(np.frombuffer(x[f"{s}vectors"], f"f{x[f'{s}size']}").reshape(x[f"{s}n"], -1))) for s in ("a_", "b_"))
                for a in range(0, len(i), piece):
                    d = np.clip(1 - u[a : a + piece] @ v.T, 0, 2).round(9).ravel()
                    left, right = np.repeat(i[a : a + piece], len(j)), np.tile(j, len(i[a : a + piece]))
                    other = left != right
                    yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (left, right, d)], ["i", "j", "d"])

    # the packed blocks are dealt out once, for both sides, and not written besides
    blocks = rows.select(F.col("content_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(pack, "ids binary, vectors binary, n int, size int").repartition(min(n, 64))
    pairs = side(blocks, "a").hint("shuffle_replicate_nl").crossJoin(side(blocks, "b"))
    return pairs.mapInArrow(run, "i long, j long, d double")


def ranks(rows: DataFrame, known: DataFrame, blocks: int | None = None) -> DataFrame:
    """(i, j, place): the place of j among all others of i, for known pairs (i, j), by counting what is nearer (ties by id)."""
    vector = lambda c: rows.select(F.col("content_id").alias(c), F.col("vector").alias(f"v_{c}"))
    pairs = known.join(vector("i"), "i").join(vector("j"), "j").groupBy("i").agg(F.first("v_i").alias("vector"), F.collect_list(F.struct("j", "v_j")).alias("asked"))
    asked = rows.select("content_id", "vector").join(pairs.select(F.col("i").alias("content_id"), "asked"), "content_id", "left")

    def work(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        d, ids, out = cosine_block(some, others), others["content_id"].to_numpy(), []
        for row, i, of, vector in zip(d, some["content_id"], some["asked"], some["vector"], strict=True):
            for x in of:
                mine = float(np.clip(1 - unit_rows([vector])[0] @ unit_rows([x["v_j"]])[0], 0, 2).round(9))
                out.append((i, x["j"], int((((row < mine) | ((row == mine) & (ids < x["j"]))) & (ids != i) & (ids != x["j"])).sum())))
        return pd.DataFrame(out, columns=["i", "j", "before"])

    counted = in_blocks(asked, F.col("asked").isNotNull(), "i long, j long, before long", work, blocks=blocks)
    return counted.groupBy("i", "j").agg((F.sum("before") + 1).alias("place"))


SCORED = ("mfcc", "bpm", "energy", "place_of_key", "no_key")


def score_block(a: pd.DataFrame, b: pd.DataFrame, spread: float, weights: dict[str, float]) -> np.ndarray:
    """``combined_score`` of ``components`` for all pairs of two blocks."""
    x, y = (np.stack([np.asarray(v, float) for v in side["mfcc"]]) for side in (a, b))
    sizes = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(sizes == 0, 0.0, np.clip((x @ y.T) / sizes, -1, 1))
    column = lambda side, c: side[c].to_numpy(float)
    gap = lambda c: np.abs(column(a, c)[:, None] - column(b, c)[None, :])
    fifths = gap("place_of_key")
    unknown = a["no_key"].to_numpy(bool)[:, None] | b["no_key"].to_numpy(bool)[None, :]
    parts = {
        "mfcc": np.minimum((1 - cosine) / 2, 1), "bpm": np.minimum(gap("bpm") / spread, 1), "energy": np.minimum(gap("energy"), 1),
        "key": np.where(unknown, np.nan, np.nan_to_num(np.minimum(fifths, 12 - fifths), nan=6.0) / 6),
    }
    total, mass = np.zeros(cosine.shape), np.zeros(cosine.shape)
    for name, value in parts.items():
        there = ~np.isnan(value)
        total += np.where(there, value * weights[name], 0)
        mass += np.where(there, weights[name], 0)
    return (total / np.where(mass == 0, 1, mass)).round(6)


def score_index(rows: DataFrame, k: int, spread: float, weights: dict[str, float] | None = None, queries: Column | None = None, data: Column | None = None, blocks: int | None = None) -> DataFrame:
    """(track_id, neighbor_id, combined_score, place): the k best of all others by the components' score, for rows with mfcc, bpm, key_name, scale and energy."""
    missing = S.is_missing(F.col("key_name"), text=True)
    ready = rows.select(
        "content_id", "mfcc", F.when(~S.is_missing(F.col("bpm"), positive=True), F.col("bpm")).alias("bpm"), "energy",
        S.fifths(F.col("key_name"), F.coalesce("scale", F.lit("major"))).cast("double").alias("place_of_key"), missing.alias("no_key"),
    )
    work = lambda a, b: _best(a, b, score_block(a, b, spread, weights or WEIGHTS), k)
    best = top_k(in_blocks(ready, F.lit(True) if queries is None else queries, "i long, j long, score double", work, data, blocks), "i", "score", "j", k)
    return best.select(F.col("i").alias("track_id"), F.col("j").alias("neighbor_id"), F.col("score").alias("combined_score"), "place")


def paired(rows: DataFrame, queries: Column, blocks: int | None = None) -> DataFrame:
    """Each query (columns a_*) with every other row (b_*): an equi join on the data's block."""
    n = blocks or block_count(rows)
    a = side(rows.where(queries), "a").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = side(rows, "b").withColumn("_d", F.pmod(F.xxhash64("b_content_id"), F.lit(n)).cast("int"))
    return a.join(b, "_d").drop("_d").where("a_content_id <> b_content_id")


def top_k(pairs: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(score, tie)
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def row_moments(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """(i, n, mean, sd): of each row's distances to all others, from sums over blocks."""

    def work(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        i = asked["content_id"].to_numpy()
        other = i[:, None] != known["content_id"].to_numpy()[None, :]
        d = np.where(other, cosine_block(asked, known), 0)
        return pd.DataFrame({"i": i, "n": other.sum(1), "s": d.sum(1), "ss": (d * d).sum(1)})

    sums = in_blocks(rows.select("content_id", "vector"), F.lit(True), "i long, n long, s double, ss double", work, blocks=blocks)
    out = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return out.select("i", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("sd"))


def mutual_proximity(pairs: DataFrame, moments: DataFrame) -> DataFrame:
    """``mp`` of (i, j, d): 1 - P(X_i > d) P(X_j > d) for normal distributions of both rows' distances."""
    m = lambda c: moments.select(F.col("i").alias(c), F.col("mean").alias(f"m_{c}"), F.greatest(F.col("sd"), F.lit(1e-12)).alias(f"s_{c}"))
    both = pairs.join(m("i"), "i").join(m("j"), "j")
    above = lambda c: 1 - S.normal_cdf((F.col("d") - F.col(f"m_{c}")) / F.col(f"s_{c}"))
    return both.withColumn("mp", 1 - above("i") * above("j")).drop("m_i", "s_i", "m_j", "s_j")


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """S.normal_cdf on an array."""
    a = np.abs(x)
    inside = np.minimum(a, 7.1)
    tail = np.where(a < 7.07106781186547, np.exp(-inside * inside / 2) * np.polyval(S.NUMERATOR, inside) / np.polyval(S.DENOMINATOR, inside), 0.0)
    return np.where(x > 0, 1 - tail, tail)


def proximity_best(asked: pd.DataFrame, known: pd.DataFrame, k: int) -> pd.DataFrame:
    """(i, j, d, mp): the k best of each query by mutual proximity, ties by id.

    Proximity is no lower than either side's share of smaller distances.  The k best of the 4 k nearest bound what the others must reach, so only pairs whose
    distances are short for both sides are scored.
    """
    d, i, j = cosine_block(asked, known), asked["content_id"].to_numpy(), known["content_id"].to_numpy()
    d[i[:, None] == j[None, :]] = np.inf
    (m, s), (n, t) = ((of["mean"].to_numpy(), np.maximum(of["sd"].to_numpy(), 1e-12)) for of in (asked, known))
    mp = lambda row, at: (1 - (1 - _normal_cdf((d[row, at] - m[row]) / s[row])) * (1 - _normal_cdf((d[row, at] - n[at]) / t[at]))).round(9)
    far = np.full(len(i), np.inf)  # standard deviations above the mean
    if 4 * k < len(j) - 1:
        near = np.argpartition(d, 4 * k, axis=1)[:, : 4 * k]
        some = mp(np.repeat(np.arange(len(i)), 4 * k), near.ravel()).reshape(near.shape)
        bound = np.partition(some, k - 1, axis=1)[:, k - 1] + 1e-8
        far = np.array([STANDARD.inv_cdf(x) + 1e-6 if x < 1 - 1e-8 else np.inf for x in bound.tolist()])
    with np.errstate(invalid="ignore"):
        row, at = np.nonzero((d <= (m + far * s + 1e-9)[:, None]) & np.isfinite(d))
        both = d[row, at] <= n[at] + far[row] * t[at] + 1e-9
    row, at = row[both], at[both]
    score = mp(row, at)
    take = _first(row, at, score, k)
    row, at = row[take], at[take]
    return pd.DataFrame({"i": i[row], "j": j[at], "d": d[row, at], "mp": score[take]})


def with_moments(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """(content_id, vector, mean, sd): rows with their ``row_moments``, written once."""
    moments = row_moments(rows, blocks).select(F.col("i").alias("content_id"), "mean", "sd")
    return checkpointed(rows.select("content_id", "vector").join(moments, "content_id"))


def proximity_matrix(part: pd.DataFrame) -> np.ndarray:
    """Mutual proximity of all pairs of a few rows of ``with_moments``."""
    d, m, s = cosine_block(part, part), part["mean"].to_numpy()[:, None], np.maximum(part["sd"].to_numpy(), 1e-12)[:, None]
    above = 1 - _normal_cdf((d - m) / s)
    return 1 - above * above.T


def embedding_index(rows: DataFrame, k: int = 100, blocks: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(track_id, neighbor_id, raw, combined_score, place): the k nearest others by mutual proximity (nine places), ties by id; every pair that may be among them is scored in its blocks.  ``known``: ``with_moments`` of the rows, if they were made before."""
    work = lambda asked, known: proximity_best(asked, known, k)
    known = with_moments(rows, blocks) if known is None else known
    some = in_blocks(known, F.lit(True), "i long, j long, d double, mp double", work, blocks=blocks)
    best = top_k(some, "i", "mp", "j", k)
    return best.select(F.col("i").alias("track_id"), F.col("j").alias("neighbor_id"), (F.col("d") / 2).alias("raw"), F.col("mp").alias("combined_score"), "place")


def merge_top_k(existing: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Neighbour lists with new candidates: existing rows win ties, as a new one must be strictly better."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("track_id").orderBy("combined_score", "_new", "neighbor_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_new")


def affinity(neighbours: DataFrame, k: int) -> DataFrame:
    """(i, j, w): union graph of the k nearest, weight exp(-(d / sigma) ** 2), sigma the median of their distances."""
    near = neighbours.where(F.col("place") <= k).select("i", "j", "d")
    sigma = near.agg(F.percentile("d", F.lit(0.5)).alias("sigma"))
    edges = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).groupBy("i", "j").agg(F.min("d").alias("d"))
    return edges.join(F.broadcast(sigma)).select("i", "j", F.exp(-F.pow(F.col("d") / F.greatest(F.col("sigma"), F.lit(1e-12)), 2)).alias("w"))  # one row on the right


