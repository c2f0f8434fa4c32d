"""Clusters of contents: k-means on features, spectral clusters on the neighbour graph, labels and upkeep.

Reductions are Spark's; a step on k x k or on a few thousand nodes is numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import scalars as S

# Fixed values of the clustering.
SMALL, CLUSTERS, VOTERS = 15, 8, 10
TRIES = range(5, 16)
TERCILE_ROWS = 6
BPM_TERCILES, ENERGY_TERCILES = (80.0, 120.0), (0.3, 0.7)
#: Up to so many nodes the spectral step takes all eigenvectors of a dense matrix; beyond it the first ones of a sparse one.  Linkage holds all distances of so many rows at most.
SPECTRAL_NODES = 6000


def graph_neighbours(n: int) -> int:
    return min(20, max(10, n // 50))


def feature_matrix(features: DataFrame, embedding: DataFrame) -> DataFrame:
    """(content_id, x): scalars and the short vector, of contents that have all of them."""
    rows = features.join(embedding, "content_id").where("bpm is not null and energy is not null")
    return rows.select("content_id", F.concat(F.array("bpm", "energy", "danceability", "loudness", "centroid", F.lit(1.0)), F.slice("vector", 1, 13)).alias("x"))


def scaler(matrix: DataFrame) -> DataFrame:
    """(k, mean, sd): population moments of each column; a constant column has scale 1."""
    cells = matrix.select(F.posexplode("x").alias("k", "v"))
    sd = F.stddev_pop("v")
    return cells.groupBy("k").agg(F.avg("v").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def standardised(matrix: DataFrame) -> DataFrame:
    one = scaler(matrix).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean", "sd"))), lambda x: F.struct(x["mean"].alias("m"), x["sd"].alias("s"))).alias("z"))  # one row: a scale per column
    return matrix.join(F.broadcast(one)).select("content_id", F.zip_with("x", "z", lambda v, z: (v - z["m"]) / z["s"]).alias("x"))


def kmeans(matrix: DataFrame, k: int | None = None, seed: int = 42, tries: range = TRIES) -> DataFrame:
    """(content_id, cluster_id): k-means on standardised rows, k by silhouette if not given; one cluster for very few rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    if matrix.limit(SMALL).count() < SMALL:
        return matrix.select("content_id", F.lit(0).alias("cluster_id"))
    rows = standardised(matrix).select("content_id", array_to_vector("x").alias("features")).persist()
    try:
        best, chosen = -2.0, k or tries[0]
        for n in [] if k else tries:
            out = KMeans(k=n, seed=seed).fit(rows).transform(rows)
            if out.select("prediction").distinct().count() > 1 and (s := ClusteringEvaluator().evaluate(out)) > best:
                best, chosen = s, n
        model = KMeans(k=chosen, seed=seed, maxIter=40).fit(rows)
    finally:
        rows.unpersist()
    return model.transform(standardised(matrix).select("content_id", array_to_vector("x").alias("features"))).select("content_id", F.col("prediction").alias("cluster_id"))


def small(rows: DataFrame, *group: str) -> DataFrame:
    """(content_id, cluster_id): 0 in groups too small to be cut, else null."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    same = [rows[g].eqNullSafe(sizes[g]) for g in group]
    return rows.join(sizes, same).select("content_id", F.when(F.col("n") < SMALL, 0).alias("cluster_id"))


def mean_vectors(assigned: DataFrame, group: str = "cluster_id", vector: str = "vector") -> DataFrame:
    """(cluster_id, centroid): mean of each component."""
    cells = assigned.select(group, F.posexplode(vector).alias("k", "v")).groupBy(group, "k").agg(F.avg("v").alias("v"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("centroid"))


def write_run(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, centroid, n_tracks) with unit centroids, and each content's cosine distance to its own."""
    units = assigned.withColumn("vector", S.unit(F.col("vector")))
    centroids = mean_vectors(units).withColumn("centroid", S.unit(F.col("centroid")))
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    far = units.join(centroids, "cluster_id").select("content_id", "cluster_id", (1 - S.dot(F.col("vector"), F.col("centroid"))).alias("distance_to_centroid"))
    return centroids.join(sizes, "cluster_id"), far


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(content_id, cluster_id, distance): the nearest of a few (k) centroids, held in one row; ties by id."""
    few = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("all"))
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    scored = points.join(F.broadcast(few)).withColumn("best", F.array_min(F.transform("all", lambda c: F.struct(F.round(d2(F.col("vector"), c["centroid"]), 12).alias("d"), c["cluster_id"].alias("id")))))
    return scored.select("content_id", F.col("best.id").alias("cluster_id"), F.sqrt("best.d").alias("distance"))


def vote(neighbours: DataFrame, labels: DataFrame, voters: int = VOTERS) -> DataFrame:
    """(content_id, cluster_id): what most of a new content's nearest clustered neighbours have; ties to the label of the nearest."""
    known = neighbours.join(labels.select(F.col("content_id").alias("j"), "cluster_id"), "j")
    w = Window.partitionBy("i").orderBy("d", "j")
    ranked = known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= voters)
    counts = ranked.groupBy("i", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first"))
    best = counts.groupBy("i").agg(F.max_by("cluster_id", F.struct("n", -F.col("first"))).alias("cluster_id"))
    return best.select(F.col("i").alias("content_id"), "cluster_id")


def present_sizes(labels: DataFrame, tracks: DataFrame, k: int) -> DataFrame:
    """Clusters' sizes in present contents, zeros included."""
    here = labels.join(tracks.where("present").select("content_id").distinct(), "content_id", "left_semi")
    every = labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(here.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left").fillna(0, ["n"])


# --- labels ---------------------------------------------------------------------


def terciles(features: DataFrame, tracks: DataFrame, column: str, fallback: tuple[float, float]) -> DataFrame:
    """One row (low, high): 33rd and 66th percentile over present files (a content counts once per file)."""
    rows = features.select("content_id", column).join(tracks.where("present").select("content_id"), "content_id").where(F.col(column).isNotNull())
    q = F.percentile(column, F.array(F.lit(0.33), F.lit(0.66)))
    got = rows.agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return got.select(*[F.when(F.col("n") < TERCILE_ROWS, fallback[i]).otherwise(F.col("q")[i]).alias(name) for i, name in enumerate(("low", "high"))])


def upper_median(c: str) -> Column:
    """The middle value, the upper one of two, from counts of values: the first in falling order that at least half are as large as."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{c}` DESC)")


def cluster_labels(labels: DataFrame, features: DataFrame, tracks: DataFrame) -> DataFrame:
    """(cluster_id, label): tempo, energy, mode and brightness words against the library's own distribution."""
    bpm = terciles(features, tracks, "bpm", BPM_TERCILES).toDF("bl", "bh")
    energy = terciles(features, tracks, "energy", ENERGY_TERCILES).toDF("el", "eh")
    bright = features.join(tracks.where("present").select("content_id"), "content_id").agg(upper_median("centroid").alias("mid"))
    rows = labels.join(features, "content_id").groupBy("cluster_id").agg(
        upper_median("bpm").alias("bpm"), upper_median("energy").alias("energy"), upper_median("centroid").alias("centroid"), F.count("scale").alias("scales"), F.count_if(F.col("scale") == "major").alias("major")
    )
    for one in (bpm, energy, bright):
        rows = rows.join(F.broadcast(one))  # one row each
    words = F.concat_ws(
        " ", F.when(F.col("bpm").isNotNull(), S.tempo_word(F.col("bpm"), F.col("bl"), F.col("bh"))), F.when(F.col("energy").isNotNull(), S.energy_word(F.col("energy"), F.col("el"), F.col("eh"))),
        F.when(F.col("scales") > 0, F.when(F.col("major") > F.col("scales") / 2, "Major").otherwise("Minor")), F.when(F.col("centroid").isNotNull(), F.when(F.col("centroid") > F.col("mid"), "Bright").otherwise("Warm")),
    )
    return rows.select("cluster_id", F.when(words == "", "Mixed").otherwise(words).alias("label"))


# --- small dense steps -------------------------------------------------------------


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment, by shortest augmenting paths (rows <= columns)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def relabelled(old: np.ndarray, new: np.ndarray) -> dict[int, int]:
    """New cluster -> id, like the old clusters with the most similar centroids; the rest get fresh ids."""
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    cost = 1 - unit(new) @ unit(old).T
    wide = max(cost.shape)
    square = np.full((wide, wide), 3.0)
    square[: cost.shape[0], : cost.shape[1]] = cost
    out, fresh = {}, len(old)
    for i, j in enumerate(assignment(square)[: len(new)]):
        if j < len(old):
            out[i] = j
        else:
            out[i], fresh = fresh, fresh + 1
    return out


def spectral_labels(affinity: np.ndarray, k: int) -> np.ndarray:
    """Clusters of a graph from the eigenvectors of its normalised Laplacian, assigned by a pivoted QR and its polar factor."""
    degree = np.maximum(affinity.sum(1), 1e-12)
    scale = 1 / np.sqrt(degree)
    _, vectors = np.linalg.eigh(-(affinity * scale[:, None] * scale[None, :]))
    return _by_pivots(vectors[:, :k])


def _by_pivots(v: np.ndarray) -> np.ndarray:
    k = v.shape[1]
    # columns of v.T with the largest remaining norm, one after the other
    rest, chosen = v.T.copy(), []
    for _ in range(k):
        j = int(np.argmax((rest * rest).sum(0)))
        chosen.append(j)
        q = rest[:, j] / max(np.linalg.norm(rest[:, j]), 1e-12)
        rest -= np.outer(q, q @ rest)
    a, _, b = np.linalg.svd(v[chosen].T)
    return np.argmax(np.abs(v @ (a @ b)), axis=1)


def eigengap(affinity: np.ndarray, most: int = 15) -> int:
    """How many clusters the largest gap between neighbouring eigenvalues of the normalised Laplacian suggests (2 at least)."""
    scale = 1 / np.sqrt(np.maximum(affinity.sum(1), 1e-12))
    values = np.linalg.eigvalsh(np.eye(len(affinity)) - affinity * scale[:, None] * scale[None, :])[: most + 1]
    return _widest(values)


def _widest(values: np.ndarray) -> int:
    return int(np.argmax(np.diff(values)[1:])) + 2


def leading(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, tolerance: float = 1e-8, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest eigenvalues, falling, and their vectors) of the normalised affinity with the weights w at (i, j).

    Block Krylov steps with Rayleigh and Ritz's choice, begun again from the best vectors until all k residuals are below the tolerance.
    The block is wider than k, so equal eigenvalues (of parts that nothing links) are found as often as they occur.  Memory grows with n and the links.
    """
    order = np.lexsort((j, i))
    i, j, w = i[order], j[order], w[order]
    rows, first = np.unique(i, return_index=True)
    degree = np.full(n, 1e-12)
    degree[rows] = np.maximum(np.add.reduceat(w, first), 1e-12)
    w = w / np.sqrt(degree[i] * degree[j])
    ends = np.append(first[1:], len(w))
    cuts = [0, *np.flatnonzero(np.diff(ends // 200_000)).tolist(), len(rows)]

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                s = slice(first[a], ends[b - 1])
                out[rows[a:b]] = np.add.reduceat(w[s, None] * x[j[s]], first[a:b] - first[a], axis=0)
        return out

    width = min(n, k + 8)
    x = np.linalg.qr(np.random.default_rng(42).standard_normal((n, width)))[0]
    for _ in range(rounds):
        basis, images = [x], [times(x)]
        for _ in range(min(7, n // width - 1)):
            y = images[-1]
            for _ in range(3):  # what little is left beside the basis is scaled up, and freed from the basis again
                for q in basis:
                    y = y - q @ (q.T @ y)
                y = np.linalg.qr(y)[0]
            basis.append(y)
            images.append(times(y))
        whole, image = np.hstack(basis), np.hstack(images)
        small = whole.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        x, moved = whole @ turn, image @ turn
        if np.linalg.norm(moved[:, :k] - x[:, :k] * values[:k], axis=0).max() < tolerance:
            return values[:k], x[:, :k]
    raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds")


def _sparse(part: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted nodes, (i, j, w) both ways, each once) from rows as of ``_dense``."""
    ids = np.sort(part.loc[part["w"].isna(), "i"].to_numpy())
    links = part[part["w"].notna()]
    i, j, w = np.searchsorted(ids, links["i"]), np.searchsorted(ids, links["j"]), links["w"].to_numpy()
    both = pd.DataFrame({"i": np.append(i, j), "j": np.append(j, i), "w": np.append(w, w)}).groupby(["i", "j"], as_index=False)["w"].max()
    return ids, (both["i"].to_numpy(), both["j"].to_numpy(), both["w"].to_numpy())


def linkage_labels(d: np.ndarray, k: int, method: str = "ward") -> np.ndarray:
    """Labels of k clusters merged bottom up: ``ward``, ``average`` or ``complete``; ties to the first rows.

    Distances to a merged cluster follow from those to its parts (Lance and Williams), and each row remembers its nearest later one.
    """
    n = len(d)
    work = (d * d if method == "ward" else d).astype(float)
    np.fill_diagonal(work, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    near = work.argmin(1)
    least = work[np.arange(n), near]
    for _ in range(n - k):
        i = int(np.argmin(np.where(alive, least, np.inf)))
        i, j = sorted((i, int(near[i])))
        a, b, both = size[i], size[j], work[i, j]
        if method == "ward":
            row = ((a + size) * work[i] + (b + size) * work[j] - size * both) / (a + b + size)
        elif method == "average":
            row = (a * work[i] + b * work[j]) / (a + b)
        else:
            row = np.maximum(work[i], work[j])
        alive[j] = False
        row[~alive] = row[i] = np.inf
        work[i], work[:, i] = row, row
        work[j], work[:, j] = np.inf, np.inf
        size[i] += b
        label[label == j] = i
        for x in np.flatnonzero(alive & ((near == i) | (near == j) | (row < least) | (np.arange(n) == i))):
            near[x] = work[x].argmin()
            least[x] = work[x, near[x]]
    return np.unique(label, return_inverse=True)[1]


def chain_labels(x: np.ndarray, k: int, method: str = "ward", held: int = 300_000_000) -> np.ndarray:
    """``linkage_labels`` from the points, without the matrix of their distances; where distances are equal, other ones may be merged first.

    Chains of nearest neighbours find the same merges in another order (all three linkages are reducible), which are then sorted.  The distances from a
    cluster to all others are found from its points (Ward: means) or from those of its parts; rows of large clusters are kept, in ``held`` bytes.  Time grows with the square of n.
    """
    n, ward = len(x), method == "ward"
    x = x - x.mean(0)
    norms = (x * x).sum(1)
    slot, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)  # a cluster's place is its slot
    means, top = x.copy(), np.zeros(n)
    members: list[list[int]] = [[i] for i in range(n)]
    cache, at = np.empty((0 if ward else min(n, max(2, held // (8 * n))), n)), {}  # rows of distances, and the place of each slot's
    free = list(range(len(cache)))
    merges, chain, left = [], [], n

    def found(c: int) -> np.ndarray:
        if ward:
            apart = means - means[c]
            row = 2 * size[c] * size / (size[c] + size) * np.einsum("ij,ij->i", apart, apart)
        else:
            some, each = members[c], np.zeros(n)
            for i in range(0, len(some), 64):
                part = some[i : i + 64]
                d = np.sqrt(np.maximum(norms[part, None] + norms - 2 * (x[part] @ x.T), 0))
                each = each + d.sum(0) if method == "average" else np.maximum(each, d.max(0))
            if method == "average":
                row = np.bincount(slot, each, len(size)) / (size * size[c])
            else:
                row = np.zeros(len(size))
                np.maximum.at(row, slot, each)
        row[~alive] = row[c] = np.inf
        return row

    def keep(c: int, row: np.ndarray) -> None:
        if not free:
            least = min(at, key=size.__getitem__)
            if size[least] > size[c]:
                return
            free.append(at.pop(least))
        at[c] = free.pop()
        cache[at[c]] = row

    def distances(c: int) -> np.ndarray:
        if c in at:
            return cache[at[c]]
        row = found(c)
        if not ward:
            keep(c, row)
        return row

    while left > 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        c = chain[-1]
        row = distances(c)
        j = int(np.argmin(row))
        before = chain[-2] if len(chain) > 1 else -1
        if before < 0 or (row[before] > row[j] and j not in chain):
            chain.append(j)
            continue
        # c and the one before it are each other's nearest; a nearest one further down the chain is a tie but for rounding
        o = before
        height = max(row[o], top[c], top[o])
        merges.append((members[c][0], members[o][0], height))
        del chain[-2:]
        z, y = (c, o) if len(members[c]) >= len(members[o]) else (o, c)
        a, b = size[z], size[y]
        join = (lambda p, q: (a * p + b * q) / (a + b)) if method == "average" else np.maximum
        both = None
        if not ward and (o in at or a + b >= 8):
            row = row.copy()  # its place may go to another
            both = join(row, distances(o)) if z == c else join(distances(o), row)
        if ward:
            means[z] = (a * means[z] + b * means[y]) / (a + b)
        slot[members[y]] = z
        members[z] += members[y]
        members[y] = []
        size[z], alive[y], top[z] = a + b, False, height
        left -= 1
        if not ward:
            free.extend(at.pop(s) for s in (z, y) if s in at)
            used = list(at.values())
            cache[used, z] = join(cache[used, z], cache[used, y])
            cache[used, y] = np.inf
            if both is not None:
                both[y] = both[z] = np.inf
                keep(z, both)
        if left < len(size) // 2:  # the slots that are left move together
            some = np.flatnonzero(alive)
            to = np.full(len(size), -1)
            to[some] = np.arange(len(some))
            if not ward:
                kept = [cache[i, some] for i in at.values()]
                cache, at = None, {int(to[s]): i for i, s in enumerate(at)}
                cache = np.empty((max(len(kept), min(len(some), held // (8 * len(some)))), len(some)))
                for i, r in enumerate(kept):
                    cache[i] = r
                free = list(range(len(kept), len(cache)))
            slot, size, alive, means, top = to[slot], size[some], alive[some], means[some], top[some]
            members, chain = [members[s] for s in some], [int(to[s]) for s in chain]
    return _cut(n, merges, k)


class Agglomeration:
    """``linkage_labels`` from the points, without the matrix of their distances; where distances are equal, other ones may be merged first.

    Merging goes on in stages.  A stage finds all pairs of clusters that are no farther apart than a bound, in blocks of products, so that they fit ``held`` bytes, and merges along chains of
    nearest neighbours within the bound.  All three linkages are reducible: a merged cluster is no nearer to another than its nearer part, so pairs beyond the bound stay beyond it and a stage
    makes the merges that the whole matrix would.  When the matrix of the clusters that are left fits ``held``, it is used.  Time grows with the square of the points.
    """

    def __init__(self, x: np.ndarray, method: str = "ward", held: int = 300_000_000):
        self.n, self.method, self.held = len(x), method, held
        # equal points are one from the start
        self.x, first, of = np.unique(x - x.mean(0), axis=0, return_index=True, return_inverse=True)
        self.merges = [(int(first[c]), i, 0.0) for i, c in enumerate(of.ravel().tolist()) if first[c] != i]
        self.norms, self.weight = (self.x * self.x).sum(1), np.bincount(of.ravel()).astype(float)
        self.first, self.size, self.means = first.tolist(), self.weight.copy(), self.x.copy()
        self.members, self.top = [np.array([i]) for i in range(len(first))], np.zeros(len(first))

    def labels(self, k: int) -> np.ndarray | None:
        """None if the stages don't get on (as when very many distances are equal)."""
        while (m := len(self.members)) > 1:
            if m * m * 8 <= self.held:
                self.whole()
            elif not (pairs := self.near()) or self.stage(*pairs) > 0.95 * m:
                return None
        return _cut(self.n, self.merges, k)

    def points(self, mine: np.ndarray, x: np.ndarray, norms: np.ndarray, weight: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """What is joined to clusters' distances, of pairs of points."""
        d = np.matmul(-2 * self.x[mine], x.T, out=out)
        d += self.norms[mine, None]
        d += norms
        np.maximum(d, 0, out=d)
        if self.method == "average":
            np.sqrt(d, out=d)
            if len(self.weight) < self.n:
                d *= self.weight[mine, None]
                d *= weight
        return d

    def room(self, k: int, *shape: int) -> np.ndarray:
        """Memory that is used again."""
        if len(self.kept[k]) < math.prod(shape):
            self.kept[k] = np.empty(math.prod(shape))
        return self.kept[k][: math.prod(shape)].reshape(shape)

    def columns(self, mine: np.ndarray, begin: int, join: np.ufunc) -> np.ndarray:
        """Of points with the clusters from ``begin`` on."""
        out = self.room(0, len(mine), len(self.members) - begin)
        for c in range(begin, self.large):
            of = self.members[c]
            out[:, c - begin] = join.reduce(self.points(mine, self.x[of], self.norms[of], self.weight[of]), axis=1)
        at = max(begin, self.large)
        for t, plane in enumerate(self.planes):
            plane = [of[at - self.large :] for of in plane]
            if not len(plane[0]):
                break
            cells = out[:, at - begin : at - begin + len(plane[0])]
            if t:
                join(cells, self.points(mine, *plane, self.room(1, *cells.shape)), out=cells)
            else:
                self.points(mine, *plane, cells)
        return out

    def apart(self, run: range, begin: int = 0, rows: int = 256) -> np.ndarray:
        """Distances (Ward: squared) from a run of clusters to those from ``begin`` on, until the next call."""
        some = slice(run.start, run.stop)
        if self.method == "ward":
            d = np.matmul(-2 * self.means[some], self.means[begin:].T, out=self.room(0, len(run), len(self.members) - begin))
            d += self.sums[some, None]
            d += self.sums[begin:]
            np.maximum(d, 0, out=d)
            d /= np.add(0.5 / self.size[some, None], 0.5 / self.size[begin:], out=self.room(1, *d.shape))
            return d
        join = np.add if self.method == "average" else np.maximum
        if len(run) == 1:
            mine = self.members[run.start]
            out = None
            for i in range(0, len(mine), rows):
                part = join.reduce(self.columns(mine[i : i + rows], begin, join), axis=0, keepdims=True)
                out = part if out is None else join(out, part)
        else:
            mine = self.members[some]
            planes = [[c[t] for c in mine if len(c) > t] for t in range(len(mine[0]))]
            d = self.columns(np.concatenate(planes), begin, join)
            out, at = d[: len(mine)], len(mine)
            for plane in planes[1:]:
                join(out[: len(plane)], d[at : at + len(plane)], out=out[: len(plane)])
                at += len(plane)
        return np.divide(out, np.multiply(self.size[some, None], self.size[begin:], out=self.room(1, *out.shape)), out=out) if self.method == "average" else np.sqrt(out, out=out)

    def blocks(self, cells: int = 1_000_000) -> Iterator[range]:
        """Runs of clusters; those of more than one have few points."""
        begin, points = 0, 0
        for c, of in enumerate(self.members):
            more = 1 if self.method == "ward" else len(of)
            if c > begin and (points + more) * (len(self.members) - begin) > cells:
                yield range(begin, c)
                begin, points = c, 0
            points += more
        yield range(begin, len(self.members))

    def sort(self, few: int = 32) -> None:
        """Large clusters first; of the rest, the first point of each, the second of those that have one, and so on: joined without a step for each cluster."""
        self.pack(sorted(range(len(self.members)), key=lambda c: -len(self.members[c])))
        self.large = sum(len(c) > few for c in self.members)
        rest = self.members[self.large :]
        planes = [np.array([c[t] for c in rest if len(c) > t]) for t in range(len(rest[0]) if rest else 0)]
        self.planes = [(self.x[of], self.norms[of], self.weight[of]) for of in planes if self.method != "ward"]
        self.sums, self.kept = (self.means * self.means).sum(1), [np.empty(0)] * 2

    def near(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
        """(the bound, starts of each cluster's others, the others, distances) for pairs within a bound, both ways."""
        self.sort()
        m, room = len(self.members), self.held // 64  # pairs
        some = np.random.default_rng(42).choice(m, min(m, 128), replace=False)
        sample = np.concatenate([np.delete(self.apart(range(c, c + 1))[0], c) for c in some.tolist()])
        at = min(len(sample) - 1, int(len(sample) * 1.6 * room / m / m))
        bound = float(np.partition(sample, at)[at])
        rows, others, far, count = [], [], [], 0
        for run in self.blocks():
            d = self.apart(run, run.start)
            i, j = np.nonzero(d <= bound)
            i, j = i[later := i < j], j[later]
            rows.append((i + run.start).astype(np.int32))
            others.append((j + run.start).astype(np.int32))
            far.append(d[i, j])
            count += len(i)
            while count > room:
                rows, others, far = [np.concatenate(rows)], [np.concatenate(others)], [np.concatenate(far)]
                bound = float(np.nextafter(np.partition(far[0], 3 * count // 4)[3 * count // 4], -np.inf))
                keep = far[0] <= bound
                rows, others, far = [rows[0][keep]], [others[0][keep]], [far[0][keep]]
                count = len(far[0])
        i, j, d = np.concatenate(rows), np.concatenate(others), np.concatenate(far)
        if not len(i):
            return None
        del rows, others, far
        i, j = np.append(i, j), np.append(j, i)
        by = np.argsort(i, kind="stable")
        return bound, np.searchsorted(i[by], np.arange(m + 1)), j[by], np.append(d, d)[by]

    def merged(self, a: int, b: int, height: float) -> None:
        """The second of two clusters goes into the first."""
        height = max(height, self.top[a], self.top[b])
        self.merges.append((self.first[a], self.first[b], height))
        s, t = self.size[a], self.size[b]
        self.means[a] = (s * self.means[a] + t * self.means[b]) / (s + t)
        self.members[a], self.members[b] = np.append(self.members[a], self.members[b]), None
        self.size[a], self.top[a] = s + t, height

    def pack(self, left: list[int]) -> None:
        self.first, self.members = [self.first[c] for c in left], [self.members[c] for c in left]
        self.size, self.means, self.top = self.size[left], self.means[left], self.top[left]

    def exact(self, c: int, some: np.ndarray) -> np.ndarray:
        """Sums of the distances from a cluster's points to others'."""
        mine, theirs = self.members[c], [self.members[o] for o in some]
        every = np.concatenate(theirs)
        total, x, norms = np.zeros(len(every)), self.x[every], self.norms[every]
        for i in range(0, len(mine), 64):
            part = mine[i : i + 64]
            total += self.weight[part] @ np.sqrt(np.maximum(self.norms[part, None] + norms - 2 * self.x[part] @ x.T, 0))
        return np.add.reduceat(total * self.weight[every], np.cumsum([0, *[len(t) for t in theirs[:-1]]]))

    def stage(self, bound: float, starts: np.ndarray, others: np.ndarray, far: np.ndarray) -> int:
        """Merge what is within the bound; returns how many clusters are left."""
        m, method = len(self.members), self.method
        now = np.arange(m)  # where each cluster of the stage's beginning is
        parts: list[list[int]] = [[c] for c in range(m)]
        count = self.size.copy() if method == "average" else np.ones(m)  # complete: of clusters of the stage's beginning
        rows: list[tuple | None] = [None] * m  # (others, largest or summed distances, of how many pairs)

        def row(c: int) -> tuple:
            if rows[c] is None:
                s = slice(starts[c], starts[c + 1])
                pairs = begun[c] * begun[others[s]]
                rows[c] = others[s], far[s] * pairs if method == "average" else far[s], pairs
            return rows[c]

        def gathered(c: int, ids: np.ndarray, d: np.ndarray, pairs: np.ndarray) -> tuple:
            """With the others where they are now."""
            ids = now[ids]
            by = np.argsort(ids, kind="stable")
            ids = ids[by]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            if method == "ward":
                ids = ids[first]
                return (ids[ids != c],) * 3
            if not len(first):
                return ids, d, pairs
            ids, d, pairs = ids[first], (np.add if method == "average" else np.maximum).reduceat(d[by], first), np.add.reduceat(pairs[by], first)
            keep = ids != c if method == "average" else (ids != c) & (pairs == count[c] * count[ids])
            return ids[keep], d[keep], pairs[keep]

        def distances(c: int) -> tuple[np.ndarray, np.ndarray]:
            """Others within the bound that may be the nearest, and how far they are."""
            ids, d, pairs = row(c)
            if (now[ids] != ids).any() or (method == "complete" and (pairs != count[c] * count[ids]).any()):
                ids, d, pairs = rows[c] = gathered(c, ids, d, pairs)
            if method == "ward":
                apart = self.means[ids] - self.means[c]
                d = 2 * self.size[c] * self.size[ids] / (self.size[c] + self.size[ids]) * np.einsum("ij,ij->i", apart, apart)
            elif method == "average":
                every = count[c] * count[ids]
                low = (d + (every - pairs) * bound) / every  # pairs that weren't found are beyond the bound
                known = pairs == every
                best = low[known].min(initial=bound)
                ask, size = np.flatnonzero(~known), 16
                ask = ask[np.argsort(low[ask])]
                if len(ask):
                    d, pairs, known = d.copy(), pairs.copy(), known.copy()
                while len(ask) and low[ask[0]] <= best:
                    some, ask, size = ask[:size], ask[size:], 2 * size
                    d[some] = self.exact(c, ids[some])
                    pairs[some], low[some], known[some] = every[some], d[some] / every[some], True
                    best = min(best, low[some].min())
                rows[c] = ids, d, pairs
                d = np.where(known, low, np.inf)
            near = d <= bound
            return ids[near], d[near]

        begun, left, chain, begin = count.copy(), m, [], 0
        while True:
            if not chain:
                while begin < m and self.members[begin] is None:
                    begin += 1
                if begin == m:
                    break
                chain.append(begin)
            c = chain[-1]
            ids, d = distances(c)
            before = chain[-2] if len(chain) > 1 else -1
            if not len(ids):
                if before < 0:
                    begin += 1  # none within the bound, now or later
                    chain.pop()
                    continue
                j, height = before, last
            else:
                j = int(ids[at := np.argmin(d)])
                height = float(d[at])
                back = d[ids == before]
                if before < 0 or (j not in chain and (not len(back) or back[0] > height)):
                    chain.append(j)
                    last = height
                    continue
                if len(back):
                    height = float(back[0])
                else:
                    height = last
            # c and the one before it are each other's nearest; a nearest one further down the chain is a tie but for rounding
            del chain[-2:]
            a, b = sorted((c, before), key=lambda o: (-len(parts[o]), o))
            joined = [np.append(p, q) for p, q in zip(row(a), row(b), strict=True)]
            self.merged(a, b, height)
            now[parts[b]] = a
            parts[a] += parts[b]
            count[a] += count[b]
            rows[b], parts[b] = None, []
            rows[a] = gathered(a, *joined)
            left -= 1
            last = np.inf
        self.pack([c for c, of in enumerate(self.members) if of is not None])
        return left

    def whole(self) -> None:
        """Merge all that is left by the matrix."""
        self.sort()
        m = len(self.members)
        work = np.empty((m, m))
        for run in self.blocks():
            a, b = run.start, run.stop
            work[a:b, a:] = self.apart(run, a)
            work[a:, a:b] = work[a:b, a:].T
        np.fill_diagonal(work, np.inf)
        alive, chain, size = np.ones(m, bool), [], self.size
        for _ in range(m - 1):
            while True:
                if not chain:
                    chain.append(int(np.argmax(alive)))
                c = chain[-1]
                j, before = int(np.argmin(work[c])), chain[-2] if len(chain) > 1 else -1
                if before >= 0 and (work[c, before] <= work[c, j] or j in chain):
                    break
                chain.append(j)
            del chain[-2:]
            height, a, b = work[c, before], size[c], size[before]
            if self.method == "ward":
                with np.errstate(invalid="ignore"):
                    new = ((a + size) * work[c] + (b + size) * work[before] - size * height) / (a + b + size)
            else:
                new = (a * work[c] + b * work[before]) / (a + b) if self.method == "average" else np.maximum(work[c], work[before])
            alive[before] = False
            new[~alive] = new[c] = np.inf
            work[c], work[:, c] = new, new
            work[before], work[:, before] = np.inf, np.inf
            self.merged(c, before, float(height))
        self.pack([c for c, of in enumerate(self.members) if of is not None])


def _cut(n: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels after the n - k lowest merges (rows of each, height), each after those of its parts."""
    of = np.arange(n)
    for a, b, _ in sorted(merges, key=lambda m: m[2])[: n - k]:
        while of[a] != a:
            of[a] = a = of[of[a]]
        while of[b] != b:
            of[b] = b = of[of[b]]
        of[max(a, b)] = min(a, b)
    while (of[of] != of).any():
        of = of[of]
    return np.unique(of, return_inverse=True)[1]


def merged_labels(x: np.ndarray, k: int, method: str = "ward", held: int = 300_000_000) -> np.ndarray:
    """``linkage_labels`` by ``Agglomeration``, or by ``chain_labels`` where its stages don't get on."""
    found = Agglomeration(x, method, held).labels(k)
    return chain_labels(x, k, method, held) if found is None else found


def linked(rows: DataFrame, k: int, methods: tuple[str, ...] = ("ward", "average", "complete")) -> DataFrame:
    """(content_id, a cluster for each method) of rows (content_id, x), by Euclidean distance; one task, or beyond ``SPECTRAL_NODES`` rows one for each method, whose memory grows with the rows and their clusters' rows that are kept."""
    small = rows.limit(SPECTRAL_NODES + 1).count() <= SPECTRAL_NODES

    def task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("content_id")
        x = np.stack([np.asarray(v, float) for v in part["x"]])
        sums = (x * x).sum(1)
        d = np.sqrt(np.maximum(sums[:, None] + sums[None, :] - 2 * x @ x.T, 0))
        return pd.DataFrame({"content_id": part["content_id"]} | {m: linkage_labels(d, min(k, len(x)), m).astype(np.int32) for m in methods})

    def by_chains(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("content_id")
        method, ids = part["method"].iloc[0], part["content_id"].to_numpy()
        x = np.stack([np.asarray(v, float) for v in part["x"]])
        del part
        return pd.DataFrame({"content_id": ids, "method": method, "label": merged_labels(x, min(k, len(x)), method).astype(np.int32)})

    if small:
        return rows.select("content_id", "x", F.lit(0).alias("g")).groupBy("g").applyInPandas(task, "content_id long, " + ", ".join(f"{m} int" for m in methods))
    each = rows.select("content_id", "x", F.explode(F.array(*map(F.lit, methods))).alias("method")).repartition(16, "method")
    found = each.groupBy("method").applyInPandas(by_chains, "content_id long, method string, label int")
    return found.groupBy("content_id").agg(*[F.max(F.when(F.col("method") == m, F.col("label"))).alias(m) for m in methods])


def _dense(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted nodes, symmetric affinity) from rows of links, and rows without a weight for the nodes."""
    ids = np.sort(part.loc[part["w"].isna(), "i"].to_numpy())
    links = part[part["w"].notna()]
    a = np.zeros((len(ids), len(ids)))
    a[np.searchsorted(ids, links["i"]), np.searchsorted(ids, links["j"])] = links["w"]
    return ids, np.maximum(a, a.T)


def _graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = nodes.select(F.col("content_id").alias("i"), F.col("content_id").alias("j"), F.lit(None).cast("double").alias("w"))
    return edges.select("i", "j", "w").unionByName(rows).groupBy(F.lit(0).alias("g"))


def suggested_clusters(edges: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """One row (k) by ``eigengap``, in one task."""
    bound = SPECTRAL_NODES

    def task(part: pd.DataFrame) -> pd.DataFrame:
        if int(part["w"].isna().sum()) <= bound:
            return pd.DataFrame({"k": [eigengap(_dense(part)[1], most)]})
        ids, links = _sparse(part)
        return pd.DataFrame({"k": [_widest(1 - leading(len(ids), *links, most + 1)[0])]})

    return _graph(edges, nodes).applyInPandas(task, "k int")


def spectral(edges: DataFrame, nodes: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """(content_id, cluster_id): one task over the graph; beyond ``SPECTRAL_NODES`` nodes it takes memory in proportion to nodes and links."""
    bound = SPECTRAL_NODES
    if nodes.limit(SMALL).count() < SMALL:
        return nodes.select("content_id", F.lit(0).alias("cluster_id"))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        if int(part["w"].isna().sum()) <= bound:
            ids, a = _dense(part)
            return pd.DataFrame({"content_id": ids, "cluster_id": spectral_labels(a, min(k, len(ids)))})
        ids, links = _sparse(part)
        return pd.DataFrame({"content_id": ids, "cluster_id": _by_pivots(leading(len(ids), *links, min(k, len(ids)))[1])})

    return _graph(edges, nodes).applyInPandas(task, "content_id long, cluster_id int")


def merged_small(labels: DataFrame, centroids: DataFrame, share: float = 0.02) -> DataFrame:
    """Clusters below a share of all contents go to the one with the nearest centroid among the others."""
    sizes = {r["cluster_id"]: r["n"] for r in labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    at = {r["cluster_id"]: np.array(r["centroid"]) for r in centroids.collect()}  # k rows
    total, to = sum(sizes.values()), {}
    large = sorted(c for c in sizes if sizes[c] >= share * total)
    for c in sorted(sizes):
        to[c] = c if c in large or not large else min(large, key=lambda o: (1 - float(at[c] @ at[o]) / (np.linalg.norm(at[c]) * np.linalg.norm(at[o]) + 1e-12), o))
    table = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    return labels.withColumn("cluster_id", table[F.col("cluster_id")])
