"""Centroid clustering (Lloyd's rounds) in which most vectors keep their centroid without being compared.

Every vector carries an upper bound of the distance to its centroid and a lower bound of
the distance to all others.  While the upper bound is smaller - or smaller than half the way
from its centroid to the next one - the vector keeps its centroid; all others, ties
included, first get their exact distance and, if that does not settle it, are compared
with all centroids in whole numbers.  Bounds are widened by ``SLACK``, so rounding of floats
never decides.

When centroids move, upper bounds grow by the drift of the vector's centroid.  Lower bounds
need not fall by the largest drift of the others.  The vectors of a cluster lie in a
sphere around its centroid c.  For a centroid that moves from a to b, a distance of
d, all x of the sphere have ``|x-a| - |x-b| = 2 d h / (|x-a| + |x-b|)``, where h is the
height of x over the plane halfway between a and b.  Only the plane through c, a and b
matters:

* ``|x-a| + |x-b| >= 2 |x-m|`` for the midpoint m, so the loss is at most ``d cos(t)``, t the smallest
  angle between the sphere, seen from m, and the direction of the move;
* h is at most that of c plus the radius, and the sum at least ``|c-a| + |c-b| - 2 radius``.

The smaller of both, and nothing if the whole sphere lies on the far side, is what a
lower bound loses; the full drift is the worst case only.

Vectors become whole numbers ``floor(scale * x)``, centroids ``floor(sum / count)``, so results do
not depend on the order of rows.  Vectors with another number of components than ``dim``, or
with null or not finite ones, are left out.  Repeated rows are points of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, shared_folder, written
from .vectors import as_lists, integer_lists, matrix, products

K, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3
SLACK = 1e-9


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((np.asarray(x, np.float64) ** 2).sum(-1))


def planar_loss(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much nearer each centroid that moved from ``old`` to ``new`` can have come to any point of the sphere."""
    centre, old, new = (np.asarray(x, np.float64) for x in (centre, old, new))
    drift = lengths(new - old)
    safe = np.where(drift > 0, drift, 1)
    from_middle = centre - (old + new) / 2
    height = (from_middle * (new - old)).sum(-1) / safe
    away = lengths(from_middle)
    far = np.where(away > 0, away, 1)
    angle = np.arccos(np.clip(height / far, -1, 1)) - np.arcsin(np.clip(radius / far, 0, 1))
    cone = np.where(away > radius, drift * np.cos(np.clip(angle, 0, np.pi / 2)), drift)
    total = lengths(centre - old) + lengths(centre - new) - 2 * radius
    chord = np.where(total > 0, 2 * drift * np.maximum(height + radius, 0) / np.where(total > 0, total, 1), drift)
    return np.minimum(np.minimum(cone, chord), drift)


@dataclass
class Moves:
    """What a round needs to know: centroids, half the way to the next one, and how bounds change."""

    centers: np.ndarray
    drift: np.ndarray | None = None  # by cluster, for upper bounds
    loss: np.ndarray | None = None  # by cluster, for lower bounds
    half: np.ndarray = field(init=False)

    def __post_init__(self):
        gaps = np.array([np.sort(lengths(self.centers - c))[1:2].sum() if len(self.centers) > 1 else np.inf for c in self.centers])
        self.half = gaps / 2 * (1 - SLACK)


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Moves:
    """The change from ``old`` to ``new`` for clusters with the given radii around their old centroids."""
    loss = np.zeros(len(old))
    for i in range(len(old)):
        others = np.arange(len(old)) != i
        if others.any():
            loss[i] = planar_loss(old[i], radius[i], old[others], new[others]).max()
    return Moves(new, lengths(new - old) * (1 + SLACK), loss * (1 + SLACK) + SLACK)


def squared(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids, as whole numbers."""
    own = (vectors * vectors).sum(1)[:, None] + (centers * centers).sum(1)[None, :]
    return own - 2 * products(vectors, centers).astype(np.int64)


def reassign(vectors: np.ndarray, cluster: np.ndarray | None, upper, lower, moves: Moves):
    """cluster, upper, lower after a round, and how many vectors were compared with all centroids."""
    centers = moves.centers
    if cluster is None:
        cluster, upper, lower = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf), np.zeros(len(vectors))
        at = np.arange(len(vectors))
    else:
        upper = upper + moves.drift[cluster]
        lower = np.maximum(lower - moves.loss[cluster], 0) * (1 - SLACK)
        at = np.flatnonzero(upper >= np.maximum(lower, moves.half[cluster]))
        upper[at] = np.sqrt(((vectors[at] - centers[cluster[at]]) ** 2).sum(1)) * (1 + SLACK)
        at = at[upper[at] >= np.maximum(lower[at], moves.half[cluster[at]])]
    for i in range(0, len(at), 65_536):
        part = at[i:i + 65_536]
        d = squared(vectors[part], centers)
        every = np.arange(len(part))
        cluster[part] = d.argmin(1)  # the smaller number of equally near ones
        upper[part] = np.sqrt(d[every, cluster[part]]) * (1 + SLACK)
        d[every, cluster[part]] = np.iinfo(np.int64).max
        lower[part] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
    return cluster, upper, lower, len(at)


#: A state row is a vector, or (id and v null) what one task sums up for one cluster.
STATE = [
    T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()),
    T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType()), T.StructField("summary", T.BooleanType()),
    T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType())), T.StructField("compared", T.LongType())]


def round_pass(moves: Moves, dim: int, last: bool):
    """One round over the vectors of a task; at the end a row for each cluster with count, sum, radius and distances."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(moves.centers)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        radius, inertia, compared = np.zeros(k), [0] * k, 0
        kind = None
        for batch in it:
            kind, n = batch.schema.field("id").type, len(batch)
            vectors = matrix(batch.column("v"), dim)
            known = "cluster" in batch.schema.names
            state = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower")] if known else [None] * 3
            cluster, upper, lower, scanned = reassign(vectors, state[0], state[1], state[2], moves)
            compared += scanned
            distance = ((vectors - moves.centers[cluster]) ** 2).sum(1) if last else None
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, upper)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if n:
                total[cluster[order[starts]]] += np.add.reduceat(vectors[order], starts)
            if last:
                for c in np.unique(cluster):
                    inertia[c] += int(distance[cluster == c].sum())
            yield state_batch(batch.column("id"), batch.column("v"), cluster, upper, lower, distance)
        if kind is not None:
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(used), kind), pa.nulls(len(used), pa.list_(pa.int32())), pa.array(used.astype(np.int32)), pa.array(radius[used]),
                pa.nulls(len(used), pa.float64()), pa.array([inertia[c] for c in used], pa.int64()), pa.array([True] * len(used), pa.bool_()),
                pa.array(count[used]), as_lists(total[used].ravel(), np.full(len(used), dim), pa.int64()),
                pa.array([compared if i == 0 else 0 for i in range(len(used))], pa.int64())], names=["id", *(f.name for f in STATE)])

    return run


def state_batch(ids: pa.Array, v: pa.Array, cluster, upper, lower, distance) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        ids, v, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower),
        pa.nulls(n, pa.int64()) if distance is None else pa.array(distance), pa.array(np.zeros(n, bool)),
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=["id", *(f.name for f in STATE)])


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int, dim: int) -> DataFrame:
    """id and v (whole components) of the vectors that take part."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            mask, sizes, whole = integer_lists(batch.column("v"), scale)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(mask)), as_lists(whole, sizes)], names=["id", "v"])

    own = df.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).where(F.size("v") == dim)
    return own.mapInArrow(run, T.StructType([T.StructField("id", df.schema[vec_id].dataType), STATE[0]]))


@dataclass
class Clustering:
    """vectors: id, cluster, distance; clusters: a dict for each cluster; compared: by round, how many vectors met all centroids."""

    vectors: DataFrame
    clusters: list[dict]
    compared: list[int]


def fit(
    df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE,
    dim: int = DIM, seed: int = SEED,
) -> Clustering:
    """Starts from the ``k`` vectors with the smallest SHA-256 of ``seed:id``; a last assignment follows the rounds.

    Fewer vectors than ``k``: as many centroids.  Every round reads the vectors and bounds
    that the round before has written to the shared folder, and writes them anew; the
    driver holds the ``k`` centroids and their sums.  A round in which no centroid moves is the last.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    points = written(whole_vectors(df, vec_id, embedding, scale, dim))
    start = points.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    moves = Moves(np.array([r.v for r in start.select("v").collect()], np.int64).reshape(-1, dim))
    schema = T.StructType([points.schema["id"], *STATE])
    if not len(moves.centers):
        return Clustering(spark.createDataFrame([], schema).select("id", "cluster", "distance"), [], [])
    source, compared = points, []
    for number in range(rounds + 1):
        last = number == rounds
        path = f"{root}/{number}"
        source.mapInArrow(round_pass(moves, dim, last), schema).write.parquet(path)
        if number:
            removed(spark, f"{root}/{number - 1}")
        state = spark.read.schema(schema).parquet(path)
        parts = state.where("summary")
        clusters = {r.cluster: r for r in parts.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.max("upper").alias("radius"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
            F.sum("compared").alias("compared")).collect()}
        compared.append(sum(r.compared for r in clusters.values()))
        source = state.where("not summary").select("id", "v", "cluster", "upper", "lower", "distance")
        if last:
            break
        sums = parts.select("cluster", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
        new = moves.centers.copy()
        for r in sums.collect():  # k * dim rows
            new[r.cluster, r.at] = r.x // clusters[r.cluster].n
        radius = np.array([clusters[c].radius if c in clusters else 0.0 for c in range(len(new))])
        moves = moved(moves.centers, new, radius)
    found = [{
        "cluster": c, "n": clusters[c].n if c in clusters else 0, "inertia": int(clusters[c].inertia) if c in clusters else 0,
        "centroid": [int(x) for x in center]} for c, center in enumerate(moves.centers)]
    return Clustering(source.select("id", "cluster", "distance"), found, compared)


def cluster_report(df: DataFrame, **options) -> DataFrame:
    """A row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    found = fit(df, **options)
    total = sum(c["inertia"] for c in found.clusters)
    rows = [(c["cluster"], c["inertia"], total, hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest()) for c in found.clusters]
    by_cluster = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # A row per centroid: k of them.
    return found.vectors.join(F.broadcast(by_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
