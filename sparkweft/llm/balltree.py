"""Centroid clustering of integer vectors with partition-local metric trees.

Each task grows trees over its own rows, of TREE_BYTES of vectors each. A ball
stores its rows' number, their exact integer sum, and its radius about the
floor of their mean. A round sends the centroids to the trees: where the
triangle inequality leaves one centroid that can be nearest to anything in a
ball, the ball's count and sum go to it at once, else its two halves are looked
at, and in a leaf the distances to the centroids left are computed exactly.
The trees are a written table, grown once and read by every round; vectors are
never shuffled, and a round gives back a count and a sum for each task and
centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm import common

#: Bytes of a tree's vectors; rows of a leaf; bytes of all centroids at most, as they go to every task.
TREE_BYTES, LEAF_ROWS, CENTROID_BYTES = 1 << 17, 32, 32 << 20
#: Components' largest size: squared distances of up to 64 components of it fit in 64 bits.
LARGEST = 1 << 27
#: Share of a distance by which a ball's bounds are widened: far more than square roots are off.
SLACK = 1e-9
TREE = "ids array<{}>, points binary, first binary, count binary, right binary, radius binary, sums binary"


def whole(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part: ``dim`` components, none null or not finite; each is floor(scale * x).

    A component beyond LARGEST is an error, since its distances have no 64 bits.
    """
    x = F.transform(vec_col, lambda c: c.cast("double"))
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = lambda c: F.when(F.abs(c * scale) > LARGEST, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).otherwise(F.floor(c * scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, scaled).alias("v"))


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances; as doubles multiply faster, they are used where all sums are below 2^53."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * most * most * points.shape[1] < 1 << 53:
        points, centres = points.astype(np.float64), centres.astype(np.float64)
    own = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", centres, centres)[None, :]
    return (own - 2 * (points @ centres.T)).astype(np.int64)


@dataclass
class Tree:
    """Balls in preorder: a ball's first half is the next one, ``right`` its second, 0 in a leaf. Points lie ball by ball."""

    points: np.ndarray
    first: np.ndarray
    count: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it has the points."""
        order, balls, stack = np.arange(len(points)), [], [(0, len(points), -1)]
        while stack:
            low, high, above = stack.pop()
            if above >= 0:
                balls[above][2] = len(balls)
            mine = points[order[low:high]]
            total = mine.sum(axis=0)
            far = squared(mine, (total // (high - low))[None, :])[:, 0]
            balls.append([low, high - low, 0, np.sqrt(float(far.max())) * (1 + SLACK), total])
            if high - low <= leaf or far.max() == 0:
                continue
            # Cut in half along the line between two points that are far apart.
            one = mine[far.argmax()]
            other = mine[squared(mine, one[None, :])[:, 0].argmax()]
            middle = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition((mine - one) @ (other - one), middle)]
            stack += [(low + middle, high, len(balls) - 1), (low, low + middle, -1)]
        first, count, right, radius, sums = zip(*balls, strict=True)
        return cls(points[order], np.array(first), np.array(count), np.array(right), np.array(radius), np.array(sums)), order

    def row(self, ids: pa.Array) -> list:
        kinds = ((self.points, "<i4"), (self.first, "<i4"), (self.count, "<i4"), (self.right, "<i4"), (self.radius, "<f8"), (self.sums, "<i8"))
        return [pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in kinds)]

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, dim: int) -> Tree:
        read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
        return cls(read(1, "<i4").astype(np.int64).reshape(-1, dim), read(2, "<i4"), read(3, "<i4"), read(4, "<i4"), read(5, "<f8"), read(6, "<i8").reshape(-1, dim))

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int | np.ndarray]]:
        """(ball, centroid) where all of a ball has one nearest centroid, (leaf, the centroid of each point) elsewhere; equally near: the first."""
        away = np.sqrt(squared(self.sums // self.count[:, None], centroids).astype(np.float64))
        low, high = away - self.radius[:, None], away + self.radius[:, None]
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            ball, left = stack.pop()
            bound = high[ball, left].min()
            left = left[low[ball, left] <= bound + SLACK * (bound + 1)]
            if len(left) == 1:
                yield ball, int(left[0])
            elif self.right[ball] == 0:
                at = self.first[ball]
                yield ball, left[squared(self.points[at : at + self.count[ball]], centroids[left]).argmin(axis=1)]
            else:
                stack += [(int(self.right[ball]), left), (ball + 1, left)]


def grown(rows: DataFrame, dim: int, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """The table of trees over (id, v), each over rows of one task."""
    most = max(LEAF_ROWS, tree_bytes // (4 * dim))
    id_type = rows.schema["id"].dataType.simpleString()
    common.small_batches(rows.sparkSession)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TREE.format(id_type).split(", ")]
        held, n = [], 0

        def one(held):
            table = pa.Table.from_batches(held).combine_chunks()
            points = table.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim)
            for at in range(0, len(points), most):
                tree, order = Tree.grow(points[at : at + most])
                ids = table.column(0).combine_chunks().slice(at, most).take(pa.array(order))
                yield pa.RecordBatch.from_arrays(tree.row(ids), names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield from one(held)
                held, n = [], 0
        if held:
            yield from one(held)

    return common.staged(rows.mapInArrow(trees, TREE.format(id_type)), "balls")


def summed(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) of what each task has of each centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.of(batch, i, dim)
                for ball, cluster in tree.assigned(centroids):
                    if isinstance(cluster, int):
                        count[cluster] += tree.count[ball]
                        sums[cluster] += tree.sums[ball]
                        continue
                    points = tree.points[tree.first[ball] :][: tree.count[ball]]
                    for c in np.unique(cluster):
                        mine = points[cluster == c]
                        count[c] += len(mine)
                        sums[c] += mine.sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return trees.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")


def told(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every row of the trees."""
    id_type = trees.schema["ids"].dataType.elementType.simpleString()
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.of(batch, i, dim)
                cluster = np.empty(len(tree.points), np.int32)
                for ball, mine in tree.assigned(centroids):
                    cluster[tree.first[ball] :][: tree.count[ball]] = mine
                away = tree.points - centroids[cluster]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(cluster), pa.array(np.einsum("ij,ij->i", away, away))], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, f"id {id_type}, cluster int, distance bigint")


def start(rows: DataFrame, k: int, seed: Column) -> np.ndarray:
    """The k vectors of smallest ``seed``, in its order; equal and null ones, which come last, go by their vectors."""
    return np.array([r.v for r in rows.orderBy(seed.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of means of what is nearest to each; empty ones stay."""
    parts = summed(trees, centroids).select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    new = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        new[r.cluster, r.at] = r.x // r.n
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1:", tree_bytes: int = TREE_BYTES) -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors take part as ``whole`` says. The first centroids are the k whose
    ids have the smallest digests (those with null ids come last, equal ids go
    by their vectors); fewer vectors are all centroids. Of centroids that are
    equally near the smaller number is taken, so of equal ones the later stay
    empty. Rows with equal or null ids are rows of their own. An empty table,
    or one without a vector that takes part, gives an empty one. Other columns
    do not matter, whatever their names.
    """
    if k * dim * 8 > CENTROID_BYTES:
        raise ValueError(f"{k} centroids of {dim} components are beyond {CENTROID_BYTES} bytes")
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vec_col, dim, scale)
    centroids = start(rows, k, F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    schema = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", "))).where(F.lit(False))
    trees = grown(rows, dim, tree_bytes)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    out = common.staged(told(trees, centroids), "clusters")
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    of = spark.createDataFrame([(c, s, digest(c)) for c, s in sums.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    # As many rows as there are centroids, whose bytes are bounded above.
    joined = out.join(F.broadcast(of), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")
