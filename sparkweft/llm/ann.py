"""Nearest neighbours by learned partitions.

A neighbour graph is built over a bounded sample of the vectors and cut into
equal parts of few crossing edges; a softmax classifier learns to tell a
vector's part. Inside each part the same is done again, by one task a part on
a sample of its vectors, which gives leaves of a few dozen vectors. A leaf's
probability is that of its part times its own in the part. Every vector is put
in its most probable leaf, and a query is compared exactly with all vectors of
the leaves that are probable enough for it; that bound is the one with which
sample vectors find the wanted share of their neighbours.

Parts are dealt to tasks in pieces of bounded size, so a part that holds a
third of all vectors is many tasks, each with the queries of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

#: Vectors from which the parts are learned, at first and at most; a part's own sample.
SAMPLE, MOST_SAMPLE, PART_SAMPLE = 6000, 20_000, 4096
#: Parts (an eighth of the root of the vectors' number) and leaves of a part at most, vectors of a leaf, bytes of all leaves' classifiers at most.
MAX_PARTS, MAX_LEAVES, LEAF_ROWS, ROUTER_BYTES = 256, 128, 24, 32 << 20
#: Share of their neighbours that sample vectors find; sample queries that are tried.
TARGET, TRIALS = 0.94, 1000
#: Vectors and queries that one task compares at most.
PIECE_ROWS, PIECE_QUERIES = 32768, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v: little-endian doubles) of the vectors that take part.

    Null, empty, zero and non-finite ones do not, nor do rows without id or
    vectors of another length than most (the longer, if as many).
    """
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0].n if sizes else 0
    common.small_batches(vectors.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "v"])

    return rows.where(F.size("v") == width).mapInArrow(packed, "vec_id bigint, v binary")


def matrix(rows) -> np.ndarray:
    raw = b"".join(bytes(r) for r in rows)
    return np.frombuffer(raw, "<f8").reshape(len(rows), -1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector by inner product, nearest first, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 25) -> np.ndarray:
    """Parts of equal size (to a twentieth) of the graph with few crossing edges.

    It starts from cuts along principal directions and then moves vertices to
    the part of most of their neighbours, best gain first, as room allows.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        way = np.linalg.svd(centred[: 2000], full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
        order = rows[np.argsort(centred @ way, kind="stable")]
        half = count // 2
        cut = len(rows) * half // count
        todo += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    room = int(np.ceil(n / parts * 1.05))
    flat_from, flat_to = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (flat_from, part[flat_to]), 1)
        np.add.at(votes, (flat_to, part[flat_from]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: np.count_nonzero(gain > 0)]:
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved * 500 < n:
            break
    return part


@dataclass
class Softmax:
    """A linear classifier of the parts that vectors lie in, by their directions."""

    weights: np.ndarray
    bias: np.ndarray

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each part."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        s = (x / np.where(norm > 0, norm, 1)).astype(np.float32) @ self.weights + self.bias
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, rounds: int = 120) -> Softmax:
    """Softmax regression whose target is where a vector and its neighbours lie."""
    want = np.zeros((len(x), parts), np.float32)
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    want[np.arange(len(x)), part] += graph.shape[1] / 2
    want /= want.sum(1, keepdims=True)
    z = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    w, b = np.zeros((x.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    vw, vb, rate = w, b, np.float32(4.0 * np.sqrt(x.shape[1]))
    for k in range(rounds):
        s = z @ vw + vb
        p = np.exp(s - s.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - want) / np.float32(len(x))
        old_w, old_b = w, b
        w, b = vw - rate * (z.T @ g + np.float32(1e-5) * vw), vb - rate * np.float32(0.1) * g.sum(0)
        step = np.float32(k / (k + 3))
        vw, vb = w + step * (w - old_w), b + step * (b - old_b)
    return Softmax(w, b)


def learn(x: np.ndarray, parts: int, k: int) -> Softmax:
    """A classifier of that many balanced parts of the neighbour graph of x, of fewer if x is small."""
    parts = min(parts, len(x) // 8)
    if parts < 2:
        return Softmax(np.zeros((x.shape[1] if x.ndim == 2 else 0, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x, min(k, len(x) - 1))
    return fit_router(x, graph, balanced_cut(x, graph, parts), parts)


@dataclass
class Router:
    """Classifiers of the parts and of each part's leaves, and the logarithm of the probability from which a query visits a leaf."""

    parts: Softmax
    leaves: list[Softmax] = field(default_factory=list)
    least: float = -np.inf

    def log_leaves(self, x: np.ndarray, shares: np.ndarray, part: int) -> np.ndarray:
        return shares[:, part : part + 1] + self.leaves[part].log_shares(x)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part and leaf of each vector."""
        part = self.parts.log_shares(x).argmax(1)
        leaf = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            leaf[part == p] = self.leaves[p].log_shares(x[part == p]).argmax(1)
        return part, leaf

    def calibrate(self, x: np.ndarray, rows: int, k: int, target: float) -> None:
        """Sets the bound with which sample vectors find ``target`` of their neighbours in the sample.

        As many of the nearest in the sample as the k nearest of the table can
        be expected to be there, so they are as near as those that are sought.
        """
        if len(x) < 2:
            return
        graph = neighbour_graph(x, max(1, min(len(x) - 1, round(k * len(x) / max(rows, 1)))))[:TRIALS]
        part, leaf = self.home(x)
        shares = self.parts.log_shares(x[:TRIALS])
        seen = np.empty(graph.shape)
        for p in range(len(self.leaves)):
            mine = part[graph] == p
            at = np.flatnonzero(mine.any(1))
            if len(at):
                every = self.log_leaves(x[at], shares[at], p)
                seen[at] = np.where(mine[at], np.take_along_axis(every, np.where(mine[at], leaf[graph[at]], 0), 1), seen[at])
        found = np.sort(seen.ravel())
        self.least = float(found[int((1 - target) * len(found))]) - 1e-6


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, cuts: np.ndarray | None = None, probed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest of each query, itself excluded.

    With ``cuts``, x is in leaves one after another, and a query is compared
    only with those that are ``probed``. A matrix product picks those that can
    be among the k; their scores are then summed vector by vector, in the same
    order everywhere, so equal vectors have equal scores and ties go to the
    smaller id. A product that is no number takes no part; an infinite one does.
    """
    out_q, out_i, out_s = [], [], []
    for a in range(0, len(q), 256):
        block = q[a : a + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            if cuts is None:
                rough = block @ x.T
            else:
                rough = np.full((len(block), len(x)), np.nan)
                for leaf in np.flatnonzero(probed[a : a + 256].any(0)):
                    who = np.flatnonzero(probed[a : a + 256, leaf])
                    rough[who, cuts[leaf] : cuts[leaf + 1]] = block[who] @ x[cuts[leaf] : cuts[leaf + 1]].T
            open_ = ~np.isnan(rough) & (query_ids[a : a + 256, None] != ids[None, :])
            rough[~open_] = -np.inf
            m = min(k, len(ids))
            edge = np.partition(rough, len(ids) - m, axis=1)[:, len(ids) - m]
            slack = np.where(np.isfinite(edge), 1e-9 * (1 + np.abs(edge)), 0)
            rows, cols = np.nonzero((rough >= (edge - slack)[:, None]) & open_)
            exact = np.concatenate([(q[a + rows[i : i + 65536]] * x[cols[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0)
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < k
        out_q.append(query_ids[a + rows[keep]])
        out_i.append(ids[cols[keep]])
        out_s.append(exact[keep])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)) if out_q else (empty, empty, np.zeros(0))


def train(rows: DataFrame, total: int, k: int, target: float) -> Router:
    """A router from bounded samples of (vec_id, v): the parts on the driver, the leaves of each part by one task."""
    parts = int(min(MAX_PARTS, max(1, round(total**0.5 / 8))))
    size = max(SAMPLE, min(MOST_SAMPLE, 64 * parts))
    drawn = [bytes(r.v) for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(size).collect()]
    x = matrix(drawn) if drawn else np.zeros((0, 0))
    first = learn(x, min(parts, len(x) // 64), k)
    parts = len(first.bias)
    width = max(1, x.shape[1])
    leaves = max(1, min(MAX_LEAVES, ROUTER_BYTES // (4 * (width + 1) * parts), total // (parts * LEAF_ROWS)))
    sent = rows.sparkSession.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = sent.value.log_shares(matrix(batch.column(1).to_pylist())).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", "vec_id", "v"])

    placed = rows.mapInArrow(place, "part int, vec_id bigint, v binary")
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    own = [Softmax(np.zeros((width, 1), np.float32), np.zeros(1, np.float32)) for _ in range(parts)]
    if leaves > 1 and sizes:
        share = F.element_at(F.create_map(*(F.lit(v) for p, n in sizes.items() for v in (p, min(1.0, 1.1 * PART_SAMPLE / n)))), F.col("part"))
        # A little more than the share is drawn, then the bound holds to the row, also where ids are equal.
        some = placed.withColumn("h", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))).where(F.col("h") < share * F.lit(float(1 << 30)))
        some = some.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("h", "vec_id"))).where(F.col("n") <= PART_SAMPLE).drop("h", "n")

        def inside(group: pd.DataFrame) -> pd.DataFrame:
            y = matrix(group.sort_values("vec_id", kind="stable")["v"].tolist())
            got = learn(y, leaves, k)
            return pd.DataFrame({"part": [int(group["part"].iloc[0])], "w": [got.weights.tobytes()], "b": [got.bias.tobytes()]})

        for r in some.groupBy("part").applyInPandas(inside, "part int, w binary, b binary").collect():
            own[r.part] = Softmax(np.frombuffer(bytes(r.w), np.float32).reshape(width, -1), np.frombuffer(bytes(r.b), np.float32))
    router = Router(first, own)
    router.calibrate(x, total, k, target)
    return router


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, by inner product.

    ``is_query`` is a condition on vec_id. Every usable row is indexed. A
    query whose leaves hold fewer than k others is compared with all vectors.
    An empty table, or one without usable vectors, gives no rows. Rows that
    share an id are candidates each, but never for a query of that id.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = common.staged(usable(vectors, id_col, vec_col), "vectors")
    total = rows.count()
    if not total:
        return nothing
    sent = spark.sparkContext.broadcast(train(rows, total, k, target))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, leaf = sent.value.home(matrix(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array(leaf, pa.int32())], ["vec_id", "v", "part", "leaf"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that a query visits, with the leaves there as bits."""
        router = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1).to_pylist())
            shares = router.parts.log_shares(x)
            for p in range(len(router.leaves)):
                near = np.flatnonzero(shares[:, p] >= router.least)
                wanted = router.log_leaves(x[near], shares[near], p) >= router.least
                near, wanted = near[wanted.any(1)], wanted[wanted.any(1)]
                some = batch.take(pa.array(near))
                bits = [r.tobytes() for r in np.packbits(wanted, axis=1)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(near), p), pa.int32()), pa.array(bits, pa.binary())], ["query_id", "v", "part", "leaves"])

    home = common.staged(rows.mapInArrow(route, "vec_id bigint, v binary, part int, leaf int"), "routed")
    queries = rows.where(is_query)
    asked = common.staged(queries.mapInArrow(visits, "query_id bigint, v binary, part int, leaves binary"), "asked")
    sizes = {r.part: r["count"] for r in home.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    best = common.staged(_compared(home, asked, sizes, k), "best")
    # Queries whose leaves hold too few: compared with all of every part.
    whole = rows.groupBy("vec_id").count().select(F.col("vec_id").alias("query_id"), (F.lit(total) - F.col("count")).alias("others")).join(queries.select(F.col("vec_id").alias("query_id")).distinct(), "query_id")
    lists = best.select("query_id", F.size("top").alias("n"))
    short = common.staged(whole.join(lists, "query_id", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others")).select("query_id"), "short")
    if not short.isEmpty():
        every = F.explode(F.array(*map(F.lit, sorted(sizes)))).cast("int").alias("part")
        again = queries.withColumnRenamed("vec_id", "query_id").join(short, "query_id", "left_semi").select("query_id", "v", every, F.lit(None).cast("binary").alias("leaves"))
        best = best.join(short, "query_id", "left_anti").unionByName(_compared(home, common.staged(again, "again"), sizes, k))
    return best.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")


def _compared(home: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """query_id, top: the k nearest (vec_id, score) of each query in the leaves that it asks for; null leaves are all."""
    asks = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    pieces = lambda counts, each: F.coalesce(F.element_at(F.create_map(F.lit(-1), F.lit(1), *(F.lit(int(y)) for p, n in counts.items() for y in (p, -(-n // each)))), F.col("part")), F.lit(1))
    mine, theirs = pieces(sizes, PIECE_ROWS), pieces(asks, PIECE_QUERIES)
    # Each piece of a part's vectors meets each piece of its queries once.
    left = home.withColumn("a", F.pmod(F.xxhash64("vec_id"), mine).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), theirs - 1)))
    right = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), theirs).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), mine - 1)))

    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []}).astype({"query_id": "int64", "ids": object, "scores": object})
        vectors = vectors.sort_values(["leaf", "vec_id"], kind="stable")
        ids, x = vectors["vec_id"].to_numpy(), matrix(vectors["v"].tolist())
        found = []
        for whole, some in queries.groupby(queries["leaves"].isna()):
            cuts = probed = None
            if not whole:
                probed = np.unpackbits(np.frombuffer(b"".join(map(bytes, some["leaves"])), np.uint8).reshape(len(some), -1), axis=1).astype(bool)
                cuts = np.searchsorted(vectors["leaf"].to_numpy(), np.arange(probed.shape[1] + 1))
            found.append(best_of(ids, x, some["query_id"].to_numpy(), matrix(some["v"].tolist()), k, cuts, probed))
        q, i, s = (np.concatenate(z) for z in zip(*found, strict=True))
        cut = np.flatnonzero(np.diff(q)) + 1
        first = np.concatenate([[0], cut])[: len(q)]
        return pd.DataFrame({"query_id": q[first], "ids": np.split(i, cut)[: len(first)], "scores": np.split(s, cut)[: len(first)]})

    keys = ["part", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id bigint, ids array<bigint>, scores array<double>")
    # A query has a list of k from each piece at most, so those of one query are few.
    lists = found.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "scores"))).alias("all"))
    ranked = F.array_sort(F.transform("all", lambda x: F.struct((-x["scores"]).alias("m"), x["ids"].alias("vec_id"), x["scores"].alias("score"))))
    return lists.select("query_id", F.slice(ranked, 1, k).alias("top"))
