"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on the driver on a bounded sample (``sample`` vectors, by a hash of the id) and has a bounded number
of leaves; every vector is then put into its leaf. A query goes down the tree through a priority queue of branches by the
distance to their centres, and visits leaves in that order. How many it visits is calibrated: the least number, found by
doubling and halving, at which sampled queries reach the asked recall against brute force over the sample.

Leaves are dealt out in cells of a bounded number of vectors; queries go to all cells of the leaves they visit, cells
keep their best ``k``, and those are merged. Distances are computed in double precision from the original vectors.

Vectors that are null, empty, zero, of another length than the most common, or that hold null or non-finite components take
no part. Rows with the same id are candidates one by one, but never for a query with that id; null ids take no part. With
fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, sliced

BRANCH, LEAVES = 8, 512
#: Vectors of one cell.
CELL = 4096


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of x, fewer than k if x has fewer distinct vectors."""
    x = np.unique(x, axis=0) if len(x) <= 4 * k else x
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Tree:
    """Nodes are numbered; ``children`` maps an inner node to its children, whose centres are in ``centres``."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres: dict[int, np.ndarray] = {}
        self.children: dict[int, list[int]] = {}
        self.n_leaves, made = 1, 1
        queue = [(-len(x), 0, x)]
        self.leaves = {0}
        while queue:
            n, node, own = heapq.heappop(queue)
            if -n <= leaf_size or self.n_leaves + BRANCH - 1 > LEAVES:
                continue
            centres = kmeans(own, BRANCH, rng)
            if len(centres) < 2:
                continue
            at = nearest(own, centres)
            kids = list(range(made, made + len(centres)))
            made += len(centres)
            self.centres[node], self.children[node] = centres, kids
            self.leaves.discard(node)
            self.leaves.update(kids)
            self.n_leaves += len(kids) - 1
            for i, kid in enumerate(kids):
                heapq.heappush(queue, (-int((at == i).sum()), kid, own[at == i]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.children or not len(rows):
                out[rows] = node
                continue
            at = nearest(x[rows], self.centres[node])
            todo += [(kid, rows[at == i]) for i, kid in enumerate(self.children[node])]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of a priority queue over all branches met so far."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if node in self.children:
                for d, kid in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node]):
                    heapq.heappush(heap, (d, kid))
            else:
                out.append(node)
        return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Leaf visits at which the sample's own queries find ``recall`` of their k nearest."""
    qs = np.random.default_rng(11).choice(len(x), min(queries, len(x)), replace=False)
    leaf, rank = tree.leaf(x), []
    for q in qs:
        order = {n: i for i, n in enumerate(tree.best_first(x[q], tree.n_leaves))}
        d = distances(x, x[q])
        d[q] = np.inf
        rank += [order[leaf[i]] for i in np.argsort(d, kind="stable")[: min(k, len(x) - 1)]]
    if not rank:
        return tree.n_leaves
    rank = np.sort(rank)
    return min(tree.n_leaves, int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1)


def search(vectors: DataFrame, *, every: int = 20, k: int = 10, recall: float = 0.97, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): rows whose id is divisible by ``every`` are queries against all other rows."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.where(finite)
    dim = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    dim = dim[0].n
    v = v.where(F.size("v") == dim)
    picked = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    x = np.stack(picked["v"].to_numpy()).astype(np.float64)
    tree = Tree(x, max(1, len(x) // LEAVES))
    visits = calibrate(tree, x, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def matrix(col) -> np.ndarray:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def put(batches):
        for b in sliced(batches, 4000):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.leaf(matrix(b.column(1))), pa.int64())], names=["vec_id", "v", "leaf"])

    def ask(batches):
        for b in sliced(batches, 500):
            m = matrix(b.column(1))
            got = [shared.value.best_first(q, visits) for q in m]
            at = np.repeat(np.arange(len(m)), [len(g) for g in got])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([n for g in got for n in g], pa.int64())], names=["vec_id", "v", "leaf"])

    leafed = durable(v.mapInArrow(put, "vec_id long, v array<double>, leaf long"))
    # cells of a leaf: its size is known, so each takes an even share by hash
    cells = {r.leaf: -(-r["count"] // CELL) for r in leafed.groupBy("leaf").count().collect()}
    n_cells = F.coalesce(F.create_map(*[F.lit(i) for kv in cells.items() for i in kv])[F.col("leaf")], F.lit(0))
    held = leafed.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_cells).cast("int"))
    asked = v.where(F.col("vec_id") % every == 0).mapInArrow(ask, "vec_id long, v array<double>, leaf long").withColumn("n", n_cells).where("n > 0")
    asked = asked.select("vec_id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("cell"))

    def best(key, own: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if own.num_rows and queries.num_rows:
            x, ids = matrix(own.column("v")), own.column("vec_id").to_numpy()
            for q, qid in zip(matrix(queries.column("v")), queries.column("vec_id").to_pylist()):
                d = distances(x, q)
                d[ids == qid] = np.inf
                if len(d) > k:
                    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                else:
                    some = np.arange(len(d))
                some = some[np.isfinite(d[some])]
                some = some[np.lexsort((ids[some], d[some]))][:k]
                for col, vals in zip(out, ([qid] * len(some), ids[some].tolist(), d[some].tolist())):
                    col += vals
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = asked.groupBy("leaf", "cell").cogroup(held.groupBy("leaf", "cell")).applyInArrow(lambda key, q, own: best(key, own, q), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
