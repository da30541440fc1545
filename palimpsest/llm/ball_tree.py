"""k-means over vectors of whole numbers, with ball trees that give whole balls to one centroid.

Each task builds metric trees over blocks of the vectors that it reads, once; a node stores its count, the sum of its vectors as
integers, and a radius around their mean. A round takes the centroids down each tree: by the triangle inequality a centroid
whose distance to a ball's middle exceeds the nearest one's by over two radii is nearest to no vector in it. With one centroid
left, the ball's count and sum are added to it as a whole; leaves that stay undecided compare their vectors exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import missing, stored

#: Vectors in a tree, vectors in a leaf that may be split no further.
BLOCK, LEAF = 1024, 32
#: Largest component after scaling: squared distances of as many as 64 components stay within a long.
LIMIT = 1 << 26


def build(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A tree over the rows of ``x``: their new order, and start, end, left, right (-1 for leaves), sum and radius of each node.

    A node is halved at the median of the component with the largest spread; one whose vectors are equal stays whole.
    """
    order = np.arange(len(x))
    start, end, left, right, sums, radius = [0], [len(x)], [-1], [-1], [], []
    at = 0
    while at < len(start):
        rows = order[start[at] : end[at]]
        mine = x[rows]
        total = mine.sum(0)
        sums.append(total)
        # a little more than the largest distance, so that rounding never makes a ball too small
        radius.append(float(np.sqrt(((mine - total / len(mine)) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-9)
        spread = mine.max(0) - mine.min(0)
        if len(rows) > LEAF and spread.any():
            half = len(rows) // 2
            order[start[at] : end[at]] = rows[np.argpartition(mine[:, int(spread.argmax())], half)]
            for side, a, z in ((left, start[at], start[at] + half), (right, start[at] + half, end[at])):
                side[at] = len(start)
                start.append(a)
                end.append(z)
                left.append(-1)
                right.append(-1)
        at += 1
    return order, {"start": np.array(start), "end": np.array(end), "left": np.array(left), "right": np.array(right), "sums": np.stack(sums), "radius": np.array(radius)}


def exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, in whole numbers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def descend(tree: dict[str, np.ndarray], x: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(node, centroid) of balls that go whole; the vectors left over, by their place, and the centroid of each."""
    whole, leaves = [], []
    count = tree["end"] - tree["start"]
    nodes, able = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(nodes):
        middle = tree["sums"][nodes] / count[nodes, None]
        away = np.sqrt(((middle[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
        away[~able] = np.inf
        least = away.min(1, keepdims=True)
        able = away <= (least + 2 * tree["radius"][nodes, None]) * (1 + 1e-9) + 1e-9
        alone = able.sum(1) == 1
        whole += zip(nodes[alone].tolist(), able[alone].argmax(1).tolist(), strict=True)
        nodes, able = nodes[~alone], able[~alone]
        inner = tree["left"][nodes] >= 0
        leaves += nodes[~inner].tolist()
        nodes, able = nodes[inner], able[inner]
        nodes, able = np.concatenate([tree["left"][nodes], tree["right"][nodes]]), np.concatenate([able, able])
    places = np.concatenate([np.arange(tree["start"][k], tree["end"][k]) for k in leaves]) if leaves else np.zeros(0, np.int64)
    return whole, places, exact(x[places], centroids).argmin(1)  # the first of equals is the smaller number


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors with exactly ``dims`` components, none null or not finite, as floor(scale * component)."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(F.coalesce(fine, F.lit(False)))
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("x"))


def seed_key(vec_id: Column, seed: int) -> Column:
    """Lowercase hex sha256 of ``seed:vec_id``; null for a null id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes; rows with one id follow each other by components, rows without an id come last."""
    got = kept.orderBy(seed_key(F.col("vec_id"), seed).asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64) if got else np.zeros((0, 0), np.int64)


TREE = "ids array<long>, points binary, start binary, end binary, left binary, right binary, sums binary, radius binary"


def trees(kept: DataFrame, dims: int) -> DataFrame:
    """One row for each block of at most BLOCK vectors of a partition: the vectors in the tree's order, and its nodes.

    A task holds one block beside the batch that it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                if (np.abs(x) > LIMIT).any():
                    raise ValueError(f"a component is over {LIMIT} after scaling: squared distances wouldn't fit a long")
                order, tree = build(x)
                raw = [x[order].astype(np.int32).tobytes(), *(tree[n].astype(np.int32).tobytes() for n in ("start", "end", "left", "right")), tree["sums"].astype(np.int64).tobytes(), tree["radius"].tobytes()]
                ids = part.column(0).take(pa.array(order)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in raw)], [c.split()[0] for c in TREE.split(", ")])

    return kept.mapInArrow(run, TREE)


def _open(batch: pa.RecordBatch, k: int, dims: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = [batch.column(c)[k].as_buffer() for c in range(1, batch.num_columns)]
    tree = {n: np.frombuffer(b, np.int32).astype(np.int64) for n, b in zip(("start", "end", "left", "right"), raw[1:5], strict=True)}
    return tree | {"sums": np.frombuffer(raw[5], np.int64).reshape(-1, dims), "radius": np.frombuffer(raw[6], np.float64)}, np.frombuffer(raw[0], np.int32).astype(np.int64).reshape(-1, dims)


def sums(forest: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """(count, sum of the vectors) by centroid, exact. A task sends a row a centroid; Spark adds them up."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                tree, x = _open(batch, row, dims)
                whole, places, nearest = descend(tree, x, centroids)
                for node, c in whole:
                    n[c] += tree["end"][node] - tree["start"][node]
                    total[c] += tree["sums"][node]
                np.add.at(n, nearest, 1)
                np.add.at(total, nearest, x[places])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = forest.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("dim", "s"))
    added = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    counts, totals = [0] * k, [[0] * dims for _ in range(k)]
    for r in added.collect():  # a row for each centroid and component
        counts[r.cluster] = r.n
        totals[r.cluster][r.dim] = int(r.s)
    return list(zip(counts, totals, strict=True))


def moved(centroids: np.ndarray, found: list[tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid with vectors at floor(sum / count) of them, component by component; the others where they were."""
    return np.array([[s // n for s in total] if n else list(was) for was, (n, total) in zip(centroids.tolist(), found, strict=True)], np.int64)


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each vector, and the squared distance to it."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, x = _open(batch, row, dims)
                cluster = np.zeros(len(x), np.int32)
                whole, places, nearest = descend(tree, x, centroids)
                for node, c in whole:
                    cluster[tree["start"][node] : tree["end"][node]] = c
                cluster[places] = nearest
                distance = ((x - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """k-means over (vec_id, embedding): (vec_id, cluster, distance) of each vector that is kept, and the final centroids.

    Vectors with another length, or with a component that is null or not finite, have no row. Rows that repeat are a vector
    each; a null id stays null, and its vector never starts a centroid while others can. Equal distances: the smaller number.
    Fewer vectors than ``k``: as many centroids. None, or an empty table: no rows, no centroids. Components over LIMIT after
    scaling: an error. Other columns aren't read. To the driver come the k sums of a round; what grows stays in tasks.
    """
    missing(vectors, "vec_id", "embedding")
    spark: SparkSession = vectors.sparkSession
    kept = quantised(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    forest = stored(trees(kept, dims), "trees")
    for _ in range(rounds):
        centroids = moved(centroids, sums(forest, centroids))
    return assigned(forest, centroids), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of ``cluster`` with cluster_inertia, inertia (sums of the distances) and centroid_sha256 (of its components, by commas)."""
    rows = stored(rows, "clusters")
    by_cluster = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, by_cluster.get(c, 0), sum(by_cluster.values()), name) for c, name in enumerate(names)]  # k rows
    more = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(more), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
