"""Nearest neighbours by inner product with a vantage-point tree for each shard.

Inner products become distances by one more dimension: a vector x gets the
component sqrt(M^2 - |x|^2), M the largest norm of the table, a query gets 0;
then the nearest by distance has the largest inner product. Each shard of bounded
size is a tree: an inner node splits its points by the median distance to a
vantage point, a leaf is scanned. Whole blocks of queries go down together. A
side of a node is skipped for a query if ``factor`` times the distance to the
split exceeds that of its k-th nearest so far; factor 1 is the triangle
inequality and exact, larger factors skip more and are approximate.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; equal scores go to the smaller id;
with fewer candidates all are returned; repeated ids are repeated candidates,
but never of a query of the same id; a repeated query is asked once, with the smallest
of its vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 20
SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
LEAF = 128
FACTOR = 1.0


class Tree:
    """Vantage-point tree over the lifted vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        rest = np.sqrt(np.maximum(0, most * most - (self.vectors**2).sum(axis=1)))
        self.lifted = np.concatenate([self.vectors, rest[:, None]], axis=1)
        self.square = (self.lifted**2).sum(axis=1)
        self.leaf = leaf
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return np.sort(members)
        # The point farthest from the first is near the rim: good splits.
        far = int(np.argmax(self._distance(self.lifted[members[0]], members)))
        vantage = members[far]
        distance = self._distance(self.lifted[vantage], members)
        middle = float(np.median(distance))
        inner = distance <= middle
        if inner.all():  # many at one distance
            inner = distance < middle
        if not inner.any() or inner.all():
            return np.sort(members)
        inside, outside = members[inner], members[~inner]
        return (
            int(vantage),
            float(distance[inner].max()),
            float(distance[~inner].min()),
            self._grow(inside),
            self._grow(outside),
        )

    def _distance(self, point: np.ndarray, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((self.lifted[members] - point) ** 2).sum(axis=1)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR):
        """For each query the places of its k nearest (-1: none) and their scores."""
        state = _Found(self, ids, queries, k, factor)
        state.visit(self.root, np.arange(len(ids)))
        return state.place, state.score


class _Found:
    """The best candidates of a block of queries while they go down a tree."""

    def __init__(self, tree: Tree, ids, queries, k, factor):
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        self.place = np.full((len(ids), k), -1, np.int64)
        self.score = np.full((len(ids), k), -np.inf)
        self.square = (queries**2).sum(axis=1)
        self.most = float(tree.square[0]) if len(tree.square) else 0.0

    def radius(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th nearest so far, with room for rounding."""
        worst = self.score[rows, -1]
        gap = self.square[rows] + self.most - 2 * worst
        return np.sqrt(np.maximum(0, gap)) * (1 + 1e-9) + 1e-9

    def visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self.scan(node, rows)
            return
        vantage, inside_to, outside_from, inside, outside = node
        lifted = self.tree.lifted[vantage]
        cross = self.queries[rows] @ lifted[:-1]
        distance = np.sqrt(np.maximum(0, self.square[rows] + self.tree.square[vantage] - 2 * cross))
        split = (inside_to + outside_from) / 2
        first = distance <= split
        self.visit(inside, rows[first])
        self.visit(outside, rows[~first])
        # The other side: inside points are at least distance - inside_to away,
        # outside points at least outside_from - distance.
        near = self.factor * (outside_from - distance[first]) <= self.radius(rows[first])
        self.visit(outside, rows[first][near])
        near = self.factor * (distance[~first] - inside_to) <= self.radius(rows[~first])
        self.visit(inside, rows[~first][near])

    def scan(self, members: np.ndarray, rows: np.ndarray) -> None:
        """A leaf: products by matrix first, and those that may count once more by a
        sum in fixed order, so that equal vectors get equal scores."""
        tree, k = self.tree, self.k
        for a in range(0, len(members), 4096):
            part = members[a : a + 4096]
            product = self.queries[rows] @ tree.vectors[part].T
            product[tree.ids[part] == self.ids[rows][:, None]] = -np.inf
            slack = 1e-9 * (1 + self.square[rows] + self.most)
            floor = self.score[rows, -1] - slack
            if len(part) > k:
                floor = np.maximum(floor, np.partition(product, len(part) - k, axis=1)[:, -k] - 2 * slack)
            row, column = np.nonzero(product >= floor[:, None])
            keep = product[row, column] > -np.inf
            row, column = row[keep], column[keep]
            if not len(row):
                continue
            exact = np.concatenate(
                [
                    (self.queries[rows[row[b : b + 65536]]] * tree.vectors[part[column[b : b + 65536]]]).sum(axis=1)
                    for b in range(0, len(row), 65536)
                ]
            )
            touched, local = np.unique(row, return_inverse=True)
            old = rows[touched]
            owner = np.concatenate([np.repeat(np.arange(len(old)), k), local])
            place = np.concatenate([self.place[old].ravel(), part[column]])
            score = np.concatenate([self.score[old].ravel(), exact])
            # Places follow the ids, so ties go to the smaller id.
            order = np.lexsort((np.where(place < 0, len(tree.ids), place), -score, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            best = order[rank < k]
            self.place[old] = place[best].reshape(-1, k)
            self.score[old] = score[best].reshape(-1, k)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with finite, non-zero vectors, as (_id, _vector) in double precision."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(values, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine & some).select(
        F.col(key).cast("long").alias("_id"), values.alias("_vector")
    )


def _matrix(column, width: int | None = None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width or -1)


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Trees of all shards as rows (shard, tree) with about ``shard_rows`` vectors each.

    ``vectors`` is what ``usable`` gives; a column of norms must fit all shards.
    """
    facts = vectors.groupBy(F.size("_vector").alias("width")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("_vector", F.lit(0.0), lambda total, x: total + x * x)).alias("most"),
    )
    best = facts.orderBy(F.desc("n"), "width").first()
    width, count, most = (best["width"], best["n"], math.sqrt(best["most"])) if best else (0, 0, 0.0)
    shards = max(1, -(-count // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids.append(batch.column("_id").to_numpy())
            rows.append(_matrix(batch.column("_vector"), width))
        if ids:
            ids, rows = np.concatenate(ids), np.concatenate(rows)
            for k in range(0, len(ids), 2 * shard_rows):  # uneven dealing never makes a giant
                tree = Tree(ids[k : k + 2 * shard_rows], rows[k : k + 2 * shard_rows], most * (1 + 1e-12))
                yield pa.RecordBatch.from_pydict({"tree": [pickle.dumps(tree, protocol=5)]})

    whole = vectors.where(F.size("_vector") == width)
    return whole.repartition(shards, "_id").mapInArrow(run, "tree binary")


def search(
    trees: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    factor: float = FACTOR,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest of every query (``usable`` rows) as (query_id, rank, vec_id, score).

    Queries are taken in blocks of about ``block`` rows; only one block at a time is
    broadcast to the shards. Each task gives the k nearest of its shards; those are merged.
    """
    context = queries.sparkSession.sparkContext
    queries = queries.groupBy("_id").agg(F.min("_vector").alias("_vector"))
    count = queries.count()
    blocks = max(1, -(-count // block))
    parts = []
    for number in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == number)
        held = part.toArrow()
        ids = held.column("_id").to_numpy()
        if not len(ids):
            continue
        lengths = pc.list_value_length(held.column("_vector")).to_numpy()
        width = np.bincount(lengths).argmax()
        values = held.filter(pa.array(lengths == width)).column("_vector").combine_chunks()
        shared = context.broadcast((ids[lengths == width], _matrix(values, int(width))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            best = np.full((len(ids), k), -np.inf)
            found = np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:  # the k nearest of all trees of a task
                for blob in batch.column("tree").to_pylist():
                    tree = pickle.loads(blob)
                    if tree.vectors.shape[1] != vectors.shape[1]:
                        continue
                    place, score = tree.search(ids, vectors, k, factor)
                    own = np.where(place >= 0, tree.ids[place], np.iinfo(np.int64).max)
                    best, found = np.concatenate([best, score], axis=1), np.concatenate([found, own], axis=1)
                    order = np.lexsort((found, -best), axis=1)[:, :k]
                    best, found = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
            row, column = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_pydict(
                {"query_id": ids[row], "vec_id": found[row, column], "score": best[row, column]}
            )

        parts.append(trees.mapInArrow(run, "query_id long, vec_id long, score double"))
    if not parts:
        return trees.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
