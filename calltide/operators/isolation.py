"""Isolation forest (Liu, Ting and Zhou, 2008) for the anomaly score.

Each tree sees a small sample, so building is a grouped map over trees of a
fixed-size sample; scoring walks the broadcast trees over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from calltide.operators.ensembles import leaves
from calltide.operators.quantiles import quantiles
from calltide.session import materialise

_TREE = "tree int, node int, feature int, cut double, left int, right int, depth double"
# A tree's candidates are drawn with a chance that gives this many times its size
# on average; its sample is the part of them with the smallest hashes.
_SPARE = 1.6
# Rows that walk together.
_STEP_ROWS = 1 << 14


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _begin_hash(keys: np.ndarray) -> np.ndarray:
    """The part of Spark's ``xxhash64`` of a long that is the same whatever was hashed before it."""
    return _turned(keys.view(np.uint64) * _P2, 31) * _P1


def _end_hash(mixed: np.ndarray, start: int) -> np.ndarray:
    """``xxhash64`` of values with the hash ``start`` followed by the long that ``mixed`` was made of."""
    h = mixed ^ np.uint64((start + int(_P5) + 8) % (1 << 64))
    h = _turned(h, 27)
    h *= _P1
    h += _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _unsuccessful(n) -> float:
    """Mean path length of a failed search in a tree of n."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, depth); leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, values, 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        open_features = np.flatnonzero(high > low) if len(rows) > 1 else []
        if depth >= limit or len(open_features) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _unsuccessful(len(rows))))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] < cut
        nodes.append((node, feature, cut, count, count + 1, float(depth)))
        todo.append((count, rows[below], depth + 1))
        todo.append((count + 1, rows[~below], depth + 1))
        count += 2
    return nodes


def _laid_out(tree: pd.DataFrame, cuts: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a complete one: depth, feature (-1 of leaves) and cut's place of inner nodes, depth score of the last level.

    A leaf above the last level stands for all nodes below it.
    """
    nodes = {row.node: row for row in tree.itertuples(index=False)}
    slots, level, depth = [(nodes[0], 0, 0)], 0, 0
    todo = list(slots)
    while todo:
        row, at, level = todo.pop()
        depth = max(depth, level)
        if row.feature >= 0:
            inner = [(nodes[row.left], 2 * at + 1, level + 1), (nodes[row.right], 2 * at + 2, level + 1)]
            slots += inner
            todo += inner
    feature = np.full((2 << depth) - 1, -1, dtype=np.intp)
    place, value = np.zeros(len(feature), dtype=np.int32), np.zeros(len(feature))
    for row, at, level in slots:
        if row.feature >= 0:
            feature[at], place[at] = row.feature, np.searchsorted(cuts[row.feature], row.cut)
        else:
            under = depth - level
            first = ((at + 1) << under) - 1
            value[first : first + (1 << under)] = row.depth
    return depth, feature, place, value


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees. ``score`` is negative for the most isolated rows."""

    features: tuple[str, ...]
    sample: int
    offset: float
    trees: pd.DataFrame

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        features: tuple[str, ...],
        key: str,
        n_trees: int = 100,
        sample: int = 256,
        contamination: float = 0.05,
        seed: int = 42,
    ) -> "IsolationForest":
        """``rows`` hold numeric ``features`` and a unique whole number ``key``.

        Every tree draws its own ``sample`` of all rows: the rows with the smallest
        hashes of (tree, key). A row is kept for the trees for which its hash lies
        under a threshold set by the row count, and what is kept, about
        ``n_trees * sample`` rows whatever the size of the table, is ranked per tree.
        """
        spark = rows.sparkSession
        features = tuple(features)
        share = min(1.0, (sample * _SPARE + 64) / max(1, rows.count()))
        most = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
        # The hash of (tree, key) goes on from that of the tree.
        begun = spark.range(1).select(*[F.xxhash64(F.lit(seed + 1), F.lit(t)) for t in range(n_trees)]).first()

        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                mixed = _begin_hash(part["_key"].to_numpy(np.int64))
                drawn = [np.flatnonzero(_end_hash(mixed, start) <= most) for start in begun]
                at = np.concatenate(drawn)
                if len(at):
                    out = part.iloc[at]
                    trees = np.repeat(np.arange(n_trees), [len(d) for d in drawn])
                    yield pd.DataFrame({"_key": out["_key"], "_v": list(out[names].to_numpy(float)), "tree": trees})

        names = [f"v{i}" for i in range(len(features))]
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)]
        picked = (
            rows.select(F.col(key).cast("long").alias("_key"), *numbers)
            .mapInPandas(draw, "_key long, _v array<double>, tree int")
            .withColumn("_t", F.xxhash64(F.lit(seed + 1), F.col("tree"), F.col("_key")))
            .withColumn(
                "_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_t", "_key"))
            )
            .filter(F.col("_rank") <= sample)
        )
        picked = materialise(picked, "forest-samples")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            values = np.array(pdf.sort_values("_rank")["_v"].tolist(), dtype=float)
            rng = np.random.default_rng((seed, tree))
            limit = max(1, math.ceil(math.log2(max(len(values), 2))))
            grown = pd.DataFrame(
                _grow(values, rng, limit), columns=["node", "feature", "cut", "left", "right", "depth"]
            )
            grown.insert(0, "tree", tree)
            return grown

        grown = picked.select("tree", "_rank", "_v").groupBy("tree").applyInPandas(build, _TREE)
        # At most n_trees x 2 x sample small rows.
        trees = grown.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        sizes = picked.groupBy("tree").count().agg(F.max("count")).first()[0]
        fitted = cls(features, int(sizes), 0.0, trees)
        # Written, since percentiles read it several times and the walk is the costly part.
        training = materialise(rows.select(fitted._depth_score().alias("_s")), "forest-scores")
        cut = quantiles(training, "_s", {"cut": contamination}).first()["cut"]
        return cls(features, int(sizes), float(cut), trees)

    def _depth_score(self) -> Column:
        """Minus the anomaly value of the paper, as a vectorised function.

        Trees are laid out as complete ones and walked by :func:`leaves`. Values are first turned into
        their places among the cuts of their feature, small numbers that compare with a cut's place as the values do.
        """
        feature_names, norm = self.features, _unsuccessful(self.sample)
        cuts = [
            np.unique(self.trees.loc[self.trees["feature"] == f, "cut"].to_numpy(float))
            for f in range(len(feature_names))
        ]
        number = np.uint16 if max(map(len, cuts)) < 1 << 16 else np.uint32
        forest = []
        for _, part in self.trees.groupby("tree"):
            depth, feature, place, value = _laid_out(part, cuts)
            inner = (1 << depth) - 1
            forest.append((depth, feature[:inner], place[:inner].astype(number), value[inner:]))

        @F.pandas_udf(DoubleType())
        def walk(*columns: pd.Series) -> pd.Series:
            total = np.zeros(len(columns[0]))
            values = [c.to_numpy(dtype=float, na_value=0.0) for c in columns]
            for low in range(0, len(total), _STEP_ROWS):
                here = total[low : low + _STEP_ROWS]
                places = np.empty((len(values), len(here)), dtype=number)
                for f, column in enumerate(values):
                    # How many cuts are not above the value; no value is below no cut.
                    places[f] = np.searchsorted(cuts[f], column[low : low + _STEP_ROWS], side="right")
                for depth, feature, place, value in forest:
                    here += value.take(leaves(places, feature, place, depth))
            mean_depth = total / len(forest)
            return pd.Series(-np.power(2.0, -mean_depth / norm) if norm > 0 else -np.ones(len(total)))

        return walk(*[F.col(c).cast("double") for c in feature_names])

    def score(self) -> Column:
        return self._depth_score() - F.lit(self.offset)

    def save(self, spark: SparkSession, path: str) -> None:
        meta = f"sample={self.sample};offset={self.offset!r};features={','.join(self.features)}"
        frame = spark.createDataFrame(self.trees, _TREE).withColumn("meta", F.lit(meta))
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        frame = spark.read.parquet(path)
        parts = dict(p.split("=", 1) for p in frame.select("meta").first()[0].split(";"))
        trees = frame.drop("meta").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        return cls(tuple(parts["features"].split(",")), int(parts["sample"]), float(parts["offset"]), trees)
