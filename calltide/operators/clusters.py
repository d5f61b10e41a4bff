"""K-means whose restarts move together: one pass over the rows per step for all of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that starting centres are chosen from, by hash order of their values.
START_ROWS = 4096
# Rows whose distances to all centres stay in a core's cache.
_STEP_ROWS = 1024


def _spread_out(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a chance that grows with the square of its distance to those before."""
    chosen = [rows[rng.integers(len(rows))]]
    far = np.full(len(rows), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((rows - chosen[-1]) ** 2).sum(axis=1))
        total = far.sum()
        chosen.append(rows[rng.choice(len(rows), p=far / total)] if total > 0 else rows[rng.integers(len(rows))])
    return np.array(chosen)


@dataclass(frozen=True)
class Clusters:
    """Centres of the best restart, over numeric columns."""

    columns: tuple[str, ...]
    centres: np.ndarray
    cost: float
    costs: tuple[float, ...]

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        columns: tuple[str, ...],
        k: int = 5,
        restarts: int = 10,
        steps: int = 20,
        tolerance: float = 1e-4,
        seed: int = 42,
    ) -> "Clusters":
        """Moves all restarts' centres until none moves more than ``tolerance``, ``steps`` at most.

        A step is one aggregation: every task gives the sums of the rows nearest to each
        (restart, centre), restarts * k rows of sums made by matrix products over all restarts
        at once, which are added up by that key (a restart's cost stands at its first centre). The centres start from a bounded sample of the rows (``START_ROWS``
        by hash); every row counts in every step. ``rows`` should be a written table.
        """
        columns = tuple(columns)
        plain = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
        start = plain.orderBy(F.xxhash64(*columns), *columns).limit(START_ROWS).toPandas().to_numpy(float)
        if not len(start):
            raise ValueError("no rows to cluster")
        centres = np.array([_spread_out(start, k, np.random.default_rng(seed + i)) for i in range(restarts)])
        spark = rows.sparkSession
        sums = [f"s{j}" for j in range(len(columns))]
        schema = "restart int, centre int, n long, cost double, " + ", ".join(f"{s} double" for s in sums)

        def step(centres: np.ndarray) -> pd.DataFrame:
            shared = spark.sparkContext.broadcast(centres)

            def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held = shared.value.reshape(restarts * k, -1)
                # Times a row and 1: its squared distance less its own size, which is the same for every centre.
                apart = np.hstack([-2 * held, (held**2).sum(axis=1)[:, None]])
                cost, moved = np.zeros(restarts), np.zeros(apart.shape)
                far, flags = np.empty((2, restarts * k, _STEP_ROWS))
                for part in parts:
                    rows = np.ones((len(part), apart.shape[1]))  # the last column counts
                    for i, name in enumerate(columns):
                        rows[:, i] = part[name]
                    for low in range(0, len(rows), _STEP_ROWS):
                        x = rows[low : low + _STEP_ROWS]
                        n = len(x)
                        all_far = np.matmul(apart, x.T, out=far if n == _STEP_ROWS else None)
                        by_centre = all_far.reshape(restarts, k, n)
                        least = by_centre.min(axis=1)
                        is_near = by_centre == least[:, None, :]
                        taken = is_near[:, 0].copy()
                        for i in range(1, k):  # of equally near ones the first
                            is_near[:, i] &= ~taken
                            taken |= is_near[:, i]
                        least += np.einsum("ij,ij->i", x, x) - 1
                        cost += np.maximum(least, 0, out=least).sum(axis=1)
                        np.copyto(flags[:, :n], is_near.reshape(restarts * k, n))
                        moved += flags[:, :n] @ x
                out = pd.DataFrame(moved[:, :-1], columns=sums)
                out["restart"], out["centre"] = np.divmod(np.arange(restarts * k), k)
                out["n"] = np.rint(moved[:, -1]).astype(np.int64)
                yield out.assign(cost=np.where(out["centre"] == 0, cost[out["restart"]], 0.0))

            found = plain.mapInPandas(add, schema).groupBy("restart", "centre")
            total = found.agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)]).toPandas()  # restarts * k rows
            shared.unpersist()
            return total.sort_values(["restart", "centre"])

        moving = True
        for _ in range(steps):
            total = step(centres)
            n = total["n"].to_numpy(float).reshape(restarts, k, 1)
            means = total[sums].to_numpy(float).reshape(restarts, k, len(columns)) / np.maximum(n, 1)
            new = np.where(n > 0, means, centres)  # a centre without rows stays
            moving = bool((((new - centres) ** 2).sum(axis=2) > tolerance**2).any())
            centres = new
            if not moving:
                break
        costs = step(centres).groupby("restart")["cost"].sum().to_numpy()
        best = int(costs.argmin())
        # Numbered by their first coordinates, so that equal fits have equal numbers.
        order = np.lexsort(centres[best].T[::-1])
        return cls(columns, centres[best][order], float(costs[best]), tuple(map(float, costs)))

    def nearest(self) -> Column:
        """The number of the nearest centre (the smaller one of equally near ones)."""
        apart = [[F.col(c) - F.lit(float(v)) for c, v in zip(self.columns, centre)] for centre in self.centres]
        far = F.array(*[sum((d * d for d in one), F.lit(0.0)) for one in apart])
        # A row without a value is put to the last centre.
        return (F.coalesce(F.array_position(far, F.array_min(far)), F.lit(len(apart))) - 1).cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"columns": self.columns, "centres": self.centres.tolist(), "costs": self.costs})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Clusters":
        held = json.loads(spark.read.text(path).first()[0])
        costs = tuple(held["costs"])
        return cls(tuple(held["columns"]), np.array(held["centres"]), min(costs), costs)
