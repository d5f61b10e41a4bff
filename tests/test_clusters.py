"""K-means steps and nearest centres, as they are computed on many rows."""

import numpy as np
from pyspark.sql import functions as F

from calltide.operators.clusters import Clusters


def test_nearest_is_plain_arithmetic(spark):
    """Multiplications instead of powers, and equal to a plain search, ties and unknown values included."""
    centres = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 4.0]])
    rows = [(float(a), float(b)) for a in (-1, 0, 1, 2, 3) for b in (-1, 0, 2, 5)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "a double, b double")
    number = Clusters(("a", "b"), centres, 0.0, ()).nearest()
    got = df.select("a", "b", number.alias("n")).collect()
    for r in got:
        far = None if r.a is None else ((np.array([r.a, r.b]) - centres) ** 2).sum(axis=1)
        assert r.n == (3 if far is None else far.argmin())
    plan = df.select(number.alias("n"))._jdf.queryExecution().toString().lower()
    assert "power" not in plan and "pow(" not in plan


def test_distances_take_no_memory_of_their_own(spark, monkeypatch):
    """However many rows a batch has, a step multiplies pieces of bounded size, and the sums are those of a plain step."""
    from calltide.operators import clusters

    monkeypatch.setattr(clusters, "_STEP_ROWS", 7)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 2)), 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    found = Clusters.fit(df, ("a", "b"), k=4, restarts=3)
    far = ((x[:, None, :] - found.centres[None]) ** 2).sum(axis=2)
    assert abs(found.cost - far.min(axis=1).sum()) < 1e-9 * found.cost
    near = far.argmin(axis=1)
    means = np.array([x[near == i].mean(axis=0) for i in range(4)])
    assert np.abs(means - found.centres).max() < 0.2
