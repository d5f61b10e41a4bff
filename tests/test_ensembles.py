"""Boosted trees and forests from histograms, against Spark's own and plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from calltide.operators import ensembles, isolation, models
from calltide.operators.ensembles import Blocks, TreeEnsemble, boost, grow_forest, leaves

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(1500, 2)), rng.integers(0, 5, 1500)])
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * x[:, 2] + rng.normal(0, 0.5, 1500) > 1).astype(float)
    rows = pd.DataFrame(np.column_stack([np.arange(1500), x, y]), columns=["id", *COLUMNS, "y"])
    return spark.createDataFrame(rows).withColumn("key", F.xxhash64("id")).repartition(3).cache()


def with_own(spark_model, own, table):
    scored = spark_model.transform(VectorAssembler(inputCols=list(COLUMNS), outputCol="features").transform(table))
    return scored.select("y", vector_to_array("probability")[1].alias("p"), own.probability().alias("q")).toPandas()


def test_boosting_gives_what_spark_gives(spark, table, tmp_path, monkeypatch):
    vectors = VectorAssembler(inputCols=list(COLUMNS), outputCol="features").transform(table)
    plain = GBTClassifier(labelCol="y", maxIter=6, maxDepth=4, maxBins=256, stepSize=0.1, seed=1).fit(vectors)
    monkeypatch.setattr(ensembles, "_FEW_ROWS", 300)  # several tasks
    monkeypatch.setattr(ensembles, "_CHECKPOINT_EVERY", 2)
    own = boost(Blocks.of(table, COLUMNS, ("y",), "key", 1500), "y", 6, 4, 0.1)
    got = with_own(plain, own, table)
    # Equally good splits may be told apart by rounding: few rows, if any.
    assert (np.abs(got["p"] - got["q"]) < 1e-9).mean() > 0.99
    assert own.importance == pytest.approx(plain.featureImportances.toArray(), abs=0.02)
    own.save(spark, str(tmp_path / "m"))
    loaded = TreeEnsemble.load(spark, str(tmp_path / "m"))
    assert table.filter(loaded.probability() != own.probability()).count() == 0


def test_forest_is_as_good_as_sparks_and_the_same_for_any_tasks(table, monkeypatch):
    vectors = VectorAssembler(inputCols=list(COLUMNS), outputCol="features").transform(table)
    plain = RandomForestClassifier(labelCol="y", numTrees=30, maxDepth=6, maxBins=256, seed=1).fit(vectors)
    blocks = Blocks.of(table, COLUMNS, ("y",), "key", 1500)
    own = grow_forest(blocks, "y", 30, 6, 7)
    got = with_own(plain, own, table)
    assert np.abs(got["p"] - got["q"]).mean() < 0.05
    assert ((got["q"] - got["y"]) ** 2).mean() < ((got["p"] - got["y"]) ** 2).mean() * 1.1
    assert all(places[f >= 0].max(initial=0) < 255 for _, f, places, _ in own.trees)
    monkeypatch.setattr(ensembles, "_FEW_ROWS", 200)
    again = grow_forest(Blocks.of(table.repartition(7), COLUMNS, ("y",), "key", 1500), "y", 30, 6, 7)
    for one, other in zip(own.trees, again.trees):
        assert one[0] == other[0] and all(np.array_equal(a, b) for a, b in zip(one[1:], other[1:]))


def test_walk():
    rng = np.random.default_rng(1)
    places = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    feature, place = rng.integers(-1, 3, 31), rng.integers(0, 8, 31)
    for depth in range(6):
        got = leaves(places, feature, place, depth)
        for row in range(0, 500, 7):
            at = 0
            for _ in range(depth):
                f = feature[at]
                at = 2 * at + 1 + int(f >= 0 and places[f, row] > place[at])
            assert got[row] == at - ((1 << depth) - 1)


def test_draws_are_those_of_the_sql_hash(spark):
    rows = spark.range(-40, 40).select(F.col("id"), F.xxhash64("id").alias("key"))
    for seed, tree in ((43, 0), (43, 99), (7, 5)):
        got = rows.select("key", F.xxhash64(F.lit(seed), F.lit(tree), "key").alias("h")).toPandas()
        start = spark.range(1).select(F.xxhash64(F.lit(seed), F.lit(tree))).first()[0]
        mixed = isolation._begin_hash(got["key"].to_numpy(np.int64))
        assert (isolation._end_hash(mixed, start) == got["h"].to_numpy()).all()


def test_one_class_and_no_rows(spark, table):
    one = table.withColumn("y", F.lit(1.0))
    blocks = Blocks.of(one, COLUMNS, ("y",), "key", 1500)
    assert one.filter(boost(blocks, "y", 2, 3, 0.1).probability() <= 0.5).count() == 0
    assert one.filter(grow_forest(blocks, "y", 3, 3, 1).probability() != 1.0).count() == 0
    with pytest.raises(ValueError):
        Blocks.of(table.limit(0), COLUMNS, ("y",), "key", 0)


def test_training_reads_whole_blocks_not_rows(spark, small, monkeypatch):
    """Trees of the call model grow from blocks of bytes, and the test rows are scored once."""
    from calltide.checks.inputs import labelled

    written = []
    plain = models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, label: written.append((label, df.columns)) or plain(df, label))
    models.CallModel.fit(labelled(spark, small), iterations=1, restarts=1, trees=2)
    held = dict(written)
    assert held["blocks"] == ["n", "places", "keys", "y_high", "y_opt"]
    assert not any(c.startswith("scaled_") or c == "features" for c in held["training"])
    assert [label for label, _ in written].count("predicted") == 1
