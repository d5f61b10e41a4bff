"""Steps that were changed so that they grow with their input, against plain versions."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calltide.operators import models
from calltide.operators.clusters import Clusters
from calltide.operators.isolation import IsolationForest, _laid_out


def test_trees_laid_out_as_complete_ones(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"id": np.arange(900), "a": rng.lognormal(size=900), "b": np.round(rng.normal(size=900), 1)})
    df = spark.createDataFrame(rows)
    forest = IsolationForest.fit(df, ("a", "b"), "id", n_trees=7, sample=50)

    def depth(tree, row):
        node = tree.loc[0]
        while node.feature >= 0:
            node = tree.loc[node.left if row[int(node.feature)] < node.cut else node.right]
        return node.depth

    plain = [part.set_index("node") for _, part in forest.trees.groupby("tree")]
    cuts = [np.unique(forest.trees.loc[forest.trees["feature"] == f, "cut"]) for f in (0, 1)]
    assert all(len(_laid_out(part, cuts)[3]) >= len(part) for _, part in forest.trees.groupby("tree"))
    got = df.select("id", forest._depth_score().alias("s")).toPandas().set_index("id")["s"]
    for i in range(0, 900, 31):
        mean = np.mean([depth(tree, rows.loc[i, ["a", "b"]].to_list()) for tree in plain])
        norm = 2.0 * (np.log(49) + 0.5772156649015329) - 2.0 * 49 / 50
        assert got[i] == pytest.approx(-(2.0 ** (-mean / norm)), rel=1e-12)


def test_large_fits_run_one_after_the_other(spark):
    running, most, lock = [], [], threading.Lock()

    def fit():
        with lock:
            running.append(1)
            most.append(len(running))
        threading.Event().wait(0.2)
        with lock:
            running.pop()
        return len(most)

    assert len(models._at_once(spark, models._SIDE_BY_SIDE_ROWS + 1, fit, fit, fit)) == 3
    assert max(most) == 1
    models._at_once(spark, 10, fit, fit, fit)
    assert max(most) > 1


def test_a_task_gives_one_set_of_sums(spark, monkeypatch):
    """However many Arrow batches a task reads."""
    seen = []
    plain = type(spark.range(1)).mapInPandas

    def looked_at(self, function, schema, *more):
        out = plain(self, function, schema, *more)
        if "restart" in out.columns:
            seen.append(out.count())
        return out

    df = spark.range(0, 400, numPartitions=2).select((F.col("id") % 7).cast("double").alias("a"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        monkeypatch.setattr(type(df), "mapInPandas", looked_at)
        found = Clusters.fit(df, ("a",), k=3, restarts=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.cost > 0 and set(seen) == {2 * 3 * 4}


def test_a_large_feed_has_more_files(spark, tmp_path, monkeypatch):
    """A piece of a feed is written by as many tasks as its rows are worth and is one micro-batch."""
    from calltide.checks import streams

    monkeypatch.setattr(streams, "_FILE_ROWS", 100)
    path = str(tmp_path / "feed")
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("user"))
    files = streams._write_in_order(df, "id", path)
    assert files == 10
    batches = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(
        lambda rows, i: batches.append(sorted(r.id for r in rows.collect()))
    ).start().awaitTermination()
    assert batches == [list(range(i * 1000, (i + 1) * 1000)) for i in range(4)]


@pytest.mark.parametrize("states", [1, 3])
def test_rings_of_many_users_in_a_state(spark, tmp_path, states):
    from calltide.streaming.state import latest_updates, log_updates, ring_buffers

    rng = np.random.default_rng(2)
    schema = "user_id long, event_id long, latency_us double"
    want = {}
    for piece in range(3):
        rows = [(int(rng.integers(0, 9)), piece * 300 + i, float(rng.integers(0, 50))) for i in range(300)]
        rows += [(3, piece * 300 + 5, -1.0), (None, 1, 1.0), (4, None, 1.0)] if piece else []
        rows = rows if piece != 1 else [r for r in rows if r[0] != 7]
        for user, event, latency in rows:
            if user is not None and event is not None:
                want.setdefault(user, {}).setdefault(event, latency)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rings = ring_buffers(stream, k=6, states=states)
    log_updates(rings, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {r.user_id: r for r in latest_updates(spark, str(tmp_path / "out"), ["user_id"]).collect()}
    assert set(got) == set(want)
    for user, held in want.items():
        last = sorted(held)[-6:]
        assert got[user].event_id == last
        if user != 3:
            assert got[user].latency_us == [held[i] for i in last]


def test_readers_of_the_history_move_no_texts(spark, tmp_path):
    """Which row is the newest is settled without shuffling the texts of the analyses."""
    import contextlib
    import io
    import re

    from calltide.plans import history as hist

    rows = "user_id long, trace_id string, title string, analysis_json string, created_at timestamp"
    days = [(u, f"t{t}", "a", "long text", None) for u in (1, 2) for t in (1, 2)]
    made = spark.createDataFrame(days, rows).withColumn("created_at", F.timestamp_seconds(F.col("user_id") * 86400))
    hist.append(made, str(tmp_path / "h"))
    later = made.withColumn("created_at", F.expr("created_at + INTERVAL 1 SECOND"))
    hist.append(later.withColumn("analysis_json", F.lit("other")), str(tmp_path / "h"))
    found = hist.history(spark, str(tmp_path / "h"))
    assert [r.analysis_json for r in found.collect()] == ["other"] * 4
    newest = hist.latest_per_user(found, 10).select("user_id", "trace_id", "place")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        newest.explain(mode="formatted")
    moved = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]", shown.getvalue())
    names = {column.split("#")[0].strip() for columns in moved for column in columns.split(",")}
    assert names and names <= {"user_id", "trace_id", "created_at", "_mix"}
