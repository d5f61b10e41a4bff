"""Streams with memory: rings of recent events and redundancy labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calltide.operators.chunks import DEFAULT_SPAN
from calltide.operators.label import GENERATOR_WINDOW, mark_redundant
from calltide.plans.ledger import EVERY, Ledger
from calltide.storage import Store
from calltide.streaming.live import RING
from calltide.streaming.ordered import in_event_order

_RING = "user_id long, event_id array<long>, latency_us array<double>"
# States that the rings are dealt to: calling Python for every user costs more than its ring.
RING_STATES = 2048


def _newest(users: np.ndarray, ids: np.ndarray, latencies: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k newest events of every user, by user and id; of equal ids the first one given."""
    order = np.lexsort((ids, users))
    users, ids, latencies = users[order], ids[order], latencies[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (users[1:] != users[:-1]) | (ids[1:] != ids[:-1])
    users, ids, latencies = users[new], ids[new], latencies[new]
    counts = np.unique(users, return_counts=True)[1]
    back = np.repeat(np.cumsum(counts), counts) - np.arange(len(users))
    kept = back <= k
    return users[kept], ids[kept], latencies[kept]


def ring_buffers(events: DataFrame, k: int = RING, states: int = RING_STATES) -> DataFrame:
    """Per user the last k latencies by event order, updated with every batch.

    Rows are (user_id, event_id, latency_us). Before the shuffle every Arrow
    batch is cut to its last k rows per user, so a user with most of the events
    sends few of them to the task that keeps its ring. The rings of some users share one of
    ``states`` states and are renewed together.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values("event_id").groupby("user_id", sort=False).tail(k)

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = (np.int64, np.int64, float)
        held = [np.array(x, dtype=t) for x, t in zip(state.get if state.exists else ([], [], []), kinds)]
        touched = held[0][:0]
        for rows in batches:
            came = [rows[c].to_numpy(t) for c, t in zip(("user_id", "event_id", "latency_us"), kinds)]
            touched = np.union1d(touched, came[0])
            held = _newest(*[np.concatenate(both) for both in zip(held, came)], k)
        state.update(tuple(column.tolist() for column in held))
        users, starts = np.unique(held[0], return_index=True)
        ends = np.append(starts[1:], len(held[0]))
        chosen = np.isin(users, touched)
        places = list(zip(starts[chosen].tolist(), ends[chosen].tolist()))
        yield pd.DataFrame(
            {
                "user_id": users[chosen],
                "event_id": [held[1][a:b] for a, b in places],
                "latency_us": [held[2][a:b] for a, b in places],
            }
        )

    # What belongs to no user or has no place in the order is in no ring.
    slim = events.select("user_id", "event_id", "latency_us").dropna(subset=["user_id", "event_id"])
    dealt = F.pmod(F.xxhash64("user_id"), F.lit(states))
    return (
        slim.mapInPandas(cut, slim.schema)
        .withColumn("_state", dealt)
        .groupBy("_state")
        .applyInPandasWithState(
            keep,
            _RING,
            "user_id array<long>, event_id array<long>, latency_us array<double>",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


# Streams work off what is there and stop, unless a trigger says otherwise, as
# {"processingTime": "500 milliseconds"} for a feed that runs on.
DRAIN = {"availableNow": True}


def log_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    trigger: dict | None = None,
    keys: list[str] | None = None,
    every: int = EVERY,
):
    """Starts writing a changing table as a log of batches under one manifest.

    A batch that runs again is left alone, so the log holds every update once. With
    ``keys`` the log is folded into a snapshot after ``every`` batches and stays
    small however long the stream runs. Read it with :func:`latest_updates`.
    """

    def write(rows: DataFrame, batch: int) -> None:
        Ledger(rows.sparkSession, path, keys, every).put(rows, batch)

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN))
        .foreachBatch(write)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key in an update log."""
    return Ledger(spark, path, keys).read()


def label_stream(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    rule: str = "trace",
    span: int = DEFAULT_SPAN,
    trigger: dict | None = None,
    wait: int | None = None,
    keep: int = 3600,
    forget: int | None = None,
):
    """Starts marking redundant calls of a stream of (trace_id, syscall_id, syscall_name, ...).

    The memory between batches is the last ten calls of every trace, a table
    of one folder per batch. A batch puts them before its own rows and runs the
    chunked rule of the batch operator, so one busy trace is spread over tasks.
    All folders of a batch are overwritten when it runs again: results and
    memory hold every call once. The memory of the two last batches is kept.

    Calls have numbers that rise with their time. Without ``wait``, the calls of a trace must
    come in this order from batch to batch. With ``wait`` (seconds; the stream then has a
    column ``ts``) calls may come that late: they wait in keyed state until the watermark
    has passed them and get the labels of the batch rule. A call that comes after
    later ones of its trace have gone out cannot be labelled: it goes to ``late`` instead
    of ``labels`` (at most ``keep`` seconds after its time).
    With ``forget`` (seconds; needs ``ts`` too), a trace whose last call is that much older than the
    newest call of all leaves the memory.
    """
    spark = calls.sparkSession
    memory = f"{path}/memory"
    kept = ["trace_id", "syscall_id", "syscall_name", *(["ts"] if forget is not None else [])]
    schema = calls.select(*kept).schema
    if wait is None:
        fed = calls.withColumn("is_late", F.lit(False))
    else:
        fed = in_event_order(calls, wait=wait, keep=keep)

    def write(rows: DataFrame, batch: int) -> None:
        # Read by the rule twice and by the memory once.
        rows.persist()
        try:
            label_batch(rows, batch)
        finally:
            rows.unpersist()

    def label_batch(rows: DataFrame, batch: int) -> None:
        new = rows.withColumn("_old", F.lit(False))
        is_late = F.col("is_late")
        if batch:
            old = spark.read.schema(schema).parquet(f"{memory}/batch={batch - 1}")
            seen = old.groupBy("trace_id").agg(F.max("syscall_id").alias("_seen"))
            new = new.join(seen, "trace_id", "left")
            is_late = is_late | F.coalesce(F.col("syscall_id") <= F.col("_seen"), F.lit(False))
        new = new.withColumn("is_late", is_late)
        if batch or wait is not None:
            late = new.filter("is_late").select(*calls.columns)
            late.write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        new = new.filter("NOT is_late").select(*calls.columns, "_old")
        known = new.unionByName(old.withColumn("_old", F.lit(True)), allowMissingColumns=True) if batch else new
        marked = mark_redundant(known, rule, span=span).filter(~F.col("_old")).drop("_old")
        marked.write.mode("overwrite").parquet(f"{path}/labels/batch={batch}")
        newest = Window.partitionBy("trace_id").orderBy(F.desc("syscall_id"))
        last = (
            known.select(*kept)
            .withColumn("_back", F.row_number().over(newest))
            .filter(F.col("_back") <= GENERATOR_WINDOW)
            .drop("_back")
        )
        if forget is not None:
            now = known.agg(F.unix_micros(F.max("ts"))).first()[0]
            if now is not None:
                fresh = last.groupBy("trace_id").agg(F.unix_micros(F.max("ts")).alias("_at"))
                fresh = fresh.filter(F.col("_at") >= now - forget * 1_000_000)
                last = last.join(fresh, "trace_id", "left_semi")
        last.write.mode("overwrite").parquet(f"{memory}/batch={batch}")
        store = Store(spark, memory)
        for name in store.names():
            if name.startswith("batch=") and int(name[6:]) < batch - 1:
                store.remove(name)

    return (
        fed.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN))
        .foreachBatch(write)
        .start()
    )


def score_stream(calls: DataFrame, model, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts scoring labelled calls of a stream into a Parquet table.

    Scoring is a projection, so the file sink's own exactly-once applies.
    """
    return (
        model.transform(calls)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN))
        .start()
    )
