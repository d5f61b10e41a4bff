"""Event time on streams: rows that wait for earlier ones, and users that fall silent.

Both keep what has not been decided yet in keyed state and are woken by event-time
timers when the watermark passes. State is gone once nothing waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}
BUCKETS = 16


def in_event_order(
    rows: DataFrame,
    key: str = "trace_id",
    ts: str = "ts",
    wait: int = 60,
    keep: int = 3600,
    spread: str = "syscall_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``rows`` of a stream, each once the stream's time is ``wait`` seconds past its own.

    Rows of a later micro-batch are never earlier than those of a micro-batch before,
    whatever order they came in; inside a micro-batch they have no order. A row that
    comes when its time has gone out already is passed on at once with ``is_late``, if
    it is at most ``keep`` seconds too late; Spark drops (and counts, as rows dropped by
    the watermark) what comes later still. A row without a time is late.

    Rows wait in ``buckets`` states of each key, so a key with a third of all rows is
    held by as many tasks. The last rows leave when a row of another key, a clock, moves
    the time on.
    """
    schema = StructType([f for f in rows.schema.fields])
    packed = rows.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
        F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int").alias("_bucket"),
        F.col(ts).alias("_ts"),
        F.unix_micros(F.col(ts)).alias("_at"),
        F.to_json(F.struct(*rows.columns), _JSON).alias("_row"),
    ).withWatermark("_ts", f"{wait + keep} seconds")
    ahead = keep * 1000

    def hold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Out goes, in this batch, what is at most this old and came before it.
        out_to = (state.getCurrentWatermarkMs() + ahead) * 1000
        times, texts = (list(x) for x in state.get) if state.exists else ([], [])
        out = [t <= out_to for t in times]
        yield pd.DataFrame({"row": [x for x, gone in zip(texts, out) if gone], "is_late": False})
        times, texts = ([x for x, gone in zip(column, out) if not gone] for column in (times, texts))
        if not state.hasTimedOut:
            for part in parts:
                late = ~(part["_at"] > out_to)
                yield pd.DataFrame({"row": part["_row"][late], "is_late": True})
                times += part["_at"][~late].astype("int64").tolist()
                texts += part["_row"][~late].tolist()
        if times:
            state.update((times, texts))
            state.setTimeoutTimestamp(-(-min(times) // 1000) - ahead)
        elif state.exists:
            state.remove()

    ordered = packed.groupBy("_key", "_bucket").applyInPandasWithState(
        hold,
        "row string, is_late boolean",
        "times array<long>, texts array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return ordered.select(F.from_json("row", schema, _JSON).alias("_r"), "is_late").select("_r.*", "is_late")


def message_time(messages: DataFrame) -> DataFrame:
    """``messages`` with ``ts``; a batch without a time of its own takes that of its last event."""
    times = F.transform("events", lambda e: F.try_to_timestamp(e["timestamp"]))
    return messages.withColumn("ts", F.coalesce("ts", F.array_max(times)))


def presence_changes(messages: DataFrame, silence: int, wait: int = 60, grain: int = 1) -> DataFrame:
    """When users of a stream of (user_id, ts, type) come and go: user_id, status, since, reason.

    A user is online from a message on, and offline after ``agent_offline`` (reason
    ``goodbye``) or after more than ``silence`` seconds without any message (reason
    ``silence``, since the last one and that time). A goodbye of an offline user changes
    nothing. Times have the resolution of ``grain`` seconds, and of a user's messages in the same grain
    only one travels, so a user with a third of all messages has a small state.
    Messages may be up to ``wait`` seconds late. A user that is offline leaves no state.
    """
    grain_ms, quiet = grain * 1000, silence * 1000
    slim = messages.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull()).select(
        F.col("user_id").cast("long").alias("user_id"),
        F.expr(f"unix_millis(ts) div {grain_ms} * {grain_ms}").alias("at"),
        (F.col("type") == "agent_offline").alias("bye"),
    )

    def once(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.drop_duplicates()

    thin = slim.mapInPandas(once, "user_id long, at long, bye boolean")
    timed = thin.withColumn("_ts", F.timestamp_millis("at")).withWatermark("_ts", f"{wait + grain} seconds")

    def follow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        times, byes, last = state.get if state.exists else ([], [], None)
        waiting = set(zip(times, byes))
        if not state.hasTimedOut:
            for part in parts:
                waiting |= set(zip(part["at"].astype("int64").tolist(), part["bye"].astype(bool).tolist()))
        out = []
        change = lambda status, at, reason: out.append((key[0], status, at, reason))
        for at, bye in sorted(waiting):
            if at + grain_ms > now:  # more may come of this grain or an earlier one
                break
            waiting.discard((at, bye))
            if last is not None and at - last > quiet:
                change("offline", last + quiet, "silence")
                last = None
            if bye and last is not None:
                change("offline", at, "goodbye")
                last = None
            elif not bye:
                if last is None:
                    change("online", at, "message")
                last = at
        if last is not None and last + quiet + grain_ms <= now:
            change("offline", last + quiet, "silence")
            last = None
        due = [at + grain_ms for at, _ in waiting]
        if last is not None:
            due.append(last + quiet + grain_ms)
        if due:
            held = sorted(waiting)
            state.update(([at for at, _ in held], [bye for _, bye in held], last))
            state.setTimeoutTimestamp(max(min(due), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "status", "since_ms", "reason"])

    changes = timed.groupBy("user_id").applyInPandasWithState(
        follow,
        "user_id long, status string, since_ms long, reason string",
        "times array<long>, byes array<boolean>, last long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return changes.select("user_id", "status", F.timestamp_millis("since_ms").alias("since"), "reason")
