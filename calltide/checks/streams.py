"""Checks of the live figures: streams run to their end against SQL."""

from pyspark.sql import functions as F

from calltide.checks.base import check, views
from calltide.checks.inputs import labelled, r6
from calltide.operators.score import RuleModel
from calltide.session import materialise, scratch_path
from calltide.sources.tables import event_calls, table
from calltide.plans.ledger import Ledger
from calltide.streaming import live, ordered, state

_PARTS = 4
# Files of a piece of a feed, written and read side by side: two, or one for this many rows.
_FILES = 2
_FILE_ROWS = 50_000


def _write_in_order(df, order: str, path: str, parts: int = _PARTS) -> int:
    """The rows as a feed would bring them: older ids first, some files at a time.

    Returns how many files a piece has, so that a piece becomes a micro-batch.
    """
    df = materialise(df, "feed")
    low, high, rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    step = (high - low) // parts + 1
    files = max(_FILES, -(-rows // (parts * _FILE_ROWS)))
    for i in range(parts):
        piece = df.filter((F.col(order) >= low + i * step) & (F.col(order) < low + (i + 1) * step))
        piece.repartition(files).write.mode("append").parquet(path)
    return files


def _messages(spark, folder):
    """Feed messages made from `events`: every call, alone or in a batch, and
    besides them agent notes, heartbeats and text that is not JSON."""
    calls = labelled(spark, folder).withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    name = F.col("syscall_name")
    event = F.struct(
        F.lit("syscall").alias("type"),
        F.col("at").alias("timestamp"),
        name.alias("syscall"),
        "category",
        F.round("latency_us", 4).alias("latency_us"),
        "cpu_usage",
        "memory_usage",
        "is_high_latency",
        "is_redundant",
        "pid",
    )
    alone = name.isin("execve", "openat", "ioctl", "accept4")
    # Nulls are left out of the JSON: some single calls carry no type.
    untyped = event.withField("type", F.when(name != "execve", F.lit("syscall")))
    user = F.col("pid").alias("user_id")
    singles = calls.filter(alone).select(user, "syscall_id", F.to_json(untyped).alias("value"))
    batch = F.struct(F.lit("syscall_batch").alias("type"), F.col("events"), F.lit("os-0").alias("platform"))
    batches = (
        calls.filter(~alone)
        .groupBy(user, F.expr("syscall_id div 500").alias("_slot"))
        .agg(F.array_sort(F.collect_list(F.struct("syscall_id", event.alias("e")))).alias("_events"))
        .withColumn("events", F.col("_events.e"))
        .withColumn("syscall_id", F.col("_events")[0]["syscall_id"])
        .select("user_id", "syscall_id", F.to_json(batch).alias("value"))
    )
    note = F.struct(
        F.when(name == "execve", "agent_info").otherwise("agent_offline").alias("type"),
        F.when(name == "execve", F.concat(F.lit("os-"), (F.col("pid") % 3).cast("string"))).alias("platform"),
        F.col("at").alias("timestamp"),
    )
    others = calls.filter(name.isin("execve", "futex", "read", "write")).select(
        user,
        "syscall_id",
        F.when(name == "read", '{"type": "heartbeat"}')
        .when(name == "write", F.concat(F.lit("not json "), "at"))
        .otherwise(F.to_json(note))
        .alias("value"),
    )
    return singles.unionByName(batches).unionByName(others)


def _message_stream(spark, folder, times: int = 1, parts: int = _PARTS, closing: bool = False):
    """A stream of the messages; ``closing`` adds, at its end, notes of user -1 years later."""
    path = scratch_path(spark, "messages")
    messages = _messages(spark, folder)
    for _ in range(times):
        files = _write_in_order(messages, "syscall_id", path, parts)
    if closing:
        for year in (2098, 2099):
            note = [(-1, f'{{"type": "agent_info", "timestamp": "{year}-01-01T00:00:00"}}')]
            spark.createDataFrame(note, "user_id long, value string").write.mode("append").parquet(path)
    return live.read_messages(spark, path, files_per_batch=files)


def _run(stream, keys):
    spark = stream.sparkSession
    path = scratch_path(spark, "updates")
    state.log_updates(stream, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return state.latest_updates(spark, path, keys)


_LIVE_SQL = "live AS (SELECT *, pid AS user_id FROM labelled)"


@check(
    "unpacked_events",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, syscall_name AS syscall, category,
                round(latency_us, 4) AS latency_us, is_high_latency, is_redundant FROM live""",
)
def unpacked_events(spark, folder):
    events = live.unpack_events(live.parse_messages(_messages(spark, folder)))
    return events.select(
        "user_id", "timestamp", "syscall", "category", F.round("latency_us", 4).alias("latency_us"),
        "is_high_latency", "is_redundant",
    )


@check(
    "live_counters",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, count(*) AS events, count(*) FILTER (WHERE is_high_latency) AS high_latency,
                count(*) FILTER (WHERE is_redundant) AS redundant FROM live GROUP BY 1""",
)
def live_counters(spark, folder):
    events = live.unpack_events(live.parse_messages(_message_stream(spark, folder)))
    return _run(live.live_counters(events), ["user_id"])


@check(
    "batch_ticks",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS tick,
                count(*) AS events, count(*) FILTER (WHERE is_high_latency) AS high_latency
         FROM live GROUP BY 1, 2""",
)
def batch_ticks(spark, folder):
    events = live.unpack_events(live.parse_messages(_message_stream(spark, folder)))
    ticks = _run(live.batch_ticks(events, "6 hours", late="60 days"), ["user_id", "tick"])
    return ticks.withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm"))


@check(
    "agent_presence",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, CASE arg_max(syscall_name, ts) WHEN 'futex' THEN 'offline' ELSE 'online' END AS status,
                max(CASE WHEN syscall_name = 'execve' THEN concat('os-', user_id % 3) END) AS platform,
                strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen
         FROM live WHERE syscall_name IN ('execve', 'futex') GROUP BY 1""",
)
def agent_presence(spark, folder):
    notes = live.parse_messages(_message_stream(spark, folder)).filter(F.col("type").startswith("agent_"))
    out = _run(live.agent_presence(notes), ["user_id"])
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_SNAPSHOT_SQL = """snap AS (SELECT user_id % 8 AS u, user_id AS pid, user_id // 2 AS ppid, CAST(k AS DOUBLE) AS cpu,
                                   date_trunc('day', ts) AS day FROM events_k),
  newest AS (SELECT u, max(day) AS day FROM snap GROUP BY 1)"""


def _snapshots(spark, folder):
    events = table(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    process = F.struct(F.col("user_id").alias("pid"), F.expr("user_id div 2").alias("ppid"), k.alias("cpu"))
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    lists = events.groupBy((F.col("user_id") % 8).alias("u"), day.alias("day")).agg(
        F.collect_list(process).alias("processes"), F.min("event_id").alias("syscall_id")
    )
    body = F.struct(
        F.lit("process_snapshot").alias("type"),
        "processes",
        F.concat(F.lit("host-"), F.col("u").cast("string")).alias("hostname"),
        F.size("processes").alias("count"),
        F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    return lists.select(F.col("u").alias("user_id"), "syscall_id", F.to_json(body).alias("value"))


@check(
    "process_snapshots",
    views("events_k", _SNAPSHOT_SQL)
    + """SELECT s.u AS user_id, concat('host-', s.u) AS hostname, pid, ppid, cpu
         FROM snap s JOIN newest n ON n.u = s.u AND n.day = s.day""",
)
def process_snapshots(spark, folder):
    path = scratch_path(spark, "messages")
    files = _write_in_order(_snapshots(spark, folder), "syscall_id", path)
    messages = live.parse_messages(live.read_messages(spark, path, files_per_batch=files))
    newest = _run(live.latest_snapshots(messages), ["user_id", "hostname"])
    return live.snapshot_processes(newest).select("user_id", "hostname", "pid", "ppid", "cpu")


@check(
    "ring_buffers",
    """WITH r AS (SELECT user_id, event_id, value,
                         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
       SELECT user_id, count(*) AS kept, min(event_id) AS oldest, max(event_id) AS newest,
              round(sum(value), 4) AS latency_us FROM r WHERE back <= 40 GROUP BY 1""",
)
def ring_buffers(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", F.col("value").alias("latency_us"))
    path = scratch_path(spark, "events")
    files = _write_in_order(events, "event_id", path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    rings = _run(state.ring_buffers(stream), ["user_id"])
    return rings.select(
        "user_id",
        F.size("event_id").alias("kept"),
        F.array_min("event_id").alias("oldest"),
        F.array_max("event_id").alias("newest"),
        F.round(F.aggregate("latency_us", F.lit(0.0), lambda a, x: a + x), 4).alias("latency_us"),
    )


@check(
    "streamed_redundancy",
    views("labelled")
    + "SELECT trace_id, syscall_id, is_redundant AS is_redundant_trace, is_redundant_generator FROM labelled",
)
def streamed_redundancy(spark, folder):
    calls = event_calls(spark, folder).select("trace_id", "syscall_id", "syscall_name")
    path, out = scratch_path(spark, "calls"), scratch_path(spark, "labelled")
    files = _write_in_order(calls, "syscall_id", path)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", files).parquet(path)
    state.label_stream(stream, out, scratch_path(spark, "checkpoint"), "both", span=1000).awaitTermination()
    return spark.read.parquet(f"{out}/labels").select(
        "trace_id", "syscall_id", "is_redundant_trace", "is_redundant_generator"
    )


@check(
    "streamed_scores",
    views("scored")
    + """SELECT syscall_id, round(anomaly_score, 6) AS anomaly_score, pattern_cluster,
                round(priority, 6) AS optimization_priority FROM scored""",
)
def streamed_scores(spark, folder):
    calls = labelled(spark, folder)
    model = RuleModel.fit(event_calls(spark, folder))
    path, out = scratch_path(spark, "calls"), scratch_path(spark, "scores")
    files = _write_in_order(calls, "syscall_id", path)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", files).parquet(path)
    state.score_stream(stream, model, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select(
        "syscall_id", r6("anomaly_score"), "pattern_cluster", r6("optimization_priority")
    )


# Calls come up to this many days after later ones; a call of a trace of its own ends the feed.
_LATE_DAYS = 5


def _shuffled_calls(spark, folder):
    """The calls of `events` with the time (``_comes``, seconds) at which a feed brings them."""
    calls = event_calls(spark, folder).select("trace_id", "syscall_id", "syscall_name", "ts")
    delay = F.pmod(F.col("syscall_id") * 7919, F.lit(_LATE_DAYS * 86400 - 3600))
    fed = calls.withColumn("_comes", F.unix_seconds("ts") + delay)
    last = F.max(F.unix_seconds("ts")) + 1000 * 86400
    clock = calls.agg(last.alias("_comes")).select(
        F.lit("clock").alias("trace_id"),
        F.lit(-1).cast("long").alias("syscall_id"),
        F.lit("tick").alias("syscall_name"),
        F.timestamp_seconds("_comes").alias("ts"),
        "_comes",
    )
    return fed, clock


@check(
    "streamed_late_labels",
    views("labelled")
    + "SELECT trace_id, syscall_id, is_redundant AS is_redundant_trace, is_redundant_generator FROM labelled",
)
def streamed_late_labels(spark, folder):
    """Calls that come days late get the labels of the batch rule, all of them."""
    fed, clock = _shuffled_calls(spark, folder)
    path, out = scratch_path(spark, "calls"), scratch_path(spark, "labelled")
    files = _write_in_order(fed, "_comes", path)
    clock.write.mode("append").parquet(path)
    rows = fed.drop("_comes")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    day = 86400
    state.label_stream(
        stream, out, scratch_path(spark, "checkpoint"), "both", span=1000, wait=_LATE_DAYS * day, keep=day, forget=400 * day
    ).awaitTermination()
    return spark.read.parquet(f"{out}/labels").filter("trace_id <> 'clock'").select(
        "trace_id", "syscall_id", "is_redundant_trace", "is_redundant_generator"
    )


_SILENCE = 2 * 86400


@check(
    "agent_timeouts",
    views("labelled", _LIVE_SQL)
    + f"""SELECT user_id, status, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, reason FROM (
        WITH sent AS (
          SELECT user_id, ts, false AS bye FROM live WHERE syscall_name IN ('execve', 'openat', 'ioctl', 'accept4')
          UNION ALL
          SELECT user_id, max(ts), false FROM live WHERE syscall_name NOT IN ('execve', 'openat', 'ioctl', 'accept4')
          GROUP BY user_id, syscall_id // 500
          UNION ALL
          SELECT user_id, ts, syscall_name = 'futex' FROM live WHERE syscall_name IN ('execve', 'futex')
        ), seconds AS (
          SELECT DISTINCT user_id, date_trunc('second', ts) AS sec, bye FROM sent
        ), placed AS (
          SELECT *, lag(sec) OVER w AS sec_before, lag(bye) OVER w AS bye_before, lead(sec) OVER w AS sec_after
          FROM seconds WINDOW w AS (PARTITION BY user_id ORDER BY sec, bye)
        )
        SELECT user_id, 'online' AS status, sec AS since, 'message' AS reason FROM placed
        WHERE NOT bye AND (sec_before IS NULL OR bye_before OR sec > sec_before + INTERVAL {_SILENCE} SECOND)
        UNION ALL
        SELECT user_id, 'offline', sec, 'goodbye' FROM placed
        WHERE bye AND NOT bye_before AND sec <= sec_before + INTERVAL {_SILENCE} SECOND
        UNION ALL
        SELECT user_id, 'offline', sec + INTERVAL {_SILENCE} SECOND, 'silence' FROM placed
        WHERE NOT bye AND (sec_after IS NULL OR sec_after > sec + INTERVAL {_SILENCE} SECOND))""",
)
def agent_timeouts(spark, folder):
    """When users come and go, told by their messages and by their silence."""
    messages = ordered.message_time(live.parse_messages(_message_stream(spark, folder, closing=True)))
    path = scratch_path(spark, "changes")
    # A batch has the time of its last event: it may come after singles that are later.
    changes = ordered.presence_changes(messages, _SILENCE, wait=60 * 86400)
    state.log_updates(changes, path, scratch_path(spark, "checkpoint"), mode="append").awaitTermination()
    return (
        Ledger(spark, path)
        .read()
        .filter("user_id <> -1")
        .select("user_id", "status", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "reason")
    )


@check(
    "repeated_messages",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, count(*) AS events, count(*) FILTER (WHERE is_high_latency) AS high_latency,
                count(*) FILTER (WHERE is_redundant) AS redundant FROM live GROUP BY 1""",
)
def repeated_messages(spark, folder):
    """Counters of a feed that is sent twice."""
    once = live.once(_message_stream(spark, folder, times=2), within="4000 days")
    return _run(live.live_counters(live.unpack_events(live.parse_messages(once))), ["user_id"])


@check(
    "refused_messages",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, concat('not json ', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS value, 'not json' AS reason
         FROM live WHERE syscall_name = 'write'""",
)
def refused_messages(spark, folder):
    return live.refused_messages(_messages(spark, folder))


@check(
    "compacted_updates",
    views("labelled", _LIVE_SQL)
    + """SELECT user_id, strftime(to_timestamp(floor(epoch(ts) / 86400) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS tick,
                count(*) AS events, count(*) FILTER (WHERE is_high_latency) AS high_latency
         FROM live GROUP BY 1, 2""",
)
def compacted_updates(spark, folder):
    """Ticks from a log of many batches that is folded after every third one."""
    events = live.unpack_events(live.parse_messages(_message_stream(spark, folder, parts=10)))
    ticks = live.batch_ticks(events, "1 day", late="60 days")
    path, keys = scratch_path(spark, "updates"), ["user_id", "tick"]
    state.log_updates(ticks, path, scratch_path(spark, "checkpoint"), keys=keys, every=3).awaitTermination()
    return state.latest_updates(spark, path, keys).withColumn("tick", F.date_format("tick", "yyyy-MM-dd"))
