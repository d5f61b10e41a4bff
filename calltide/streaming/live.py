"""Live figures: JSON messages in, counters, rings and labels out.

Every function on rows works on a static DataFrame as well, which is how the
streams are checked: a stream run to its end equals the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from calltide.schemas import EVENT, MESSAGE

# Fixed values of the live display.
RING, FEED = 40, 50
BAND_FLOOR, RED_SHARE, AMBER_SHARE, LOWEST_HEIGHT = 100.0, 0.7, 0.4, 5.0


def recent_events(rows: DataFrame, k: int = FEED, user: str = "user_id", order: str = "event_id") -> DataFrame:
    """The last k events of every user; ``back`` counts from the newest (1).

    Each task keeps k rows per user before the shuffle.
    """
    newest = Window.partitionBy(user).orderBy(F.desc(order))
    return rows.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= k)


def latency_bands(ring: DataFrame, user: str = "user_id") -> DataFrame:
    """Bar colour and height of the events in a ring (at most 40 per user)."""
    top = F.greatest(F.max("latency_us").over(Window.partitionBy(user)), F.lit(BAND_FLOOR))
    share = F.col("latency_us") / F.col("_top") * 100
    return (
        ring.withColumn("_top", top)
        .withColumn(
            "band",
            F.when(F.col("latency_us") > F.col("_top") * RED_SHARE, "red")
            .when(F.col("latency_us") > F.col("_top") * AMBER_SHARE, "amber")
            .otherwise("blue"),
        )
        .withColumn("height_pct", F.greatest(F.least(share, F.lit(100.0)), F.lit(LOWEST_HEIGHT)))
        .drop("_top")
    )


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of (user_id, value) from Parquet files dropped into a folder."""
    reader = spark.readStream.schema("user_id long, value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Stream of (user_id, value) from a topic keyed by user; needs the Kafka package."""
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return rows.select(
        F.col("key").cast("string").try_cast("long").alias("user_id"), F.col("value").cast("string").alias("value")
    )


def _as_text(kind):
    """``kind`` with every plain value as text, as JSON messages are read."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _as_text(f.dataType), True) for f in kind.fields])
    return ArrayType(_as_text(kind.elementType)) if isinstance(kind, ArrayType) else StringType()


def _typed(value: Column, kind) -> Column:
    """A value read as text in its own type; what the type cannot hold is null."""
    if isinstance(kind, StructType):
        fields = [_typed(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _typed(x, kind.elementType))
    return value if isinstance(kind, StringType) else value.try_cast(kind)


def _lost(value: Column, kind) -> Column:
    """How many plain values in ``value``, read as text, their types cannot hold."""
    if isinstance(kind, StructType):
        return sum((_lost(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    if isinstance(kind, ArrayType):
        counts = F.aggregate(value, F.lit(0), lambda total, x: total + _lost(x, kind.elementType))
        return F.coalesce(counts, F.lit(0))
    if isinstance(kind, StringType):
        return F.lit(0)
    return (value.isNotNull() & value.try_cast(kind).isNull()).cast("int")


def _is_object() -> Column:
    return F.coalesce(F.ltrim(F.get_json_object("value", "$")).startswith("{"), F.lit(False))


def parse_messages(raw: DataFrame) -> DataFrame:
    """Messages as columns. What is not a JSON object is dropped (see :func:`refused_messages`),
    heartbeats are not forwarded, and a message without a type is a call.

    A field of another type than expected is read if it can be (``"12"`` is a pid)
    and else null; the message stays, and ``mistyped`` counts its lost plain fields,
    those of the events and processes inside it included.
    """
    body = F.from_json("value", _as_text(MESSAGE))
    rows = raw.filter(_is_object()).select("user_id", body.alias("m"))
    typed = {f.name: _typed(F.col(f"m.{f.name}"), f.dataType) for f in MESSAGE.fields}
    typed = rows.select(
        "user_id", *[c.alias(n) for n, c in typed.items()], _lost(F.col("m"), MESSAGE).alias("mistyped")
    ).withColumn("type", F.coalesce("type", F.lit("syscall")))
    return typed.filter(F.col("type") != "heartbeat").withColumn(
        "ts", F.try_to_timestamp("timestamp")
    )


# Message types of the feed.
TYPES = ("syscall", "syscall_batch", "process_snapshot", "agent_info", "agent_offline", "heartbeat")


def refused_messages(raw: DataFrame) -> DataFrame:
    """What of a feed is no message: user_id, value and why it is refused."""
    kind = F.get_json_object("value", "$.type")
    reason = (
        F.when(F.col("value").isNull(), "empty")
        .when(F.get_json_object("value", "$").isNull(), "not json")
        .when(~_is_object(), "not an object")
        .when(~F.coalesce(kind, F.lit("syscall")).isin(*TYPES), "unknown type")
    )
    return raw.select("user_id", "value", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _value_time() -> Column:
    """The time of a message as text: its own, else that of its last event."""
    times = F.from_json(F.get_json_object("value", "$.events"), "array<struct<timestamp: string>>")
    inner = F.array_max(F.transform(times, lambda e: F.try_to_timestamp(e["timestamp"])))
    return F.coalesce(F.try_to_timestamp(F.get_json_object("value", "$.timestamp")), inner)


def once(raw: DataFrame, within: str = "1 hour", by: tuple[str, ...] = ("user_id", "value")) -> DataFrame:
    """A feed that may send a message again, each message once.

    A message is known again by ``by`` (its text; an id, if the feed has one) as long as
    no message more than ``within`` later than it has been seen: the state of older ones is
    dropped. What has no time cannot expire and passes as it is; static rows are
    compared without a bound.
    """
    timed = raw.withColumn("_sent", _value_time())
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in by]), 256)
    known = timed.filter(F.col("_sent").isNotNull()).withColumn("_digest", digest)
    if raw.isStreaming:
        first = known.withWatermark("_sent", within).dropDuplicatesWithinWatermark(["_digest"])
    else:
        first = known.dropDuplicates(["_digest"])
    return first.drop("_sent", "_digest").unionByName(timed.filter(F.col("_sent").isNull()).drop("_sent"))


def unpack_events(messages: DataFrame) -> DataFrame:
    """One row per call event of single and batch messages."""
    names = [f.name for f in EVENT.fields]
    single = F.array(F.struct(*names))
    events = F.when(F.col("type") == "syscall_batch", F.col("events")).when(F.col("type") == "syscall", single)
    return (
        messages.select("user_id", F.explode(events).alias("e"))
        .select("user_id", "e.*")
        .withColumn("ts", F.try_to_timestamp("timestamp"))
    )


def live_counters(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Events, slow and redundant events per user."""
    return events.groupBy(user).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_high_latency").alias("high_latency"),
        F.count_if("is_redundant").alias("redundant"),
    )


def batch_ticks(events: DataFrame, size: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """Events and slow events per user and tick. Streams pass ``late``, the time
    a tick stays open; static rows need none."""
    timed = events if late is None else events.withWatermark("ts", late)
    return (
        timed.groupBy("user_id", F.window("ts", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if("is_high_latency").alias("high_latency"))
        .select("user_id", F.col("w.start").alias("tick"), "events", "high_latency")
    )


def agent_presence(messages: DataFrame) -> DataFrame:
    """Per user: online or offline, platform and when last heard of."""
    known = F.when(F.col("platform") != "unknown", F.col("platform"))
    return messages.groupBy("user_id").agg(
        F.max_by(
            F.when(F.col("type") == "agent_offline", "offline").otherwise("online"), F.col("ts")
        ).alias("status"),
        F.max_by(known, F.when(known.isNotNull(), F.col("ts"))).alias("platform"),
        F.max("ts").alias("last_seen"),
    )


def latest_snapshots(messages: DataFrame) -> DataFrame:
    """The newest process list of every host, still as an array."""
    return (
        messages.filter(F.col("type") == "process_snapshot")
        .groupBy("user_id", "hostname")
        .agg(
            F.max_by("processes", "ts").alias("processes"),
            F.max("ts").alias("ts"),
        )
        .withColumn("count", F.size("processes"))
    )


def snapshot_processes(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("user_id", "hostname", "ts", F.explode("processes").alias("p")).select(
        "user_id", "hostname", "ts", "p.*"
    )

