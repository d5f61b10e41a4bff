"""Registry of checked queries: a Spark query and, where SQL can say it, the
same result in plain SQL over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calltide.catalog import values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Means of decimal data can end exactly half-way between two roundings, where
# engines differ. Both sides round a value moved by this much instead.
NUDGE = 3e-10


def _nudged(sql: str) -> str:
    """``round(x, 6) AS y`` as ``round(x + NUDGE, 6) AS y``."""
    return re.sub(r", 6\)( AS| DESC)", rf" + {NUDGE}, 6)\1", sql)


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _nudged(sql)
        return fn

    return register


def _repeats(depth: int) -> str:
    return " + ".join(
        f"coalesce(CAST(lag(syscall_name, {i}) OVER w = syscall_name AS INT), 0)"
        for i in range(1, depth + 1)
    )


# The chain of views that the checks start from, each built on those before it.
_VIEWS: dict[str, str] = {
    "catalog": f"catalog(name, category, base, risk, is_measured) AS (VALUES {values_sql()})",
    "events_k": (
        "events_k AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
    ),
    "named": """named AS (
      SELECT event_id AS syscall_id, ts, user_id AS pid,
             concat('host-', CAST(user_id % 8 AS VARCHAR)) AS trace_id,
             CASE WHEN k >= 95 THEN 'custom_call'
                  WHEN event_type = 'view' THEN CASE WHEN k < 80 THEN 'read' ELSE 'fsync' END
                  WHEN event_type = 'click' THEN CASE WHEN k < 80 THEN 'write' ELSE 'pwrite64' END
                  WHEN event_type = 'purchase' THEN CASE WHEN k < 80 THEN 'connect' ELSE 'accept4' END
                  WHEN event_type = 'signup' THEN CASE WHEN k < 80 THEN 'execve' ELSE 'openat' END
                  ELSE CASE WHEN k < 80 THEN 'futex' ELSE 'ioctl' END END AS syscall_name,
             CAST(CASE WHEN event_type = 'error' THEN -(k % 22 + 1) ELSE 0 END AS BIGINT) AS return_value,
             CASE user_id % 4 WHEN 0 THEN 'io_heavy' WHEN 1 THEN 'cpu_heavy'
                              WHEN 2 THEN 'network' ELSE 'mixed' END AS process_type,
             CAST(k AS DOUBLE) AS cpu_usage,
             CAST((event_id * 37) % 1000 AS DOUBLE) / 10 AS memory_usage,
             k % 7 AS context_switches, value
      FROM events_k)""",
    "calls": """calls AS (
      SELECT t.*, coalesce(c.category, 'other') AS category,
             coalesce(c.base, 1.0e0) AS base_latency_us, coalesce(c.risk, 2) AS risk_level,
             coalesce(c.base, 1.0e0) * value / 50 AS latency_us
      FROM named t LEFT JOIN catalog c ON c.name = t.syscall_name)""",
    "lagged": f"""lagged AS (
      SELECT *, {_repeats(5)} AS same5, {_repeats(10)} AS same10,
             least(row_number() OVER w - 1, 10) AS n_prev
      FROM calls WINDOW w AS (PARTITION BY trace_id ORDER BY syscall_id))""",
    "labelled": """labelled AS (
      SELECT *, is_high_latency OR is_redundant AS needs_optimization
      FROM (SELECT *, same5 >= 3 AS is_redundant, 2 * same10 > n_prev AS is_redundant_generator,
                   round(CASE WHEN base_latency_us > 0 THEN latency_us / base_latency_us
                         ELSE 1.0e0 END, 3) AS latency_ratio,
                   latency_us > base_latency_us * 3 AS is_high_latency,
                   syscall_id % 5 + 1 AS iteration
            FROM lagged) l)""",
    "spread": """spread AS (
      SELECT avg(ln(greatest(latency_ratio, 0.001e0))) AS m,
             stddev_samp(ln(greatest(latency_ratio, 0.001e0))) AS s FROM labelled)""",
    "scored": """scored AS (
      SELECT *, p_high * 0.4e0 + p_opt * 0.4e0
                + (1.0e0 - least(greatest(anomaly_score + 0.5e0, 0.0e0), 1.0e0)) * 0.2e0 AS priority,
             anomaly_score < 0 AS is_anomaly
      FROM (SELECT l.*, CAST(CAST(is_high_latency AS INT) AS DOUBLE) AS p_high,
                   CAST(CAST(needs_optimization AS INT) AS DOUBLE) AS p_opt,
                   0.3e0 - abs(ln(greatest(latency_ratio, 0.001e0)) - m) / s / 10 AS anomaly_score,
                   CASE WHEN latency_ratio < 0.5 THEN 0 WHEN latency_ratio < 1 THEN 1
                        WHEN latency_ratio < 2 THEN 2 WHEN latency_ratio < 3 THEN 3 ELSE 4 END
                     AS pattern_cluster
            FROM labelled l, spread) x)""",
}


def views(last: str, *more: str) -> str:
    """``WITH`` clause holding the chain up to ``last`` and further views."""
    names = list(_VIEWS)
    chain = [_VIEWS[n] for n in names[: names.index(last) + 1]]
    return "WITH " + ",\n".join([*chain, *more]) + "\n"


HASH01 = "(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296)"


def hash01(seed: str, key: str) -> str:
    return HASH01.format(text=f"concat('{seed}', '|', CAST({key} AS VARCHAR))")
