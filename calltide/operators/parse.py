"""Trace lines to call records, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.chunks import with_running
from calltide.operators.clock import HALF_A_DAY, wall_times
from calltide.operators.label import (
    attach_catalog,
    is_high_latency,
    label,
    latency_ratio,
    needs_optimization,
)
from calltide.schemas import CALL
from calltide.session import materialise
from calltide.sources.traces import LINES

_SEP = "\u0001"
_BLANKS = " \t\r\n\f\u000b"

# Groups: 1 pid, 2 time, 3 name, 4 arguments, 5 return, 6 errno, 7 description,
# 8 duration.
CALL_PATTERN = (
    r"^(?:(\d+)\s+)?(?:(\d{2}:\d{2}:\d{2}\.\d+)\s+)?(\w+)\((.*)\)\s*=\s*"
    r"(-?\d+|\?|0x[0-9a-fA-F]+)(?:\s+([A-Z][A-Z0-9_]*))?"
    r"(?:\s+\(([^\x01]*)\))?(?:\s+<([\d.]+)>)?\s*$"
)
# Expanded summary rows are made in runs of this many calls: neither the runs of
# a row nor the calls of a run make a large array.
_EXPAND_RUN = 1 << 20


def stripped(value: str = "value") -> Column:
    return F.btrim(F.col(value), F.lit(_BLANKS))


def is_noise(value: Column) -> Column:
    """Blank lines, signals, exits and the halves of interrupted calls."""
    start = F.substring(F.btrim(value, F.lit(_BLANKS)), 1, 3)
    return start.isin("", "---", "+++") | value.contains("<unfinished") | value.contains("resumed>")


def _cut(lines: DataFrame, pattern: str, groups: list[int]) -> DataFrame:
    """Keeps lines that match and adds ``_f``, their groups in the given order.

    One run of the pattern per line: the match is rewritten with separators and
    split. Free-text groups come last, so a separator inside them is kept. The
    fields come out of a generator, which keeps filters on them from running
    the pattern again. No line that matches starts with a separator.
    """
    line = stripped()
    rewritten = F.regexp_replace(line, pattern, "".join(f"{_SEP}${g}" for g in groups))
    fields = F.split(rewritten, _SEP, len(groups) + 1)
    return (
        lines.filter((line != "") & ~line.startswith(_SEP))
        .select("*", F.explode(F.array(fields)).alias("_f"))
        .filter(F.col("_f")[0] == "")
    )


def _call_fields(found: Column) -> dict[str, Column]:
    """The raw fields of a call from the groups of a match."""
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    return {
        "pid": F.coalesce(found[1].try_cast("long"), F.lit(0)),
        "ts_text": blank_to_null(found[2]),
        "syscall_name": found[3],
        "args": found[8],
        "return_text": found[4],
        "errno": found[5],
        "errno_desc": found[7],
        "duration_text": blank_to_null(found[6]),
    }


_CALL_GROUPS = [1, 2, 3, 5, 6, 8, 7, 4]


def _is_bad(duration: Column) -> Column:
    return duration.isNotNull() & duration.try_cast("double").isNull()


def match_lines(lines: DataFrame) -> DataFrame:
    """Lines that read as calls, with their raw fields.

    ``is_bad`` marks a line whose duration is not a number: it is reported as a
    parse error and is no call.
    """
    found = _cut(lines.filter(~is_noise(F.col("value"))), CALL_PATTERN, _CALL_GROUPS)
    keep = [c for c in lines.columns if c != "value"]
    fields = [c.alias(name) for name, c in _call_fields(F.col("_f")).items()]
    return found.select(*keep, *fields).withColumn("is_bad", _is_bad(F.col("duration_text")))


def return_code(text: Column) -> Column:
    """Integers as they are; hexadecimal and unknown returns are 0."""
    return F.coalesce(text.try_cast("long"), F.lit(0))


def latency_from(duration: Column, base: Column, unit: str = "s") -> Column:
    """Microseconds; calls without a duration take the base latency."""
    factor = {"s": 1_000_000, "us": 1}[unit]
    return F.coalesce(duration * factor, base)


def parse_calls(lines: DataFrame, duration_unit: str = "s") -> DataFrame:
    """Catalogued calls of call-format lines; line position columns are kept."""
    return _catalogued(match_lines(lines).filter(~F.col("is_bad")).drop("is_bad"), duration_unit)


def _catalogued(matched: DataFrame, duration_unit: str) -> DataFrame:
    duration = F.col("duration_text").cast("double")
    return (
        attach_catalog(matched)
        .withColumn("latency_us", latency_from(duration, F.col("base_latency_us"), duration_unit))
        .withColumn("latency_estimated", F.col("duration_text").isNull())
        .withColumn("return_value", return_code(F.col("return_text")))
        .withColumn("args_summary", F.substring("args", 1, 100))
        .drop("args", "return_text", "duration_text")
    )


def _is_title() -> Column:
    return F.col("value").contains("% time") & F.col("value").contains("usecs/call")


def _is_ruled() -> Column:
    return F.col("value").contains("------")


def summary_traces(lines: DataFrame) -> DataFrame:
    """Ids of the traces in summary format: some line holds both column titles."""
    return lines.filter(_is_title()).select("trace_id").distinct()


def summary_section(lines: DataFrame) -> DataFrame:
    """Lines between an odd and the next ruled line of each summary."""
    ruled = _is_ruled()
    counted = with_running(lines, LINES, {"_rules": ruled.cast("long")})
    return counted.filter(~ruled & (F.col("_rules") % 2 == 1)).drop("_rules")


def summary_rows(lines: DataFrame) -> DataFrame:
    """Table rows of summaries: five fields between blanks, or six with an error
    count before the name. ``is_bad`` marks rows whose numbers cannot be held."""
    words = F.split(stripped(), r"\s+")
    field = lambda i: F.col("_w")[i]
    whole = lambda i: field(i).rlike(r"^[0-9]+$")
    decimal = lambda i: field(i).rlike(r"^[0-9.]+$")
    size, name = F.size("_w"), F.element_at("_w", -1)
    is_row = size.isin(5, 6) & decimal(0) & decimal(1) & whole(2) & whole(3) & name.rlike(r"^\w+$")
    keep = [c for c in lines.columns if c != "value"]
    rows = summary_section(lines).select(*keep, words.alias("_w")).filter(is_row & ((size == 5) | whole(4)))
    read = rows.select(
        *keep,
        field(0).try_cast("double").alias("pct_time"),
        field(1).try_cast("double").alias("seconds"),
        field(2).try_cast("long").alias("usecs_per_call"),
        field(3).try_cast("long").alias("calls"),
        F.when(size == 6, field(4).try_cast("long")).otherwise(F.lit(0)).cast("long").alias("errors"),
        name.alias("syscall_name"),
        F.array_join("_w", " ").alias("_text"),
    )
    unread = [F.col(c).isNull() for c in ("pct_time", "seconds", "usecs_per_call", "calls", "errors")]
    bad = unread[0]
    for one in unread[1:]:
        bad = bad | one
    return read.withColumn("is_bad", bad)


def parse_summary(lines: DataFrame) -> DataFrame:
    """Rows of summary tables whose numbers can be held."""
    return summary_rows(lines).filter(~F.col("is_bad")).drop("is_bad", "_text")


def expand_summary(rows: DataFrame, layout=LINES) -> DataFrame:
    """One call per counted call; the first ``errors`` of a row have failed.

    Counts are unbounded, so a row is first cut into runs, the runs are spread
    over the tasks and only then unrolled.
    """
    numbered = with_running(rows, layout, {"_upto": F.col("calls")})
    runs = (
        numbered.filter(F.col("calls") > 0)
        .withColumn("_first", F.col("_upto") - F.col("calls"))
        .select(
            "trace_id", "syscall_name", "usecs_per_call", "calls", "errors", "_first",
            F.explode(F.expr(f"sequence(0L, (calls - 1) div {_EXPAND_RUN})")).alias("_run"),
        )
        .repartition("trace_id", "_first", "_run")
    )
    last = F.least(F.col("calls"), (F.col("_run") + 1) * _EXPAND_RUN)
    calls = runs.select(
        "trace_id", "syscall_name", "usecs_per_call", "errors", "_first",
        F.explode(F.sequence(F.col("_run") * _EXPAND_RUN + 1, last)).alias("_nth"),
    )
    failed = F.col("_nth") <= F.col("errors")
    return (
        attach_catalog(calls)
        .withColumn("syscall_id", F.col("_first") + F.col("_nth") - 1)
        .withColumn("latency_us", F.col("usecs_per_call").cast("double"))
        .withColumn("latency_ratio", latency_ratio(source="summary"))
        .withColumn("return_value", F.when(failed, -1).otherwise(0).cast("long"))
        .withColumn("errno", F.when(failed, "ERROR").otherwise(""))
        .withColumn("pid", F.lit(0).cast("long"))
        .withColumn("args_summary", F.lit(""))
        .withColumn("is_redundant", F.lit(False))
        .withColumn("is_high_latency", is_high_latency())
        .withColumn("needs_optimization", needs_optimization("summary"))
        .withColumn("source", F.lit("strace_summary"))
        .drop("_first", "_nth", "usecs_per_call", "errors")
    )


def _as_call_records(calls: DataFrame) -> DataFrame:
    """The full call schema; what a trace does not hold (CPU, memory) is null."""
    have = set(calls.columns)
    filled = calls.withColumn("latency_us", F.round("latency_us", 3))
    return filled.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CALL.fields
        ],
        *[c for c in ("errno_desc", "latency_estimated", "ts", "byte_at") if c in have],
    )


# What a line is to a parse. A line of a summary may look like a call or like none.
BLANK, NOISE, GOOD, BAD, OTHER = "blank", "noise", "call", "bad", "other"


def read_statuses(lines: DataFrame) -> DataFrame:
    """Every line with its ``status`` and, of calls, the raw fields: one run of the pattern.

    Of lines that can belong to a summary table the text stays in ``row_text``; the others drop
    theirs. ``is_title`` marks the titles of a summary.
    """
    line = stripped()
    rewritten = F.regexp_replace(line, CALL_PATTERN, "".join(f"{_SEP}${g}" for g in _CALL_GROUPS))
    matched = F.split(rewritten, _SEP, len(_CALL_GROUPS) + 1)
    unread = (line == "") | is_noise(F.col("value")) | line.startswith(_SEP)
    # Out of a generator, so that the columns below do not run the pattern again.
    cut = lines.select("*", F.explode(F.array(F.when(~unread, matched))).alias("_f"))
    is_call = F.coalesce(F.col("_f")[0] == "", F.lit(False))
    fields = {name: F.when(is_call, c) for name, c in _call_fields(F.col("_f")).items()}
    fields["args"] = F.substring(fields["args"], 1, 100)
    status = (
        F.when(line == "", BLANK)
        .when(is_call & _is_bad(fields["duration_text"]), BAD)
        .when(is_call, GOOD)
        .when(is_noise(F.col("value")), NOISE)
        .otherwise(OTHER)
    )
    in_table = _is_ruled() | F.size(F.split(line, r"\s+")).isin(5, 6)
    keep = [c for c in lines.columns if c != "value"]
    return cut.select(
        *keep,
        status.alias("status"),
        _is_title().alias("is_title"),
        *[c.alias(name) for name, c in fields.items()],
        F.when(in_table, F.col("value")).alias("row_text"),
    )


class ParsedTraces:
    """Trace lines parsed once; calls and statistics are read from the same stage.

    With ``stage`` the lines' statuses and fields are written once to the shared folder: the pattern
    runs once per line, and calls and statistics agree on every line, since both read
    what one pass over the files has seen. The list of summary traces is written too: the
    joins then know its true size and broadcast it if small.
    """

    def __init__(self, lines: DataFrame, stage: bool = True):
        keep = materialise if stage else (lambda df, name: df)
        self.lines = keep(read_statuses(lines), "parsed")
        self.summaries = keep(self.lines.filter("is_title").select("trace_id").distinct(), "summaries")

    def _plain(self) -> DataFrame:
        return self.lines.join(self.summaries, "trace_id", "left_anti")

    def _tables(self) -> DataFrame:
        kept = ["trace_id", *LINES.chunk, *LINES.order, F.col("row_text").alias("value")]
        return self.lines.filter("row_text IS NOT NULL").select(*kept).join(self.summaries, "trace_id", "left_semi")

    def calls(self, duration_unit: str = "s", date: str | None = None) -> DataFrame:
        """Labelled call records of any mix of call traces and summaries.

        With ``date``, the day on which the traces begin, calls get ``ts`` from their clock
        text (see :func:`wall_times`; a trace may not pause for half a day); calls without
        one, those of summaries included, have a null.
        """
        found = self._plain().filter(F.col("status") == GOOD).drop("status", "is_title", "row_text")
        calls = label(_catalogued(found, duration_unit), layout=LINES, index="syscall_id")
        if date is not None:
            calls = wall_times(calls, date, LINES, HALF_A_DAY)
        plain = _as_call_records(calls.withColumn("source", F.lit("strace")))
        expanded = expand_summary(parse_summary(self._tables()))
        return plain.unionByName(_as_call_records(expanded), allowMissingColumns=True)

    def stats(self, first_errors: int = 10) -> DataFrame:
        """Parsed and skipped lines and the first errors of every trace.

        Blank lines before the first and after the last line of text do not count.
        Per-piece counts are combined map-side; only error lines are ranked.
        """
        return self._plain_stats(first_errors).unionByName(self._summary_stats(first_errors))

    def _plain_stats(self, first_errors: int) -> DataFrame:
        plain = self._plain()
        text_seq = F.when(F.col("status") != BLANK, F.col("line_seq"))
        pieces = plain.groupBy(*LINES.cell).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("line_seq").alias("_min"),
            F.min(text_seq).alias("_first"),
            F.max(text_seq).alias("_last"),
            F.count_if(F.col("status") == GOOD).alias("_ok"),
            F.count_if(F.col("status") == BAD).alias("_bad"),
        )
        earlier = LINES.across().rowsBetween(Window.unboundedPreceding, -1)
        placed = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumns(
            {
                "_from": F.col("_off") + F.col("_first") - F.col("_min"),
                "_to": F.col("_off") + F.col("_last") - F.col("_min"),
            }
        )
        spans = placed.groupBy("trace_id").agg(
            F.min("_from").alias("_from"),
            F.coalesce(F.max("_to") - F.min("_from") + 1, F.lit(1)).alias("_lines"),
            F.sum("_ok").alias("_ok"),
            F.sum("_bad").alias("_bad"),
        )
        bad = (
            plain.filter(F.col("status") == BAD)
            .join(placed.select(*LINES.cell, "_min", "_off"), LINES.cell)
            .join(spans.select("trace_id", "_from"), "trace_id")
            .withColumn("_no", F.col("line_seq") - F.col("_min") + F.col("_off") - F.col("_from") + 1)
        )
        by_number = Window.partitionBy("trace_id").orderBy("_no")
        message = F.format_string("Line %d: could not convert string to float: '%s'", "_no", "duration_text")
        messages = _first_messages(bad.withColumn("_rank", F.row_number().over(by_number)), message, first_errors)
        return spans.join(messages, "trace_id", "left").select(
            "trace_id",
            F.col("_ok").alias("parsed_lines"),
            (F.col("_lines") - F.col("_ok")).alias("skipped_lines"),
            F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
            F.col("_bad").alias("total_errors"),
        )

    def _summary_stats(self, first_errors: int) -> DataFrame:
        rows = summary_rows(self._tables())
        first = Window.partitionBy("trace_id").orderBy("block", "line_seq")
        listed = _first_messages(
            rows.filter("is_bad").withColumn("_rank", F.row_number().over(first)),
            F.concat(F.lit("could not read summary row: "), F.col("_text")),
            first_errors,
        )
        counted = rows.groupBy("trace_id").agg(
            F.count_if(~F.col("is_bad")).alias("_ok"), F.count_if("is_bad").alias("_bad")
        )
        return self.summaries.join(counted, "trace_id", "left").join(listed, "trace_id", "left").select(
            "trace_id",
            F.coalesce("_ok", F.lit(0)).alias("parsed_lines"),
            F.lit(0).cast("long").alias("skipped_lines"),
            F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
            F.coalesce("_bad", F.lit(0)).alias("total_errors"),
        )


def _first_messages(ranked: DataFrame, message: Column, first_errors: int) -> DataFrame:
    """The texts of the rows with the least ``_rank``, in an array per trace."""
    return (
        ranked.filter(F.col("_rank") <= first_errors)
        .groupBy("trace_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", message.alias("m")))).alias("_errors"))
        .select("trace_id", F.col("_errors.m").alias("errors"))
    )


def parse_lines(lines: DataFrame, stage: bool = True) -> ParsedTraces:
    """Parses trace lines once, for calls as well as for statistics."""
    return ParsedTraces(lines, stage)


def calls_from_lines(
    lines: DataFrame, duration_unit: str = "s", stage: bool = True, date: str | None = None
) -> DataFrame:
    """Labelled call records of any mix of call traces and summaries."""
    return parse_lines(lines, stage).calls(duration_unit, date)


def parse_stats(lines: DataFrame, first_errors: int = 10, stage: bool = True) -> DataFrame:
    """Parsed and skipped lines and the first errors of every trace."""
    return parse_lines(lines, stage).stats(first_errors)
