"""Raw trace text as a table of lines, in order and in bounded pieces.

A line is (trace_id, block, part, line_seq, value). ``block`` is the byte
offset of the input split the line came from and ``part`` counts runs of
``span`` lines inside it, so no piece of a trace grows with the trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.chunks import DEFAULT_SPAN, Layout, with_running

LINES = Layout(("trace_id",), ("block", "part"), ("line_seq",))


def read_lines(spark: SparkSession, paths: str | list[str], span: int = DEFAULT_SPAN) -> DataFrame:
    """Lines of trace files, folders or globs; each file is one trace.

    Lines end at line feeds; a carriage return before one belongs to the blanks around the
    line. Bytes that are not UTF-8 become replacement characters; ``n_bytes`` counts those of
    the line as they stand in the (decompressed) file, its end included. A missing path is
    an error. Large plain files are split over tasks; the row number inside a
    scan task rises with the line, which with the split's offset gives file order.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("trace_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_seq"),
        (F.octet_length("value") + 1).cast("long").alias("n_bytes"),
        F.make_valid_utf8("value").alias("value"),
    )
    return lines.withColumn("part", F.expr(f"line_seq div {int(span)}"))


def with_places(lines: DataFrame) -> DataFrame:
    """Lines of :func:`read_lines` with stable places: ``byte_at``, where the line starts in its
    file, and ``line_no``, its number from 1.

    They do not depend on how the files are split, so a place found in one pass over the files
    finds the line in any other. Running sums inside chunks are carried over by one row
    per chunk; a file of any size is spread over tasks. The lines must be a written table
    (``materialise``), as every scan numbers its splits anew.
    """
    upto = with_running(lines, LINES, {"_end": F.col("n_bytes"), "line_no": F.lit(1).cast("long")})
    return upto.withColumn("byte_at", F.col("_end") - F.col("n_bytes")).drop("_end", "n_bytes")


def text_lines(
    texts: DataFrame, trace_id: Column, text: Column, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Lines of texts held in rows (pasted traces): one trace per row."""
    return (
        texts.select(trace_id.alias("trace_id"), F.posexplode(F.split(text, "\n")))
        .select(
            "trace_id",
            F.lit(0).cast("long").alias("block"),
            F.col("pos").cast("long").alias("line_seq"),
            F.col("col").alias("value"),
        )
        .withColumn("part", F.expr(f"line_seq div {int(span)}"))
    )


def numbered_lines(
    rows: DataFrame, trace_id: Column, number: Column, value: Column, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Lines that already sit in a table with a number that is unique per trace.

    Parse statistics count lines by that number, so there it must be consecutive.
    """
    return rows.select(
        trace_id.alias("trace_id"),
        F.lit(0).cast("long").alias("block"),
        number.cast("long").alias("line_seq"),
        value.alias("value"),
    ).withColumn("part", F.expr(f"line_seq div {int(span)}"))
