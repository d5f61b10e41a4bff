"""Shared helpers of the training-data operators: tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.session import materialise

# What the worker process keeps for its next task: one thing of one operator.
_HELD: dict = {}


def held(key, make):
    """What ``make`` gives, kept by the worker under ``key`` until another key is asked for.

    Workers are reused by later stages; one thing at a time bounds what they keep.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what the worker keeps; for tasks that need none of it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that the worker does not use goes back to the system."""
    pa.default_memory_pool().release_unused()
    # What small objects leave free goes too, where the C library can.
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, in a worker that keeps nothing before and no free memory after it.

    Workers wait for their next task beside those at work, in the same memory.
    """

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


# Output batches are cut at about this size, so that long texts never pile up.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; a null text counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def packed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after each other, and the offsets of the texts."""
    array = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Bits of a filter of fixed size that is broadcast, 64 to a row.
_BITS = 1 << 22


def among(docs: DataFrame, key: str, rows: DataFrame, wanted: bool = True) -> DataFrame:
    """Rows of ``docs`` whose ``key`` may be the first column of ``rows`` or, for the others, is not.

    Keys meet as bits of a bitmap that is joined by broadcast: ``docs`` is not moved, nor
    do its texts go through Python.
    """
    bit = lambda column: F.pmod(F.xxhash64(column), F.lit(_BITS))
    at = rows.select(bit(rows.columns[0]).alias("_bit")).distinct()
    held = F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("_bits")
    words = materialise(at.groupBy(F.expr("_bit div 64").alias("_word")).agg(held), "bitmap")
    same = F.col(key).cast(rows.dtypes[0][1])  # equal numbers of other types have other hashes
    marked = docs.withColumn("_bit", bit(same)).withColumn("_word", F.expr("_bit div 64"))
    marked = marked.join(F.broadcast(words), "_word", "left")
    is_set = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_bit % 64 AS int)) & 1L = 1"), F.lit(False))
    return marked.where(is_set if wanted else ~is_set).drop("_bit", "_bits", "_word")


def crc_mod3(column: str = "doc_id"):
    """Remainder by three of the crc32 of an id written as text; null has none."""
    return F.crc32(F.col(column).cast("string")) % 3


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size`` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


# An odd multiplier and its inverse: spans are hashed from sums over prefixes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Spans:
    """64-bit hashes of byte spans of ``data``, in constant time for each span."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:n], out=self.sums[1:])
        powers[1:] = _INVERSE
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.shift = powers

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.shift[starts])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return edges[::2], edges[1::2]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows (doc_id, text, label), half of them of each class
    as far as there are as many; rows held out (crc32 of the id, mod 3, is 1) stay out.

    Ids come by hash order from the labels alone, so the choice is the same in every
    run; only those ids, a bounded set, are broadcast to find the texts.
    """
    known = labels.where((crc_mod3() != 1) & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    halves = [
        known.where(f"label = {value}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for value in (0, 1)
    ]
    ids = halves[0].unionByName(halves[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


_LONG_WORD = 1 << 16


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words at ``starts`` to ``stops``, in steps of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(stops, base + step, side="right")))
        if stops[a] - base > _LONG_WORD:
            b = a + 1
            plain = hashlib.blake2b(data[base : stops[a]].tobytes(), digest_size=8).digest()
            out[a] = int.from_bytes(plain, "little")
        else:
            long = np.flatnonzero(stops[a:b] - starts[a:b] > _LONG_WORD)
            b = a + int(long[0]) if len(long) else b
            part = Spans(data[base : stops[b - 1]])
            out[a:b] = part.of(starts[a:b] - base, stops[a:b] - base)
        a = b
    return out


def words_of(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, the text of each, and each text's first word.

    ``is_word`` tells of each byte value whether words hold it.
    """
    mask = is_word[data]
    starts, stops = runs_of(mask)
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cuts = cuts[mask[cuts] & mask[cuts - 1]]  # words never cross texts
    starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return word_hashes(data, starts, stops), text, first


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the smallest node in reach.

    Labels fall to the least among the neighbours, then labels take the label of
    their label; long chains end after a number of rounds logarithmic in their
    length. Every round is a written table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).withColumnRenamed("a", "node")
    labels = materialise(labels, "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("l").alias("near"))
        best = both.join(of, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(best, "node").select("node", "l", F.least("l", "near").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("l").alias("up"))
        new = lower.join(up, "m").select("node", "l", F.least("m", "up").alias("n"))
        new = materialise(new, "labels")
        changed = new.where("n < l").limit(1).count()
        labels = new.select("node", F.col("n").alias("l"))
        if not changed:
            return labels.select("node", F.col("l").alias("component"))
