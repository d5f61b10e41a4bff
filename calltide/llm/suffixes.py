"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier is
found. Most text cannot repeat, so it is set aside first, without losing a match:
each window of LENGTH bytes has an anchor, its smallest hashed k-gram, and equal
windows have equal anchors. Consecutive windows of the same anchor make a fragment;
anchors met once are dropped, equal fragments are settled by their first one. What
is left are first fragments that share an anchor but differ.

These go to shards by anchor. Each run of fragments of a shard gets a suffix array
and its Burrows-Wheeler transform; the transforms are then merged by iterative
interleave refinement: rows start in one block, and each step sorts them, stably, by
the character before, which orders them by one character more. A block that is down
to one row holds no repeat and is left out of later steps. After LENGTH steps the
blocks are the intervals of common prefix LENGTH or more; in each, all rows but the
one of the earliest place are repeats. Fragments of an anchor that has very many
different ones are cut into single windows and spread by the hash of the window.

Edge cases: null and empty texts have no bytes; rows that share an id (or have none)
are documents of their own, in the order of id, nulls first, then of a hash of the
text; a text may be of any length; other columns pass through ``remove`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.llm.common import Spans, among, chunks, lean, mix, packed, runs_of
from calltide.operators.chunks import rank_rows
from calltide.session import materialise

LENGTH = 100
GRAM = 48
CHUNK = 2 << 20
RUN_BYTES = 512 << 10
HOT_FRAGMENTS = 4096
_PART_BYTES, _SHARD_BYTES = 64 << 20, 2 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Fragments of the texts: anchor, hash, start in ``data`` and number of windows.

    ``data`` has at most 2**24 bytes.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    spans = Spans(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    grams = spans.of(at, at + gram)
    key = grams & ~np.uint64(0xFFFFFF) | at.astype(np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
    place = (key & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window's anchor
    fits = np.zeros(len(place) + 1, np.int32)
    sizes = np.diff(offsets)
    some = sizes >= length
    np.add.at(fits, offsets[:-1][some], 1)
    np.add.at(fits, offsets[1:][some] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (place[window[1:]] != place[window[:-1]]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(window)))
    start = window[first]
    return grams[place[start]], spans.of(start, start + count + length - 1), start, count


def _pieces(batch: pa.RecordBatch, length: int):
    """(data, offsets, rows, start of each text in its document), at most a chunk each."""
    data, offsets = packed(batch, "text")
    rows = batch.column("_row").to_numpy()
    if len(data) <= 2 * CHUNK:
        yield data, offsets, rows, np.zeros(len(rows), np.int64)
        return
    for k in range(len(rows)):
        a, end = int(offsets[k]), int(offsets[k + 1])
        while a < end:
            b = min(end, a + CHUNK + length - 1)
            yield data[a:b], np.array([0, b - a]), rows[k : k + 1], np.array([a - int(offsets[k])])
            a += CHUNK


def _entries(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Fragments as blobs by range of anchors; of equal ones in a chunk only the first
    is an entry, the others are repeats at once (``r...``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", CHUNK)):
            for data, offsets, rows, base in _pieces(batch, length):
                anchor, hashed, start, count = anchors(data, offsets, length, gram)
                if not len(anchor):
                    continue
                text = np.searchsorted(offsets, start, side="right") - 1
                row, start = rows[text], start - offsets[text] + base[text]
                by = np.lexsort((start, row, hashed, anchor))
                anchor, hashed, row, start, count = (x[by] for x in (anchor, hashed, row, start, count))
                first = np.ones(len(anchor), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (hashed[1:] != hashed[:-1])
                part = (mix(anchor) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                for block in np.array_split(some, max(1, len(some) // 64)):
                    pick = [order[cut[p] : cut[p + 1]] for p in block]
                    kept = [x[first[x]] for x in pick]
                    again = [x[~first[x]] for x in pick]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(block, pa.int64()),
                            "anchor": [anchor[x].tobytes() for x in kept],
                            "hash": [hashed[x].tobytes() for x in kept],
                            "row": [row[x].tobytes() for x in kept],
                            "start": [start[x].tobytes() for x in kept],
                            "n": [count[x].astype(np.uint8).tobytes() for x in kept],
                            "r_row": [row[x].tobytes() for x in again],
                            "r_start": [start[x].tobytes() for x in again],
                            "r_n": [count[x].astype(np.uint8).tobytes() for x in again],
                            "r_anchor": [anchor[x].tobytes() for x in again],
                        }
                    )

    kinds = "anchor hash row start n r_row r_start r_n r_anchor".split()
    return docs.select("_row", "text").mapInArrow(lean(run), ", ".join(["part long", *(f"{x} binary" for x in kinds)]))


def _sift(entries: DataFrame) -> DataFrame:
    """Repeats (row, start, n), and the first fragments that are still open (open true),
    with their anchor and whether it has very many different fragments."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind=np.int64: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        anchor, hashed, row, start = read("anchor", np.uint64), read("hash", np.uint64), read("row"), read("start")
        count = read("n", np.uint8)
        by = np.lexsort((start, row, hashed, anchor))
        anchor, hashed, row, start, count = (x[by] for x in (anchor, hashed, row, start, count))
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        first = fresh.copy()
        first[1:] |= hashed[1:] != hashed[:-1]
        begin = np.flatnonzero(fresh)
        different = np.add.reduceat(first.astype(np.int64), begin) if len(begin) else begin
        different = np.repeat(different, np.diff(np.append(begin, len(anchor))))
        open_ = first & (different > 1)
        again = ~first
        extra = read("r_row"), read("r_start"), read("r_n", np.uint8)
        n, m, k = int(again.sum()), len(extra[0]), int(open_.sum())
        return pa.table(
            {
                "row": np.concatenate([row[again], extra[0], row[open_]]),
                "start": np.concatenate([start[again], extra[1], start[open_]]),
                "n": np.concatenate([count[again], extra[2], count[open_]]).astype(np.int64),
                "open": np.repeat([False, True], [n + m, k]),
                "anchor": np.concatenate([np.zeros(n + m, np.int64), anchor[open_].view(np.int64)]),
                "hot": np.concatenate([np.zeros(n + m, bool), different[open_] > HOT_FRAGMENTS]),
            }
        )

    return entries.groupBy("part").applyInArrow(
        run, "row long, start long, n long, open boolean, anchor long, hot boolean"
    )


# --- Suffix arrays, transforms and their merge ------------------------------


class Transform:
    """Burrows-Wheeler transform of a run of strings, each with an end mark, from the
    suffix array of their concatenation, ordered by ``depth`` characters or more."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, depth: int):
        # Characters 1 to 256; 0 ends a string. Strings are numbered in order.
        n = len(data) + len(ends)
        text = np.zeros(n, np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        shift = np.repeat(np.arange(len(ends)), ends - begin)
        text[np.arange(len(data)) + shift] = data.astype(np.int64) + 1
        stop = ends + np.arange(len(ends))
        # Seven characters of nine bits fit one number; from there by prefix doubling.
        key = np.zeros(n, np.int64)
        for k in range(7):
            key <<= 9
            key[: n - k] |= text[k:]
        known = 7
        while True:
            self.order = np.argsort(key)  # the suffix array, in the end
            row = key[self.order]
            fresh = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
            if known >= depth or fresh[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[self.order] = fresh + 1
            key = rank * (n + 2)
            key[: n - known] += rank[known:]
            known *= 2
        self.order = self.order.astype(np.int32)
        before = self.order - 1
        self.last = np.where(before >= 0, text[before], 0).astype(np.int16)
        # Row of the suffix that is longer by the character before.
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.back = place[before]
        self.stop = stop


def merge(transforms: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all transforms that share their first ``length`` characters with another:
    transform, row and block, in merged order."""
    sizes = [len(x.order) for x in transforms]
    base = np.concatenate([[0], np.cumsum(sizes)])
    last = np.concatenate([x.last for x in transforms])
    back = np.concatenate([x.back + np.int32(b) for x, b in zip(transforms, base)])
    row = np.arange(int(base[-1]), dtype=np.int32)
    block = np.zeros(len(row), np.int32)
    for _ in range(length):
        char = last[row]
        live = char > 0  # the mark before a string's first character
        row, block, char = row[live], block[live], char[live]
        by = np.argsort(char, kind="stable")
        row, block, char = back[row[by]], block[by], char[by]
        if not len(row):
            break
        fresh = np.ones(len(row) + 1, bool)
        fresh[1:-1] = (char[1:] != char[:-1]) | (block[1:] != block[:-1])
        repeated = ~(fresh[:-1] & fresh[1:])
        block = np.cumsum(fresh[:-1], dtype=np.int32)[repeated]
        row = row[repeated]
    which = np.searchsorted(base, row, side="right") - 1
    return which, row - base[which], block


def repeated_windows(strings: list[bytes], length: int, run_bytes: int = RUN_BYTES):
    """Windows that occur at least twice in ``strings``: string, start and block number."""
    runs, held, size, first = [], [], 0, 0
    for k, one in enumerate(strings):
        held.append(one)
        size += len(one)
        if size >= run_bytes or k == len(strings) - 1:
            ends = np.cumsum([len(x) for x in held])
            data = np.frombuffer(b"".join(held), np.uint8)
            runs.append((Transform(data, ends, length), ends, first))
            held, size, first = [], 0, k + 1
    if not runs:
        none = np.empty(0, np.int64)
        return none, none, none
    which, row, block = merge([x[0] for x in runs], length)
    string, start = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for k, (transform, ends, first) in enumerate(runs):
        mine = which == k
        at = transform.order[row[mine]].astype(np.int64)
        at -= np.searchsorted(transform.stop, at)  # places without end marks
        of = np.searchsorted(ends, at, side="right")
        string[mine] = of + first
        start[mine] = at - np.concatenate([[0], ends[:-1]])[of]
    return string, start, block


def _fragments(docs: DataFrame, open_: DataFrame, shards: int, length: int) -> DataFrame:
    """Texts of the open fragments (part, row, start, text)."""
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("text", pa.binary())])
        for batch in (part for whole in batches for part in chunks(whole, "text", 1 << 20)):
            out = ([], [], [], [])
            for row, text, cuts in zip(*(batch.column(x).to_pylist() for x in ("_row", "text", "cuts"))):
                data = text.encode()
                for cut in cuts:
                    start, n = cut["start"], cut["n"]
                    if cut["hot"]:
                        one = np.frombuffer(data[start : start + n + length - 1], np.uint8)
                        at = np.arange(n)
                        keys = Spans(one).of(at, at + length)
                        pieces = [(start + k, length) for k in range(n)]
                    else:
                        keys = mix(np.array([cut["anchor"]], np.int64).view(np.uint64))
                        pieces = [(start, n + length - 1)]
                    for key, (a, size) in zip(keys.tolist(), pieces):
                        out[0].append(key % shards)
                        out[1].append(row)
                        out[2].append(a)
                        out[3].append(data[a : a + size])
            for a in range(0, len(out[0]), 16384):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[a : a + 16384], f.type) for x, f in zip(out, schema)], schema=schema
                )

    found = among(docs.select("_row", "text"), "_row", wanted.select("row"))
    joined = found.join(wanted, F.col("_row") == F.col("row")).select("_row", "text", "cuts")
    return joined.mapInArrow(lean(run), "part long, row long, start long, text binary")


def _resolved(fragments: DataFrame, length: int) -> DataFrame:
    """Repeats (row, start, n) among open fragments, shard by shard."""

    def run(table: pa.Table) -> pa.Table:
        row, start = table.column("row").to_numpy(), table.column("start").to_numpy()
        string, at, block = repeated_windows(table.column("text").to_pylist(), length)
        where, place = row[string], start[string] + at
        by = np.lexsort((place, where, block))
        again = np.zeros(len(by), bool)
        again[1:] = block[by[1:]] == block[by[:-1]]  # all but the earliest of a block
        where, place = where[by[again]], place[by[again]]
        by = np.lexsort((place, where))
        where, place = where[by], place[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (where[1:] != where[:-1]) | (place[1:] > place[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(by))[: len(first)] - 1
        return pa.table({"row": where[first], "start": place[first], "n": place[last] - place[first] + 1})

    return fragments.groupBy("part").applyInArrow(run, "row long, start long, n long")


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_row``: the id, or a dense number in order where ids repeat or miss."""
    doubtful = docs.where(F.col(key).isNull()).select(F.lit(1)).limit(1).count() or (
        docs.groupBy(key).count().where("count > 1").limit(1).count()
    )
    if not doubtful:
        return docs.withColumn("_row", F.col(key).cast("long"))
    tied = docs.withColumns({"_all": F.lit(0), "_tie": F.xxhash64("text")})
    ranked = rank_rows(tied, ("_all",), (key, "_tie"), "_place")
    return ranked.drop("_all", "_tie").withColumnRenamed("_place", "_row")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_row``, and the repeats (row, start, n): n windows from start on."""
    spark = docs.sparkSession
    docs = numbered(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, total // _PART_BYTES)
    sifted = materialise(_sift(_entries(docs, parts, length, gram)), "sifted")
    open_ = sifted.where("open")
    size = open_.agg(F.sum(F.col("n") + length)).first()[0] or 0
    closed = sifted.where("NOT open").select("row", "start", "n")
    fragments = _fragments(docs, open_, max(least, size // _SHARD_BYTES), length)
    return docs, materialise(closed.unionByName(_resolved(fragments, length)), "repeats")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that are left) and ``removed``, the
    removed spans of bytes, in order and apart from each other.

    With ``as_text`` these columns become ``text`` as by :func:`texts_left`, in the same pass."""
    docs, found = repeats(docs.drop("kept", "removed", "_row", "_bit", "_bits", "_word", "_cuts", "_cut_row"), length, gram)
    spans = found.groupBy(F.col("row").alias("_cut_row")).agg(F.collect_list(F.struct("start", "n")).alias("_cuts"))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = found.select("row")
    whole = among(docs, "_row", rows, False)
    joined = among(docs, "_row", rows).join(spans, F.col("_row") == F.col("_cut_row"), "left")
    joined = joined.drop("_cut_row").withColumn("kept", data)
    fields = [f for f in joined.schema.fields if f.name not in ("_cuts", "kept")]
    if as_text:
        fields = [f for f in fields if f.name != "text"]
        whole = whole.withColumn("text", F.coalesce("text", F.lit("")))
    else:
        whole = whole.withColumns({"kept": data, "removed": F.array().cast(kind)})
    added = {"text": T.StringType()} if as_text else {"kept": T.BinaryType(), "removed": kind}
    schema = T.StructType([*fields, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in (part for whole in batches for part in chunks(whole, "kept")):
            kept, removed = [], []
            for text, cuts in zip(batch.column("kept").to_pylist(), batch.column("_cuts").to_pylist()):
                if not cuts:
                    kept.append(text)
                    removed.append([])
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                start = np.array([x["start"] for x in cuts])
                stop = start + np.array([x["n"] for x in cuts]) + length - 1
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                removed.append([{"start": a, "stop": b} for a, b in zip(*(x.tolist() for x in runs_of(gone)))])
            new = [pa.array(_texts(kept))] if as_text else [pa.array(kept, pa.binary()), pa.array(removed, arrow)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), *new], names=[*(f.name for f in fields), *added]
            )

    return whole.unionByName(joined.mapInArrow(lean(run), schema)).drop("_row")


def _texts(kept: list[bytes]) -> list[str]:
    return [x.decode("utf-8", "ignore") for x in kept]


def texts_left(removed: DataFrame) -> DataFrame:
    """What ``remove`` gives, with the kept bytes as ``text``; a character of which only
    some bytes were removed goes as a whole."""
    fields = [f for f in removed.schema.fields if f.name not in ("kept", "removed", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "kept")):
            texts = _texts(batch.column("kept").to_pylist())
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts)], names=[*names, "text"])

    return removed.mapInArrow(lean(run), T.StructType([*fields, T.StructField("text", T.StringType())]))
