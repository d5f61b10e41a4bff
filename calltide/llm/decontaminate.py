"""Benchmark decontamination by suffix arrays over the training texts.

The words of a run of documents (a shard, of bounded size) get a suffix array.
Every suffix of every benchmark item is binary-searched in every shard, which
gives its verbatim matches, their places and how far they go on. Only words of
the benchmark can match, so suffixes that do not start a long enough run of them
are left out of the array beforehand; no match is lost by that.

The benchmark, small by nature, is broadcast: whole up to ``BLOCK_BYTES``, beyond
that in blocks of about that size, one pass over the documents for each.

Edge cases: null and empty texts have no words; an item of fewer words than the
window is one window, an item without words is never found; a null item id counts
as the text ``null``; items of the same id count once; an empty table on either
side gives no hits; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.llm import common
from calltide.llm.common import LOWER, chunks, lean, packed, runs_of

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, the text of each, and each text's first word."""
    return common.words_of(LOWER[data], offsets, _IS_WORD)


class Benchmark:
    """Items as runs of word numbers, and all their windows."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW):
        ends = np.cumsum([0, *map(len, texts)])
        hashes, _, first = words_of(np.frombuffer(b"".join(texts), np.uint8), ends)
        self.known = np.unique(hashes)
        self.tokens = (np.searchsorted(self.known, hashes) + 1).astype(np.int32)
        self.ids = ids
        self.first = first
        at, sizes, items = [], [], []
        for k in range(len(ids)):
            words = int(first[k + 1] - first[k])
            if words:
                size = min(window, words)
                at.extend(range(int(first[k]), int(first[k + 1]) - size + 1))
                sizes.extend([size] * (words - size + 1))
                items.extend([k] * (words - size + 1))
        self.at = np.array(at, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.items = np.array(items, np.int64)
        self.least = int(self.sizes.min()) if len(at) else 1
        self.longest = int(np.diff(first).max()) if len(ids) else 0

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1, 0 for words that no item has."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32)


class SuffixArray:
    """Suffixes of ``tokens`` that start a run of at least ``least`` non-zero ones,
    ordered by their first ``depth`` tokens; a 0 ends a run and matches nothing."""

    def __init__(self, tokens: np.ndarray, least: int, depth: int):
        starts, stops = runs_of(tokens > 0)
        long = stops - starts >= least
        starts, stops = starts[long], stops[long]
        sizes = stops - starts
        self.tokens = tokens
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        rank = np.zeros(len(tokens) + depth + 1, np.int64)
        rank[at] = tokens[at]
        known = 1
        while known < depth and len(at):
            # Prefix doubling: the order by 2k tokens from the order by k.
            pair = rank[at] * (int(rank.max()) + 1) + rank[at + known]
            values, rank_of = np.unique(pair, return_inverse=True)
            rank[at] = rank_of + 1
            known *= 2
            if len(values) == len(at):
                break
        self.order = at[np.argsort(rank[at], kind="stable")]
        self.ends = np.zeros(len(tokens) + 1, np.int64)  # where the run of a place ends
        self.ends[at] = np.repeat(stops, sizes)

    def find(self, query: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix ``query[at : at + size]`` the range of suffixes that start with it."""
        low = self._bound(query, at, sizes, False)
        return low, self._bound(query, at, sizes, True)

    def _bound(self, query, at, sizes, after: bool) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        padded = np.concatenate([self.tokens, np.zeros(int(sizes.max(initial=0)) + 1, self.tokens.dtype)])
        for _ in range(len(self.order).bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            place = self.order[middle]
            sign = np.zeros(len(open_), np.int8)  # of suffix against prefix
            for j in range(int(sizes[open_].max())):
                live = (sign == 0) & (j < sizes[open_])
                if not live.any():
                    break
                mine, wanted = padded[place[live] + j], query[at[open_[live]] + j]
                sign[live] = np.sign(mine.astype(np.int64) - wanted)
            less = (sign < 0) | ((sign == 0) & after)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low


def hits(bench: Benchmark, hashes: np.ndarray, text: np.ndarray):
    """Matches of windows in a shard: place, window size, item and the length of the
    whole verbatim match from there."""
    tokens = np.zeros(len(hashes) + (text[-1] + 1 if len(text) else 0), np.int32)
    place = np.arange(len(hashes)) + text  # a 0 between texts
    tokens[place] = bench.number(hashes)
    array = SuffixArray(tokens, bench.least, max(1, int(bench.sizes.max(initial=1))))
    low, high = array.find(bench.tokens, bench.at, bench.sizes)
    found = high - low
    which = np.repeat(np.arange(len(found)), found)
    rank = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(int(found.sum()))
    at = array.order[rank]
    length = bench.sizes[which].copy()
    item_end = bench.first[bench.items[which] + 1]
    go = np.ones(len(at), bool)
    while go.any():  # how far the match goes on beyond the window
        mine, wanted = at + length, bench.at[which] + length
        go = go & (mine < array.ends[at]) & (wanted < item_end)
        go[go] = tokens[mine[go]] == bench.tokens[wanted[go]]
        length[go] += 1
    back = np.searchsorted(place, at)
    return back, bench.sizes[which], bench.items[which], length


def _merged(starts: list[int], stops: list[int]) -> list[dict]:
    spans: list[dict] = []
    for start, stop in sorted(zip(starts, stops)):
        if spans and start <= spans[-1]["stop"]:
            spans[-1]["stop"] = max(spans[-1]["stop"], stop)
        else:
            spans.append({"start": start, "stop": stop})
    return spans


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[bytes]]]:
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        held = part.collect()
        yield [x[0] for x in held], [bytes(x[1]) for x in held]


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (spans of words inside a window that occurs
    in ``benchmark`` (item_id, text)), ``items`` (their ids as text, sorted) and
    ``longest`` (words of the longest verbatim match)."""
    added = {"n_words": T.LongType(), "hits": _SPANS, "items": T.ArrayType(T.StringType()), "longest": T.LongType()}
    fields = [f for f in docs.schema.fields if f.name not in added]
    out = docs.select(*(F.col(f"`{f.name}`") for f in fields))
    schema = T.StructType(fields + [T.StructField(k, v) for k, v in added.items()])
    context = docs.sparkSession.sparkContext
    for number, (ids, texts) in enumerate(_blocks(benchmark, block_bytes)):
        shared = context.broadcast((ids, texts))

        def run(batches, shared=shared, later=number > 0) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value, window)
            for batch in (part for whole in batches for part in chunks(whole, text, SHARD_BYTES)):
                hashes, of, first = words_of(*packed(batch, text))
                back, size, item, length = hits(bench, hashes, of)
                spans, items, longest = ([] for _ in range(batch.num_rows)), {}, {}
                spans = list(spans)
                for at, k, n, most in zip(back.tolist(), item.tolist(), size.tolist(), length.tolist()):
                    row = int(of[at])
                    start = at - int(first[row])
                    spans[row].append((start, start + n))
                    items.setdefault(row, set()).add(bench.ids[k])
                    longest[row] = max(longest.get(row, 0), most)
                if later:  # what earlier blocks have found
                    for row, (old, ids_, most) in enumerate(
                        zip(*(batch.column(x).to_pylist() for x in ("hits", "items", "longest")))
                    ):
                        spans[row].extend((s["start"], s["stop"]) for s in old)
                        items.setdefault(row, set()).update(ids_)
                        longest[row] = max(longest.get(row, 0), most)
                rows = range(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(f.name) for f in fields),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([_merged(*zip(*x)) if x else [] for x in spans], _ARROW_SPANS),
                        pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string())),
                        pa.array([longest.get(r, 0) for r in rows], pa.int64()),
                    ],
                    names=[*(f.name for f in fields), *added],
                )

        out = out.mapInArrow(lean(run), schema)
    return out
