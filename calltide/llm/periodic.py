"""Periodic runs of words: stretches that repeat a pattern four times or more.

A run of period q holds a place of the grid 0, 3q, 6q, ... whose word returns q words
later, so those pairs are all that is tried: the grids of all periods form a harmonic
sum. How far the words of a pair agree, forwards and backwards, is a longest common
extension (LCE). It is answered from a difference cover: every pair of places, moved
on by the same few words, falls on two covered places. Only suffixes at covered
places are sorted; a sparse table of the common prefixes of neighbours in that order
gives the rest of an extension as one range minimum.

Every text is a row of its own and nothing is shuffled; the work on a batch is numpy
over all its texts at once. Words are compared by 64-bit hashes. Edge cases: null and
empty texts have no words and no runs; repeated rows give repeated results; a null
key is handed to ``order`` as null; other columns pass through, those with the names
of added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.llm.common import chunks, mix, runs_of, word_hashes

LEAST_WORDS, LEAST_TIMES = 6, 4

# A perfect difference cover: every remainder of two places' distance is the
# difference of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
_PAIRS = 1 << 20  # pairs tried at once
_BATCH = 4 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _shifts() -> np.ndarray:
    """By the remainders of two places: the least step that brings both onto the cover."""
    covered = np.zeros(MODULUS, bool)
    covered[list(COVER)] = True
    a, b, step = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(covered[(a + step) % MODULUS] & covered[(b + step) % MODULUS], axis=2)


SHIFT = _shifts()


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64) + 1


class CoverLce:
    """Longest common extensions of a sequence whose texts end in words of their own."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, mix(np.arange(n + 1, n + 1 + 2 * MODULUS, dtype=np.uint64))])
        classes = [np.arange(r, n, MODULUS) for r in COVER]
        places = np.concatenate(classes)
        ends = np.cumsum([len(c) for c in classes])
        # The sequence of blocks of MODULUS words, one class of the cover after the
        # other; the block of the last place of a class reaches beyond the texts and is
        # unlike all others, so no common prefix goes over from class to class.
        block = np.zeros(len(places), np.uint64)
        for t in range(MODULUS):
            block = mix(block * np.uint64(0x9E3779B97F4A7C15) + self.words[places + t])
        block[ends - 1] = mix(block[ends - 1] ^ np.arange(1, len(ends) + 1, dtype=np.uint64))
        levels = [_dense(block)]
        span = 1
        while len(places) and levels[-1].max() < len(places):  # prefix doubling over blocks
            now = levels[-1]
            then = np.zeros(len(now), np.int64)
            then[:-span] = now[span:]
            levels.append(_dense(now * (len(now) + 1) + then))
            span *= 2
        rank = levels[-1] - 1 if len(places) else np.zeros(0, np.int64)
        order = np.empty(len(places), np.int64)
        order[rank] = np.arange(len(places))
        self.rank = np.zeros(n, np.int64)
        self.rank[places] = rank
        # Common prefixes of neighbours, in blocks, from the coarse levels to the fine.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < len(places)) & (b < len(places))
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            step = same * (1 << k)
            a, b, common = a + step, b + step, common + step.astype(np.int32)
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on, at most ``limit``."""
        return agree(self.words, a, b, limit)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions of different places."""
        shift = SHIFT[a % MODULUS, b % MODULUS]
        out = self._agree(a, b, shift)
        on = np.flatnonzero(out == shift)
        left, right = a[on] + shift[on], b[on] + shift[on]
        inside = (left < len(self.rank)) & (right < len(self.rank))
        on, left, right = on[inside], left[inside], right[inside]
        low, high = self.rank[left], self.rank[right]
        low, high = np.minimum(low, high), np.maximum(low, high)
        level = np.frexp(high - low)[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            which = np.flatnonzero(level == k)
            row = self.table[k]
            blocks[which] = np.minimum(row[low[which]], row[high[which] - (1 << k)])
        out[on] += blocks * MODULUS
        rest = self._agree(left + blocks * MODULUS, right + blocks * MODULUS, np.full(len(on), MODULUS))
        out[on] += rest
        return out


def agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on, one by one, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    last, t = len(words) - 1, 0
    while len(live):
        x, y = a[live] + t, b[live] + t
        live = live[(np.maximum(x, y) <= last) & (words[np.minimum(x, last)] == words[np.minimum(y, last)])]
        t += 1
        out[live] = t
        live = live[limit[live] > t]
    return out


def _grids(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of all grids of texts that start at ``first``, in bounded parts."""
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    # A run of length l holds l - q pairs of distance q after each other; one lies on the grid.
    step = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - period
    count = (sizes[text] - period + step - 1) // step
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + _PAIRS, side="right")))
        n = count[at:stop]
        which = np.repeat(np.arange(at, stop), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield first[text[which]] + place * step[which], period[which]
        at = stop


def find_runs(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in ``words``), lengths and periods of the runs of all texts, by start and period.

    ``words`` holds a word of its own before, between and after the texts.
    """
    left, right = [], []
    for place, period in _grids(first, sizes):
        same = words[place] == words[place + period]
        left.append(place[same])
        right.append(place[same] + period[same])
    a = np.concatenate([np.zeros(0, np.int64), *left])
    b = np.concatenate([np.zeros(0, np.int64), *right])
    period = b - a
    # Few words settle most pairs; only texts with a pair that agrees over as many words
    # as it must, or over a whole modulus, get a cover.
    need = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - period
    backwards = words[::-1]
    last = len(words) - 1
    limit = np.minimum(need, MODULUS)
    near = agree(words, a, b, limit)
    open_ = np.flatnonzero(near < limit)
    back = agree(backwards, last - a[open_] + 1, last - b[open_] + 1, limit[open_])
    near[open_] = np.minimum(near[open_] + back, limit[open_])
    hold = near >= limit
    a, b, period = a[hold], b[hold], period[hold]
    if not len(a):
        return a, a, a
    text = np.searchsorted(first, a, side="right") - 1
    chosen = np.unique(text)
    # The chosen texts, each between two words of its own.
    kept = sizes[chosen] + 1
    moved = np.cumsum(kept) - kept + 1
    parts = np.concatenate([[first[chosen[0]] - 1], *(np.arange(first[t], first[t] + sizes[t] + 1) for t in chosen)])
    part = words[parts]
    to = moved[np.searchsorted(chosen, text)] - first[text]
    forward, backward = CoverLce(part), CoverLce(part[::-1])
    end = len(part)
    ahead = forward.of(a + to, b + to)
    behind = backward.of(end - (a + to), end - (b + to))
    start, length = a - behind, behind + ahead + period
    run = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start, length, period = start[run], length[run], period[run]
    # A stretch with two periods has their common divisor too: the smallest one is its period.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
_ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Order = Callable[[object, int], np.ndarray | None]


def _words(texts: list[bytes], keys: list, order: Order | None):
    """Hashed words of all texts between words of their own, first places, sizes and orders."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    starts, stops = runs_of(_IS_WORD[data])
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(starts, bounds)
    hashes = word_hashes(data, starts, stops)
    sizes = np.diff(cuts)
    orders = [order(k, int(n)) if order and n else None for k, n in zip(keys, sizes)]
    for k, one in enumerate(orders):
        if one is not None:
            hashes[cuts[k] : cuts[k + 1]] = hashes[cuts[k] : cuts[k + 1]][one]
    first = cuts[:-1] + np.arange(1, len(texts) + 1)
    out = np.empty(len(hashes) + len(texts) + 1, np.uint64)
    own = np.ones(len(out), bool)
    own[np.arange(len(hashes)) + np.repeat(np.arange(1, len(texts) + 1), sizes)] = False
    out[~own] = hashes
    out[own] = mix(np.arange(1, len(texts) + 2, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return out, first, sizes, orders


def mark_runs(docs: DataFrame, text: str = "text", key: str | None = None, order: Order | None = None) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (start, length, period in words, by
    start and period) and ``collapsed``: the words, joined by single blanks, of which no run holds
    any after its first period.

    ``order(key, n)`` may give the places from which the n words of a text are read.
    """
    added = T.StructType.fromDDL(_ADDED)
    fields = [f for f in docs.schema.fields if f.name not in added.names and f.name != text]
    schema = T.StructType(fields + added.fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text, _BATCH)):
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            keys = batch.column(key).to_pylist() if key else [None] * len(texts)
            words, first, sizes, orders = _words(texts, keys, order)
            start, length, period = find_runs(words, first, sizes)
            cuts = np.searchsorted(start, np.append(first, len(words)))
            runs, collapsed = [], []
            for k, whole_text in enumerate(texts):
                mine = slice(cuts[k], cuts[k + 1])
                own = [start[mine] - first[k], length[mine], period[mine]]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(*(x.tolist() for x in own))])
                held = whole_text.split()
                if orders[k] is not None or len(own[0]):
                    places = orders[k] if orders[k] is not None else np.arange(len(held))
                    edges = np.zeros(len(held) + 1, np.int64)
                    np.add.at(edges, own[0] + own[2], 1)
                    np.add.at(edges, own[0] + own[1], -1)
                    held = [held[i] for i in places[np.cumsum(edges[:-1]) == 0].tolist()]
                collapsed.append(b" ".join(held))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in fields),
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, _ARROW_RUNS),
                    pa.array(collapsed, pa.binary()),
                ],
                names=schema.names,
            )

    return docs.select(*(f"`{f.name}`" for f in fields), f"`{text}`").mapInArrow(run, schema)


def strongest(runs: str) -> Column:
    """The run that repeats most often (exactly length / period); ties: smallest start, then period."""
    times = lambda a, b: a["length"] * b["period"]
    # Runs come by start and period, so an earlier one stays unless a later one is truly stronger.
    better = lambda best, run: F.when(best.isNull() | (times(run, best) > times(best, run)), run).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, better)
