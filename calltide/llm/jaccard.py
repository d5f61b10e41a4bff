"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by lists.

A set is the distinct word shingles of a text. Shingles have one global order,
frequent ones last. Two sets that link share at least c of the first e + c
shingles of each, e being the number that may miss. Light (small) sets put each
subset of c = 2 of these into a table; heavy (large) sets are found by scanning
the inverted lists of these shingles, c up to 8, and must meet in c lists. The
boundary is the size of least estimated cost; sets just above it do both, so that
no pair is lost.

Equal sets are one set from the start. Whether a pair links is checked exactly, in
three rounds, so that a group of thousands of near copies never makes all its pairs:
first each set against the earlier set that shares most lists with it, then against
the nearest one of a list that it is not connected with, and last, list by list, all
pairs that are still not connected. A bitmap of fixed size per set, with the parity of
each class of shingles, finds the nearest and rejects most pairs before whole sets
travel: two bitmaps differ in no more bits than the sets in shingles, so it never
rejects a link.

Edge cases: null and empty texts have empty sets and link with nothing; texts of
fewer words than a shingle are one shingle; rows of the same id are rows of their
own; a null id counts for no component id but gets one; tables may be empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import common
from calltide.llm.common import LOWER, among, chunks, components, lean, mix, packed
from calltide.session import materialise

WORDS = 4
LEAST = (85, 100)  # links have at least 85/100 of the union in common
SUBSET = 2
# Heavy sets are put into this many lists more than could miss a partner, so that
# they meet each partner in as many; a set that meets others in fewer has none.
COMMON = 8
CHUNK = 2 << 20
# Shingles that a chunk of texts repeats so often are counted over all texts, and
# the most frequent ones, a bounded number, come last in the order.
OFTEN, ORDERED = 4, 1 << 16
SKETCH = 1024  # bits
# Before whole sets travel, pairs are held against bitmaps that grow with the sets.
_FINE = 2  # bits for each shingle
_PART_BYTES = 32 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[0x20] = _IS_WORD[0x09:0x0E] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, _, first = common.words_of(LOWER[data], offsets, _IS_WORD)
    grams = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        grams = mix(grams * np.uint64(0x100000001B3) + hashes[k : len(hashes) - words + 1 + k])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(0x100000001B3) + hashes[k])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit name for each set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        return np.array(
            [mix(np.array([mix(x ^ np.uint64(0x5BD1E995)).sum() + np.uint64(len(x))], np.uint64))[0] for x in sets],
            np.uint64,
        ).view(np.int64)


def missing(size: int, least: tuple[int, int] = LEAST) -> int:
    """How many shingles of a set of ``size`` a linked set may lack."""
    return size - -(-size * least[0] // least[1])


def common_lists(size: int) -> int:
    """In how many inverted lists two heavy sets meet at least, the smaller of ``size``."""
    return max(1, min(COMMON, size // 4))


def links(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sets have enough in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def boundary(sizes: dict[int, int], scan: float, least: tuple[int, int] = LEAST) -> int:
    """The largest light size, of least cost: subsets are entries of their own, an
    entry of an inverted list is also compared with ``scan`` others."""
    def cost(most: int) -> float:
        top = most * least[1] // least[0]
        total = 0.0
        for size, count in sizes.items():
            e = missing(size, least)
            if size <= top:
                total += count * math.comb(min(size, e + SUBSET), min(size, SUBSET))
            if size > most:
                total += count * (e + common_lists(size)) * (1 + scan)
        return total

    return min(range(0, 257), key=cost)


def _sketch(x: np.ndarray) -> np.ndarray:
    """Of each of ``SKETCH`` classes whether an odd number of shingles falls into it, as bits."""
    shift = np.uint64(64 - (SKETCH.bit_length() - 1))
    return np.packbits(np.bincount((x >> shift).astype(np.int64), minlength=SKETCH) & 1)


def _fine_sketch(x: np.ndarray) -> np.ndarray:
    """A parity bitmap of at least ``_FINE`` bits for each shingle, a power of two."""
    size = max(SKETCH, 1 << (_FINE * len(x) - 1).bit_length())
    return np.packbits(np.bincount(((x >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1)


def _may_link(a: bytes, b: bytes, size_a: int, size_b: int, least: tuple[int, int]) -> bool:
    """Whether bitmaps of :func:`_fine_sketch` allow a link; the larger is folded to the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (least[1] + least[0]) <= (size_a + size_b) * (least[1] - least[0])


def _read_sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _apart(a: np.ndarray, b: np.ndarray, size_a, size_b, least) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sketches how far they are apart, as a share of both sizes, and
    whether they may be of linked sets: these differ in at most (1 - t) / (1 + t) of
    the sum of their sizes, and their sketches in no more."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    both = size_a + size_b
    return apart / both, apart * (least[1] + least[0]) <= both * (least[1] - least[0])


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """A row for each text (doc_id, n, set_id, sketch) and, with a token, for shingles
    that a chunk repeats (token, count) and for the chunk's repetition (token null)."""
    schema = pa.schema(
        [("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.binary()), ("again", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", CHUNK)):
            sets = shingle_sets(*packed(batch, "text"), words)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(rows, np.int32)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(set_ids(sets)),
                    pa.array([_sketch(x).tobytes() for x in sets], pa.binary()),
                    pa.nulls(rows, pa.float64()),
                ],
                schema=schema,
            )
            token, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= OFTEN
            token, count_often = token[often].view(np.int64), count[often]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(token), np.int32)),
                    pa.nulls(len(token), pa.int64()),
                    pa.array(count_often, pa.int64()),
                    pa.array(token),
                    pa.nulls(len(token), pa.binary()),
                    pa.nulls(len(token), pa.float64()),
                ],
                schema=schema,
            )
            again = float((count.astype(float) ** 2).sum() / max(1, count.sum()) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([2], pa.int32()), *(pa.nulls(1, f.type) for f in list(schema)[1:5]), pa.array([again])],
                schema=schema,
            )

    return docs.select("doc_id", "text").mapInArrow(
        lean(run), "kind int, doc_id long, n long, set_id long, sketch binary, again double"
    )


class _Order:
    """The global order of shingles: by counted frequency, then by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def first(self, x: np.ndarray, count: int) -> np.ndarray:
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
            often = np.where(self.tokens[at] == x, self.counts[at], 0)
        else:
            often = np.zeros(len(x), np.int64)
        return x[np.lexsort((x, often))[:count]]


# Set in the size of an entry under which every linked set is sure to be met: a subset, or one
# of the first e + 1 shingles. The others only raise the number of lists in which sets meet.
_MAIN = np.uint32(1 << 31)


def _keys(x: np.ndarray, order: _Order, light: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is found: subsets for light sets, shingles for heavy; and
    the size of the set for each, with ``_MAIN``."""
    n = len(x)
    e = missing(n, least)
    out = []
    if n <= light * least[1] // least[0]:
        first = order.first(x, e + SUBSET)
        if n < SUBSET:
            out.append(mix(first ^ np.uint64(0xA5A5A5A5)))
        else:
            i, j = np.array(list(combinations(range(len(first)), SUBSET))).T
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            out.append(mix(mix(low) * np.uint64(3) + high))
    main = sum(map(len, out)) + e + 1
    if n > light:
        out.append(order.first(x, e + common_lists(n)))
    keys = np.concatenate(out)
    size = np.full(len(keys), n, np.uint32)
    size[:main] |= _MAIN
    return keys, size


def _entries(docs: DataFrame, words: int, least, order: tuple, light: int, parts: int) -> DataFrame:
    """Key entries of all sets as blobs for each of ``parts`` key ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Order(*shared.value)
        for batch in (part for whole in batches for part in chunks(whole, "text", CHUNK)):
            sets = {int(k): x for x in [s for s in shingle_sets(*packed(batch, "text"), words) if len(s)] for k in set_ids([x])}
            if not sets:
                continue
            keys, sizes = zip(*(_keys(x, frequent, light, least) for x in sets.values()))
            key, size = np.concatenate(keys), np.concatenate(sizes)
            name = np.repeat(np.array(list(sets), np.int64), [len(k) for k in keys])
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            for block in np.array_split(some, max(1, len(some) // 64)):
                pick = [by[cut[p] : cut[p + 1]] for p in block]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(block, pa.int64()),
                        "key": [key[x].tobytes() for x in pick],
                        "name": [name[x].tobytes() for x in pick],
                        "size": [size[x].tobytes() for x in pick],
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "part long, key binary, name binary, size binary")


def _lists(entries: DataFrame) -> DataFrame:
    """The inverted lists with at least two sets: (key, place, name, n), in the order of
    size and name, ``before`` the set before it and the first of the list, and whether it is ``main``."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, name, size = read("key", np.uint64), read("name", np.int64), read("size", np.uint32)
        main, size = size >= _MAIN, size & ~_MAIN
        by = np.lexsort((name, size, key))
        key, name, size, main = key[by], name[by], size[by], main[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        main = np.logical_or.reduceat(main, np.flatnonzero(fresh)) if len(main) else main
        key, name, size = key[fresh], name[fresh], size[fresh]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(key)))
        keep = np.repeat(length, length) > 1
        previous = np.where(start, 0, np.roll(name, 1))
        previous_n = np.where(start, 0, np.roll(size, 1))
        first, first_n = np.repeat(name[begin], length), np.repeat(size[begin], length)
        fields = {
            "key": key.view(np.int64),
            "name": name,
            "n": size.astype(np.int64),
            "head": start,
            "before": previous,
            "before_n": previous_n.astype(np.int64),
            "first": first,
            "first_n": first_n.astype(np.int64),
            "main": main,
        }
        return pa.table({k: v[keep] for k, v in fields.items()})

    return entries.groupBy("part").applyInArrow(
        run, "key long, name long, n long, head boolean, before long, before_n long, first long, first_n long, main boolean"
    )


def _named(survey: DataFrame) -> DataFrame:
    """(name, n, sketch, doc_id) of every set, with the smallest id of its texts."""
    rows = survey.where("kind = 0").groupBy(F.col("set_id").alias("name"))
    return rows.agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))


def _made(docs: DataFrame, wanted: DataFrame, words: int, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(name, doc_id, n, value) of the sets ``wanted`` (name, doc_id) and of few others,
    made again from one text of each and written where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", CHUNK)):
            sets = shingle_sets(*packed(batch, "text"), words)
            yield pa.RecordBatch.from_pydict(
                {
                    "name": set_ids(sets),
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n": pa.array([len(x) for x in sets], pa.int64()),
                    "value": pa.array([value(x).tobytes() for x in sets], pa.binary()),
                }
            )

    some = among(docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id"))
    made = materialise(some.mapInArrow(lean(run), "name long, doc_id long, n long, value binary"), "sets")
    # Copies of a row are one; they are only looked for where ids repeat.
    if made.groupBy("name", "doc_id").count().where("count > 1").limit(1).count():
        made = made.groupBy("name", "doc_id").agg(F.first("n").alias("n"), F.first("value").alias("value"))
    return made


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with size ``n`` and ``value`` of the set on one ``side``; only sets on that side move."""
    of = among(sets, "name", pairs.select(side))
    of = of.select(F.col("name").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("n", "value")], F.col("doc_id").alias("_doc"))
    # A text of the same id but another set is no answer.
    joined = pairs.join(of, (pairs[side] == of[side]) & pairs[f"doc_{side}"].eqNullSafe(of["_doc"]))
    return joined.drop(of[side], of["_doc"])


def _checked(pairs: DataFrame, docs: DataFrame, named: DataFrame, words: int, least) -> DataFrame:
    """Those of ``pairs`` (a, b) that link; only sets whose bitmaps allow it are made and travel whole."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (batch.column(x).to_pylist() for x in ("value_a", "value_b", "n_a", "n_b"))
            fine = pa.array([_may_link(*x, least) for x in zip(*of)], pa.bool_())
            yield batch.filter(fine).select(["a", "b", "doc_a", "doc_b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("value_a").to_pylist(), batch.column("value_b").to_pylist()
            fine = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(a, b)]
            yield batch.filter(pa.array(fine, pa.bool_())).select(["a", "b"])

    left = pairs
    for side in ("a", "b"):
        left = left.join(named.select(F.col("name").alias(side), F.col("doc_id").alias(f"doc_{side}")), side)
    kept = ("a", "b", "doc_a", "doc_b")
    left = materialise(left.select(*kept), "pairs")
    for value, run, columns in ((_fine_sketch, may, kept), (np.asarray, link, ("a", "b"))):
        sides = [left.select(F.col(x).alias("name"), F.col(f"doc_{x}").alias("doc_id")) for x in ("a", "b")]
        sets = _made(docs, sides[0].unionByName(sides[1]).distinct(), words, value)
        both = _with_sets(_with_sets(left, sets, "a"), sets, "b").select(*kept, "n_a", "n_b", "value_a", "value_b")
        schema = ", ".join(f"{x} long" for x in columns)
        # What is left is written, so that its size is known when the next sets are joined.
        left = materialise(both.mapInArrow(lean(run), schema), "pairs")
    return left


def _likely(pairs: DataFrame, named: DataFrame, least) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _read_sketches(batch.column("sa")), _read_sketches(batch.column("sb"))
            _, fine = _apart(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), least)
            yield batch.filter(pa.array(fine)).select(["a", "b"])

    for side in ("a", "b"):
        of = named.select(F.col("name").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        pairs = pairs.join(of, side)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _open_pairs(
    lists: DataFrame, of: DataFrame, named: DataFrame, parts: int, least, nearest: bool = False
) -> DataFrame:
    """Pairs of a list that are not connected yet and whose sizes and sketches allow a
    link: all, or with ``nearest`` for each set only the one of the nearest sketches."""
    labelled = lists.join(of.withColumnRenamed("node", "name"), "name", "left").select(
        "key", "name", "n", F.coalesce("component", "name").alias("component")
    )
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = mixed.where("lo <> hi").select("key")

    def run(table: pa.Table) -> pa.Table:
        key, name, n, component = (table.column(x).to_numpy() for x in ("key", "name", "n", "component"))
        sketch = _read_sketches(table.column("sketch"))
        by = np.lexsort((name, n, key))
        key, name, n, component, sketch = key[by], name[by], n[by], component[by], sketch[by]
        end = np.searchsorted(key, key, side="right")
        far, other, found = np.full(len(key), np.inf), np.zeros(len(key), np.int64), [np.empty((2, 0), np.int64)]
        # Sizes rise within a list: partners of a set are a run after it.
        for step in range(1, int((end - np.arange(len(key))).max(initial=0))):
            a = np.arange(len(key) - step)
            a = a[a + step < end[a]]
            b = a + step
            a, b = (x[(n[b] * least[0] <= n[a] * least[1]) & (component[a] != component[b])] for x in (a, b))
            for c in range(0, len(a), 16384):
                x, y = a[c : c + 16384], b[c : c + 16384]
                apart, fine = _apart(sketch[x], sketch[y], n[x], n[y], least)
                x, y, apart = x[fine], y[fine], apart[fine]
                if not nearest:
                    found.append(np.unique(np.sort(np.stack([name[x], name[y]]), axis=0), axis=1))
                for mine, theirs in ((x, y), (y, x)) if nearest else ():
                    closer = apart < far[mine]  # a place is met once in a step
                    far[mine[closer]], other[mine[closer]] = apart[closer], name[theirs[closer]]
        if nearest:
            some = np.flatnonzero(far < np.inf)
            some = some[np.lexsort((other[some], far[some], name[some]))]
            some = some[np.unique(name[some], return_index=True)[1]]
            return pa.table({"a": name[some], "b": other[some], "apart": far[some]})
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1], "apart": np.zeros(len(pairs[0]))})

    some = labelled.join(mixed, "key").join(named.select("name", "sketch"), "name")
    some = some.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(8 * parts)))
    pairs = some.groupBy("part").applyInArrow(run, "a long, b long, apart double")
    if nearest:
        best = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
        pairs = best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
    return pairs.select("a", "b").distinct()


def join(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, light: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``light`` is the largest light size; by default it is chosen by cost.
    """
    spark = docs.sparkSession
    survey = materialise(_survey(docs, words), "survey")
    named = materialise(_named(survey), "named")
    sizes = {r["n"]: r["c"] for r in survey.where("kind = 0 AND n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}
    if light is None:
        light = boundary(sizes, survey.agg(F.avg("again")).first()[0] or 0.0, least)
    counted = survey.where("kind = 1").groupBy("set_id").agg(F.sum("n").alias("c"))
    often = counted.orderBy(F.desc("c"), "set_id").limit(ORDERED).toArrow()
    order = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    keys = sum(c * (missing(n, least) + COMMON) for n, c in sizes.items())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 20 * keys // _PART_BYTES)

    lists = materialise(_lists(_entries(docs, words, least, order, light, parts)), "lists")
    # Sets with subsets among their keys are kept; others must meet in enough lists.
    smaller = F.expr(f"(n * {least[0]}) div {least[1]}")
    enough = F.greatest(F.lit(1), F.least(F.lit(COMMON), F.expr("_s div 4")))
    met = lists.groupBy("name").agg(F.max("n").alias("n"), F.count("*").alias("_met")).withColumn("_s", smaller)
    kept = met.where((F.col("n") <= light * least[1] // least[0]) | (F.col("_met") >= enough)).select("name")
    kept = materialise(kept, "kept")
    # A few others may stay: they only meet sets in vain.
    lists = materialise(among(lists, "name", kept), "lists")
    fits = lambda x: F.col(f"{x}_n") * least[1] >= F.col("n") * least[0]
    inner = lists.where("NOT head")
    one = inner.where(fits("before")).select("name", F.col("before").alias("other"))
    two = inner.where(fits("first") & (F.col("first") != F.col("before"))).select("name", F.col("first").alias("other"))
    both = one.unionByName(two).join(kept.withColumnRenamed("name", "other"), "other", "left_semi")
    shared = both.groupBy("name", "other").agg(F.count("*").alias("c"))
    most = shared.groupBy("name").agg(F.max(F.struct("c", "other")).alias("best"))
    pairs = most.select(F.least("name", "best.other").alias("a"), F.greatest("name", "best.other").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    found = _checked(_likely(pairs, named, least), docs, named, words, least)

    lists = lists.where("main").select("key", "name", "n")
    near = _open_pairs(lists, components(found), named, parts, least, nearest=True)
    near = materialise(near.join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = found.unionByName(_checked(near, docs, named, words, least))
    pairs = pairs.unionByName(near)

    rest = _open_pairs(lists, components(found), named, parts, least).join(pairs, ["a", "b"], "left_anti")
    more = _checked(rest, docs, named, words, least)
    of = components(found.unionByName(more))

    rows = survey.where("kind = 0").select("doc_id", "n", "set_id")
    least_of = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("own"))
    named = least_of.join(of.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("own").alias("component_id"))
    classes = named.join(smallest, "component").select("set_id", "component_id")
    return rows.join(classes, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
