"""Ranked lexical search by range-maximum tables over posting lists.

Documents lie in shards. A shard numbers its documents by falling weight, and holds for
every query term a posting list with the impact of the term on each document, and over
the impacts a sparse table that tells the place of the largest one of any range. The
search of a query in a shard is best-first over intervals of document numbers: the
range maxima of its terms, summed, bound every score in an interval. The best intervals
are split at the document of their largest impact, which is scored by the way; short
intervals are scored whole. It ends when no bound reaches the k-th best score, so the
result is exact. A task carries the best of its queries from shard to shard.

Statistics are counted over all documents. Queries come in blocks of bounded size; the
result of a block is written before the next one is broadcast.

Edge cases: null and empty texts have no terms: such documents do not count, such
queries have no rows; a query row is a query of its own, whatever its id; null document
ids come after all others among equal scores; repeated documents are ranked each;
an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm.common import LOWER, chunks, packed, words_of
from calltide.session import materialise

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20  # of query text
LEAF = 48  # intervals of so many documents are scored whole
FRONT = 1 << 13  # ranges that are looked at together

_IS_TERM = np.ones(256, bool)
_IS_TERM[:0x30] = _IS_TERM[0x3A:0x41] = _IS_TERM[0x5B:0x61] = _IS_TERM[0x7B:0x80] = False
_LAST = np.iinfo(np.int64).max

# Fixed values of the ranking: saturation in thousandths, length share and the rest in hundredths.
SATURATION, LENGTH_SHARE, WHOLE = 20, 50, 100
PRECISION, WEIGHT_STEPS = 1_000_000_000, 1000


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, the text of each, and each text's first term."""
    return words_of(LOWER[data], offsets, _IS_TERM)


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_STEPS * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of ``n`` terms adds for each unit of weight."""
    m = WHOLE - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total
    return (PRECISION * tf) // (1000 * tf + SATURATION * m)


# --- Index


_PARTS = ["ids", "nulls", "sizes", "terms", "holding", "docs", "tf"]
_INDEX = ", ".join(f"{part} binary" for part in _PARTS) + ", documents long, total long"


def index(docs: DataFrame, known: np.ndarray | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards of ``docs``: ids, sizes, and posting lists of the terms with hashes ``known`` (all, if
    None), sorted by term and document."""
    wanted = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = wanted.value
        for batch in (part for whole in batches for part in chunks(whole, text, SHARD_BYTES)):
            hashes, of, first = terms_of(*packed(batch, text))
            sizes = np.diff(first)
            if vocabulary is not None:
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                hashes, of = hashes[hit], of[hit]
            terms, number = np.unique(hashes, return_inverse=True)
            cells, tf = np.unique(number.astype(np.int64) * batch.num_rows + of, return_counts=True)
            holding = np.bincount(cells // max(batch.num_rows, 1), minlength=len(terms))
            ids = batch.column(key).cast(pa.int64())
            columns = [
                ids.fill_null(0).to_numpy(zero_copy_only=False),
                ids.is_null().to_numpy(zero_copy_only=False),
                sizes.astype(np.int64),
                terms,
                holding.astype(np.int64),
                (cells % max(batch.num_rows, 1)).astype(np.int32),
                tf.astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns),
                    pa.array([int((sizes > 0).sum())], pa.int64()),
                    pa.array([int(sizes.sum())], pa.int64()),
                ],
                names=[*_PARTS, "documents", "total"],
            )

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, _INDEX)


def _holding(shards: DataFrame) -> DataFrame:
    """Documents that hold each term, summed over the shards."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["terms"], np.uint64).view(np.int64)),
                        pa.array(np.frombuffer(row["holding"], np.int64)),
                    ],
                    names=["term", "n"],
                )

    return shards.select("terms", "holding").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


# --- Search in a shard


class Shard:
    """Posting lists of a shard with their impacts and range-maximum tables."""

    def __init__(self, row: dict, weights: dict[int, int], documents: int, total: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        sizes = read("sizes", np.int64)
        holding = read("holding", np.int64)
        terms = read("terms", np.uint64)
        docs = read("docs", np.int32).astype(np.int64)
        w = np.array([weights.get(t, 0) for t in terms.tolist()], np.int64)
        term = np.repeat(np.arange(len(terms)), holding)
        gain = w[term] * impacts(read("tf", np.int64), sizes[docs], documents, total)
        use = gain > 0
        term, docs, gain = term[use], docs[use], gain[use]
        # Numbers by falling sum of impacts: the ends of the order are poor for every query.
        mass = np.zeros(len(sizes), np.int64)
        np.add.at(mass, docs, gain)
        order = np.argsort(-mass, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids = np.where(read("nulls", bool), _LAST, read("ids", np.int64))[order]
        self.nulls = read("nulls", bool)[order]
        self.size = max(len(order), 1)
        self.key = term * self.size + number[docs]  # sorted: lists after each other, each by number
        by = np.argsort(self.key)
        self.key, self.gain = self.key[by], gain[by]
        self.doc = self.key % self.size
        self.term_of = {t: k for k, t in enumerate(terms.tolist())}
        self.starts = np.searchsorted(self.key, np.arange(len(terms) + 1) * self.size)
        longest = int(np.diff(self.starts).max(initial=0))
        # table[k][p]: place of the largest of the 2**k impacts from p on.
        self.table = [np.arange(len(self.gain), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            low, high = last[:-half], last[half:]
            self.table.append(np.where(self.gain[low] >= self.gain[high], low, high))
        # One row for all levels, so that ranges of all lengths are read together.
        self.level_at = np.cumsum([0, *map(len, self.table)])
        self.flat = np.concatenate(self.table)
        self.padded = np.append(self.gain, 0)
        self.sums = np.zeros(self.size, np.int64)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range of places; the end of the shard if it is empty."""
        none = len(self.gain)
        full = high > low
        level = np.where(full, np.frexp(high - low)[1] - 1, 0)
        base = self.level_at[level]
        a = self.flat[np.where(full, base + low, 0)] if none else np.zeros(low.shape, np.int64)
        b = self.flat[np.where(full, base + high - (1 << level), 0)] if none else a
        best = np.where(self.gain[a] >= self.gain[b], a, b) if none else a
        return np.where(full, best, none)

    def search(self, terms: list[int], k: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the documents that can be among the k best.

        ``least`` is the k-th best so far (score, id); lower scores are left out.
        """
        lists = [self.term_of[t] for t in terms if t in self.term_of]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = np.array(lists, np.int64)
        floor = max(least[0], 1)
        low, high = self.starts[lists][None, :], self.starts[lists + 1][None, :]
        first, last = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        place = self.largest(low, high)
        bound = self.padded[place].sum(axis=1)
        numbers, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = max(1, FRONT // len(lists))
        while True:
            live = np.flatnonzero(bound >= floor)
            if not len(live):
                break
            if len(live) > width:  # the best intervals first
                live = live[np.argpartition(-bound[live], width)[:width]]
            rest = np.ones(len(bound), bool)
            rest[live] = False
            rest &= bound >= floor
            mine = low[live], high[live], first[live], last[live], place[live]
            held = low[rest], high[rest], first[rest], last[rest], place[rest], bound[rest]
            short = mine[3] - mine[2] <= LEAF
            got = [self._whole(mine[0][short], mine[1][short])]
            a, b, f, l, at = (x[~short] for x in mine)
            if len(a):
                # Split at the document of the largest impact; its places show its score.
                top = at[np.arange(len(at)), np.argmax(self.padded[at], axis=1)]
                middle = self.doc[top]
                cut = np.searchsorted(self.key, lists[None, :] * self.size + middle[:, None])
                inside = cut < b
                hit = inside & (self.doc[np.where(inside, cut, 0)] == middle[:, None])
                got.append((middle, np.where(hit, self.padded[cut], 0).sum(axis=1)))
                low_ = np.concatenate([a, cut + hit])
                high_ = np.concatenate([cut, b])
                first_, last_ = np.concatenate([f, middle + 1]), np.concatenate([middle, l])
                place_ = self.largest(low_, high_)
                fresh = low_, high_, first_, last_, place_, self.padded[place_].sum(axis=1)
                held = tuple(np.concatenate([x, y]) for x, y in zip(held, fresh))
            low, high, first, last, place, bound = held
            numbers += [x for x, _ in got]
            scores += [y for _, y in got]
            found, value = np.concatenate(numbers), np.concatenate(scores)
            good = value >= floor
            found, value = found[good], value[good]
            if len(value) >= k:
                floor = max(floor, int(np.partition(value, len(value) - k)[len(value) - k]))
                found, value = found[value >= floor], value[value >= floor]
            numbers, scores = [found], [value]
        return numbers[0], scores[0]

    def _whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all documents in the ranges."""
        low, n = low.ravel(), (high - low).ravel()
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        docs = self.doc[at]
        np.add.at(self.sums, docs, self.gain[at])
        docs = np.unique(docs)
        scores = self.sums[docs]
        self.sums[docs] = 0
        return docs, scores


class Best:
    """The k best of every query, over the shards of a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0, np.int64)] * queries
        self.nulls = [np.zeros(0, bool)] * queries

    def least(self, q: int) -> tuple[int, int]:
        full = len(self.ids[q]) == self.k
        return (int(self.scores[q][-1]), int(self.ids[q][-1])) if full else (0, _LAST)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray, nulls: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        nulls = np.concatenate([self.nulls[q], nulls])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q], self.nulls[q] = ids[order], scores[order], nulls[order]


# --- Search in all shards


def _blocks(queries: DataFrame, text: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Query numbers and texts, in blocks of about ``block_bytes``."""
    rows = queries.select("_query", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    total = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("_query"), F.lit(count)) == k)
        yield [(r[0], bytes(r[1])) for r in part.collect()]


def _query_terms(block: list[tuple[int, bytes]]) -> list[np.ndarray]:
    ends = np.cumsum([0, *(len(t) for _, t in block)])
    hashes, _, first = terms_of(np.frombuffer(b"".join(t for _, t in block), np.uint8), ends)
    return [np.unique(hashes[first[k] : first[k + 1]]) for k in range(len(block))]


_FOUND = "_query long, doc_id long, score long, _task int"


def _search_block(docs: DataFrame, block: list[tuple[int, bytes]], k: int, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    terms = _query_terms(block)
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
    shards = materialise(index(docs, known, text, key), "lexical-index")
    documents, total = shards.agg(F.sum("documents"), F.sum("total")).first()
    holding = {r[0]: r[1] for r in _holding(shards).collect()}  # at most the terms of the block
    weights = {}
    for signed, n in holding.items():
        weights[signed & 0xFFFFFFFFFFFFFFFF] = weight(documents, n)
    # Terms without weight add nothing.
    asked = [(q, [t for t in one.tolist() if weights.get(t)]) for (q, _), one in zip(block, terms)]
    shared = spark.sparkContext.broadcast((asked, weights, documents or 0, max(total or 0, 1)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked, weights, documents, total = shared.value
        best = Best(len(asked), k)
        for row in (r for batch in batches for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
            shard = Shard(row, weights, documents, total)
            for q, (_, terms) in enumerate(asked):
                found, scores = shard.search(terms, k, best.least(q))
                if len(found):
                    best.add(q, shard.ids[found], scores, shard.nulls[found])
        task = TaskContext.get().partitionId()
        for q, (number, _) in enumerate(asked):
            n = len(best.ids[q])
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number), pa.int64()),
                        pa.array(best.ids[q], pa.int64(), mask=best.nulls[q]),
                        pa.array(best.scores[q], pa.int64()),
                        pa.array(np.full(n, task), pa.int32()),
                    ],
                    names=["_query", "doc_id", "score", "_task"],
                )

    found = shards.mapInArrow(run, _FOUND)
    # First the best of some tasks together, then those: no task gets the rows of all tasks.
    some = F.pmod("_task", F.lit(64)).alias("_some")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.row_number().over(Window.partitionBy("_query", "_some").orderBy(*order))
    kept = found.select("_query", "doc_id", "score", some).withColumn("_place", place).where(F.col("_place") <= k)
    out = materialise(kept.drop("_some", "_place"), "lexical-found")
    shared.unpersist()
    return out


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 50,
    text: str = "text",
    key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best documents of every row of ``queries`` (item_id, text): item_id, rank, doc_id, score."""
    numbered = queries.select("item_id", F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_query"))
    numbered = materialise(numbered, "queries")  # the numbers must not be drawn again
    parts = [_search_block(docs, block, k, text, key) for block in _blocks(numbered, "_text", block_bytes)]
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = reduce(DataFrame.unionByName, parts).withColumn(
        "rank", F.row_number().over(Window.partitionBy("_query").orderBy(*order))
    )
    return (
        ranked.where(F.col("rank") <= k)
        .join(numbered.select("_query", "item_id"), "_query")
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
