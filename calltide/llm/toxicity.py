"""Toxicity: nearest labelled examples by exact TF-IDF cosine, with evidence.

Examples are a bounded sample of labelled rows. Every word of them is a term: its
weight is TF-IDF times the log-likelihood ratio of the word against the label over
the sample, so that words which tell the classes apart lead and none is cut off.
Document frequencies are counted over the whole corpus. Examples lie in a block-max
inverted index: blocks of examples, for each term and block the postings and the
highest weight. Similar examples share a block, so that the blocks of another kind of
text have low bounds. A search visits blocks by falling upper bound and stops when no
block can hold a nearer example, so the neighbours are exact. Votes weigh by
distance; a logistic curve fitted to leave-one-out votes makes them
probabilities at the class shares of all labels.

Edge cases: null or empty texts, and texts without any word that weighs, get the
smoothed share of toxic rows among such examples; cosines count to twelve digits,
and of examples at equal distance those with the smaller id count; without labels of
both classes the score is the share of toxic rows (0 without labels); ids may be null
or repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.llm.common import chunks, crc_mod3, labelled_sample, lean, texts_of
from calltide.session import materialise

SAMPLE_ROWS = 4000
# Results kept by a worker for texts that it meets again.
CACHE = 16_384
NEAREST = 25
BLOCK = 32
# So many blocks are visited first; vectors searched together, and their cells.
FIRST = 8
GROUP, CELLS = 256, 1 << 19
# Terms in more than one of ``COMMON`` examples, up to ``DENSE`` of them, are kept as
# dense rows; this changes the speed of a search only.
COMMON = 16
DENSE = 1024
EVIDENCE = 3
# Rows are handled in batches of about this many bytes; the words of longer texts are
# counted one after the other.
STEP = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterable[str]:
    text = text.lower()
    return _WORD.findall(text) if len(text) < STEP else map(re.Match.group, _WORD.finditer(text))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of all ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _side_by_side(points: np.ndarray) -> np.ndarray:
    """An order of ``points`` in which every ``BLOCK`` of them lie near each other.

    Points are halved along their direction of most variance until a block holds them.
    """
    done, open_ = [], [np.arange(len(points))]
    while open_:
        some = open_.pop()
        if len(some) <= BLOCK or not points.shape[1]:
            done.append(some)
            continue
        around = points[some]
        around -= around.mean(0)
        way = around[np.argmax(np.einsum("ij,ij->i", around, around))]
        for _ in range(8):
            way = around.T @ (around @ way)
            way = way / max(np.linalg.norm(way), 1e-300)
        by = some[np.argsort(np.round(around @ way, 9), kind="stable")]
        half = BLOCK * (-(-len(some) // BLOCK) // 2)
        open_ += [by[half:], by[:half]]
    return np.concatenate(done)


class BlockMaxIndex:
    """Inverted lists over unit vectors, cut into blocks of ``BLOCK`` similar examples.

    Common terms have a row of weights in each block that holds them, other terms a
    list of cells: a block, its highest weight and its postings. Texts are searched
    many at once, so that a block's common terms are one matrix product.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.size = len(vectors)
        self.blocks = max(1, -(-self.size // BLOCK))
        self.places = self.blocks * BLOCK
        owner = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        held = np.bincount(term, minlength=terms)
        common = np.argsort(-held, kind="stable")[:DENSE]
        common = common[held[common] * COMMON > self.size]
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        row = self.row[term]
        dense = np.zeros((self.size, len(common)))
        dense[owner[row >= 0], row[row >= 0]] = weight[row >= 0]
        self.order = _side_by_side(dense)
        self.place = np.empty(self.size, np.int64)
        self.place[self.order] = np.arange(self.size)
        self.dense_most = np.zeros((len(common), self.blocks))
        self.dense = []
        for block in range(self.blocks):
            members = dense[self.order[block * BLOCK : (block + 1) * BLOCK]]
            self.dense_most[:, block] = members.max(0, initial=0)
            rows = np.flatnonzero(self.dense_most[:, block])
            self.dense.append((rows, np.ascontiguousarray(members[:, rows].T)))
        owner, term, weight = self.place[owner[row < 0]], term[row < 0], weight[row < 0]
        cell = term * self.blocks + owner // BLOCK
        order = np.argsort(cell, kind="stable")
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        cells, start = np.unique(cell[order], return_index=True)
        self.block = (cells % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.empty(0)
        self.start = np.append(start, len(order))
        self.cells = np.searchsorted(cells, np.arange(terms + 1) * self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of highest cosine, ties to the lower number, and their cosines.

        Examples without a common term have cosine 0 and fill up at the end.
        """
        return self.search([(terms, weights)], k, [skip])[0]

    def search(self, texts: list, k: int, skip: list[int] | None = None, visits: list | None = None) -> list:
        """``nearest`` of many vectors; ``skip`` names an example for each that is no answer.

        To ``visits`` the number of blocks that each vector was compared with is added.
        """
        skip = [-1] * len(texts) if skip is None else skip
        # Vectors go together while their cells fit.
        sizes = np.cumsum([int((self.cells[t + 1] - self.cells[t]).sum()) for t, _ in texts] or [0])
        out, a = [], 0
        while a < len(texts):
            base = sizes[a - 1] if a else 0
            b = min(a + GROUP, max(a + 1, int(np.searchsorted(sizes, base + CELLS, side="right"))))
            out += self._search(texts[a:b], k, np.array(skip[a:b]), visits)
            a = b
        return out

    def _search(self, texts: list, k: int, skip: np.ndarray, visits: list | None) -> list:
        n = len(texts)
        of = np.repeat(np.arange(n), [len(t) for t, _ in texts])
        terms = np.concatenate([t for t, _ in texts]).astype(np.int64)
        weights = np.concatenate([w for _, w in texts])
        rows = self.row[terms]
        common = np.zeros((n, len(self.dense_most)))
        common[of[rows >= 0], rows[rows >= 0]] = weights[rows >= 0]
        of, terms, weights = of[rows < 0], terms[rows < 0], weights[rows < 0]
        first, sizes = self.cells[terms], self.cells[terms + 1] - self.cells[terms]
        cells, factors, of = _ranges(first, sizes), np.repeat(weights, sizes), np.repeat(of, sizes)
        met = of * self.blocks + self.block[cells]
        bound = np.bincount(met, factors * self.most[cells], n * self.blocks)
        bound = bound.reshape(n, self.blocks) + common @ self.dense_most
        order = np.argsort(-bound, axis=1, kind="stable")
        scores = np.full((n, self.places), -np.inf)
        worst, seen = np.full(n, -1.0), np.zeros(n, np.int64)
        top, inside = np.full((n, k), -np.inf), np.arange(BLOCK)
        skipped = np.flatnonzero(skip >= 0)
        at, width = 0, FIRST
        while at < self.blocks:
            near = order[:, at : at + width]
            # A bound is a sum of rounded products, as scores are.
            text, column = np.nonzero(np.take_along_axis(bound, near, 1) >= worst[:, None] - 2e-12)
            if not len(text):
                break
            visit = np.zeros((n, self.blocks), bool)
            visit[text, near[text, column]] = True
            seen += visit.sum(1)
            self._compare(scores, visit, common, of, cells, factors, met)
            scores[skipped, self.place[skip[skipped]]] = -np.inf
            # The k best of those so far and of the blocks just visited.
            wide = (near[:, :, None] * BLOCK + inside).reshape(n, -1)
            top = np.concatenate([top, np.take_along_axis(scores, wide, 1)], axis=1)
            top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
            worst = np.maximum(top[:, 0], -1.0)
            at, width = at + width, width * 2
        if visits is not None:
            visits += seen.tolist()
        out = []
        for row, least in zip(scores, worst):
            places = np.flatnonzero(row >= least)
            found = self.order[places]
            best = np.lexsort((found, -row[places]))[:k]
            out.append((found[best], row[places][best]))
        return out

    def _compare(self, scores, visit, common, of, cells, factors, met) -> None:
        """Fills in the scores of the texts and blocks of ``visit``."""
        near = np.flatnonzero(visit.ravel()[met])
        cells, of = cells[near], of[near]
        sizes = self.start[cells + 1] - self.start[cells]
        at = _ranges(self.start[cells], sizes)
        to = np.repeat(of * self.places, sizes) + self.owner[at]
        sums = np.bincount(to, self.weight[at] * np.repeat(factors[near], sizes), scores.size).reshape(scores.shape)
        for b in np.flatnonzero(visit.any(0)).tolist():
            texts = np.flatnonzero(visit[:, b])
            rows, weights = self.dense[b]
            start = b * BLOCK
            stop = start + weights.shape[1]
            part = sums[texts, start:stop]
            if len(rows):
                part = part + common[np.ix_(texts, rows)] @ weights
            scores[texts, start:stop] = np.round(part, 12)


def _counts(text: str, number: dict[str, int]) -> dict[int, int]:
    """How often a text holds each term of ``number``."""
    return {number[w]: n for w, n in Counter(words_of(text)).items() if w in number}


def _counts_of_all(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms that each text holds, rising, how often it does, and how many they are.

    Words that texts share are looked up once.
    """
    met = defaultdict(count().__next__)  # words by first use
    rows = [np.fromiter(map(met.__getitem__, words_of(text)), np.int32) for text in texts]
    term = np.fromiter(map(number.get, met, repeat(-1)), np.int64, len(met))
    term = term[np.concatenate([np.empty(0, np.int32), *rows])]
    of = np.repeat(np.arange(len(texts)), np.array([len(row) for row in rows], np.int64))
    base = len(number) + 1
    cell, times = np.unique((of * base + term)[term >= 0], return_counts=True)
    return cell % base, times, np.bincount(cell // base, minlength=len(texts))


def _split(words: str) -> list[str]:
    """The terms of ``words``, which holds one a line."""
    return words.split("\n") if words else []


def _numbered(words: str) -> dict[str, int]:
    return {term: k for k, term in enumerate(_split(words))}


class Model:
    """Terms, inverse document frequencies, examples and the calibration.

    ``words`` holds one term a line and ``examples`` is an Arrow table (doc_id, label,
    terms, counts): the driver keeps no Python object for each term and count.
    """

    def __init__(
        self, words: str, weigh: np.ndarray, found: np.ndarray, documents: int, examples: pa.Table, share: float
    ):
        self.words = words
        self.factor = weigh * (1 + np.log((1 + documents) / (1 + found)))
        examples = examples.take(np.argsort(examples.column("doc_id").to_numpy(), kind="stable"))
        self.ids = examples.column("doc_id").to_numpy().astype(np.int64)
        self.labels = examples.column("label").to_numpy().astype(float)
        vectors = self._of_examples(examples)
        self.index = BlockMaxIndex(vectors, len(weigh))
        self.share, self.curve, self.without = share, None, share
        classes = self.labels.sum(), len(self.labels) - self.labels.sum()
        if min(classes) < 1:
            return
        # Examples hold the classes by halves; weights bring back the true shares.
        weigh = np.where(self.labels == 1, share / classes[0], (1 - share) / classes[1])
        empty = np.array([not len(t) for t, _ in vectors])
        parts = weigh[empty] * len(weigh)
        self.without = float((parts @ self.labels[empty] + share) / (parts.sum() + 1))
        some = np.flatnonzero(~empty)
        votes = [self.vote(*x) for x in self.index.search([vectors[k] for k in some], NEAREST, some.tolist())]
        self.curve = _logistic(np.array(votes), self.labels[some], weigh[some])

    @cached_property
    def terms(self) -> list[str]:
        return _split(self.words)

    @cached_property
    def number(self) -> dict[str, int]:
        return {term: k for k, term in enumerate(self.terms)}

    def _of_examples(self, examples: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = pc.list_value_length(examples.column("terms")).to_numpy()
        terms, times = (pc.list_flatten(examples.column(x)).to_numpy() for x in ("terms", "counts"))
        order = np.lexsort((terms, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)))
        return self._unit(terms[order], times[order], sizes)

    def _unit(self, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors of texts that hold the next ``sizes`` of ``terms`` so many ``times``."""
        weights = (1 + np.log(times.astype(float))) * self.factor[terms]
        kept = weights > 0
        ends = np.append(0, np.cumsum(kept))[np.cumsum(np.append(0, sizes))].tolist()
        terms, weights = terms[kept].astype(np.int64), weights[kept]
        parts = [(terms[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])]
        return [(t, w / np.sqrt(w @ w)) if len(t) else (t, w) for t, w in parts]

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The unit vector of each text."""
        return self._unit(*_counts_of_all(texts, self.number))

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        near = 1 / (0.05 + np.maximum(0, 1 - cosines))
        return float(near @ self.labels[found] / near.sum()) if len(found) else 0.0

    def score(self, texts: list[str]) -> list[tuple[float, list[int], list[str]]]:
        """Of each text the probability, the nearest examples' ids and the terms that weigh most."""
        vectors = self.vectors(texts)
        out: list = [(self.without, [], [])] * len(vectors)
        some = [k for k, (terms, _) in enumerate(vectors) if self.curve is not None and len(terms)]
        for k, (found, cosines) in zip(some, self.index.search([vectors[k] for k in some], NEAREST)):
            line = self.curve[0] + self.curve[1] * self.vote(found, cosines)
            value = 1 / (1 + math.exp(-max(-30, min(30, line))))
            terms, weights = vectors[k]
            top = terms[np.argsort(-weights, kind="stable")[:EVIDENCE]]
            out[k] = value, self.ids[found[:EVIDENCE]].tolist(), [self.terms[t] for t in top.tolist()]
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a slight pull to zero."""
    if not len(x):
        return None
    weigh = weigh / weigh.sum() * len(x)
    design = np.stack([np.ones(len(x)), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weigh * (y - p)) - 1e-2 * beta
        bend = (design * (weigh * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Log-likelihood ratio (G) of words in ``a`` of ``toxic`` and ``b`` of all ``total`` examples."""

    def part(x):
        return x * np.log(np.maximum(x, 1))

    a, b = a.astype(float), b.astype(float)
    cells = part(a) + part(b - a) + part(toxic - a) + part(total - toxic - b + a)
    sides = part(b) + part(total - b) + part(float(toxic)) + part(float(total - toxic))
    value = 2 * (cells - sides + part(float(total)))
    # Sums of large parts: what is left of equal shares is rounding.
    return np.where(value > 1e-7, value, 0.0)


def _terms(sample: DataFrame) -> tuple[str, np.ndarray]:
    """All words of the sample, sorted and one a line, and what each tells of the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", STEP)):
            labels = batch.column("label").to_pylist()
            words = [sorted(set(words_of(text))) for text in texts_of(batch, "text")]
            for a in range(0, len(words), 64):
                yield pa.RecordBatch.from_pydict(
                    {
                        "term": [w for one in words[a : a + 64] for w in one],
                        "label": [y for one, y in zip(words[a : a + 64], labels[a : a + 64]) for _ in one],
                    },
                    schema=pa.schema([("term", pa.string()), ("label", pa.int32())]),
                )

    n = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return "", np.empty(0)
    a, b = F.sum("label"), F.count(F.lit(1))
    counted = sample.mapInArrow(lean(run), "term string, label int").groupBy("term").agg(a.alias("a"), b.alias("b"))
    rows = counted.toArrow().sort_by("term")
    of = rows.column("term").combine_chunks()
    words = pc.binary_join(pa.ListArray.from_arrays([0, len(of)], of), "\n")[0].as_py()
    a, b = (rows.column(x).to_numpy() for x in ("a", "b"))
    return words, _likelihood_ratio(a, b, n[1], sum(n.values()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows and the frequencies of all their
    words over all of ``docs``."""
    sample = materialise(labelled_sample(docs, labels, label, rows).repartition(8, "doc_id"), "toxicity-sample")
    known = labels.where((crc_mod3() != 1) & F.col(label).isNotNull())
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    words, weigh = _terms(sample)
    size = len(weigh)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, rows = _numbered(words), np.zeros(size, np.int64), 0
        for batch in (part for whole in batches for part in chunks(whole, "text", STEP)):
            held = Counter(chain.from_iterable(set(words_of(text)) for text in texts_of(batch, "text")))
            known = [word for word in held if word in number]
            found[np.array([number[word] for word in known], np.int64)] += np.array([held[word] for word in known], np.int64)
            rows += batch.num_rows
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array([*some.tolist(), -1], pa.int32()), "n": [*found[some].tolist(), rows]}
        )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered(words)
        for batch in (part for whole in batches for part in chunks(whole, "text", STEP)):
            counts = [_counts(t, number) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "label": batch.column("label"),
                    "terms": pa.array([list(c) for c in counts], pa.list_(pa.int32())),
                    "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
                }
            )

    counted = docs.select("text").mapInArrow(lean(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    found, documents = np.zeros(size, np.int64), int(n[term < 0].sum())
    found[term[term >= 0]] = n[term >= 0]
    examples = sample.mapInArrow(lean(vectors), "doc_id long, label int, terms array<int>, counts array<int>")
    return Model(words, weigh, found, documents, examples.toArrow(), share)


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``score``, ``nearest`` (ids of the nearest examples) and ``terms``
    (the text's weightiest terms); the text goes unless kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    gone = {"score", "nearest", "terms"} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        for batch in (part for whole in batches for part in chunks(whole, text, STEP)):
            texts = texts_of(batch, text)
            keys = [hashlib.blake2b(one.encode(), digest_size=16).digest() for one in texts]
            new = {key: one for key, one in zip(keys, texts) if key not in seen}
            if len(seen) + len(new) > CACHE:
                seen, new = {}, dict(zip(keys, texts))
            seen.update(zip(new, own.score(list(new.values()))))
            rows = [seen[key] for key in keys]
            names = [f.name for f in kept]
            added = [
                pa.array([x[0] for x in rows], pa.float64()),
                pa.array([x[1] for x in rows], pa.list_(pa.int64())),
                pa.array([x[2] for x in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), *added], names=[*names, "score", "nearest", "terms"]
            )

    added = [
        T.StructField("score", T.DoubleType()),
        T.StructField("nearest", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
    ]
    return df.mapInArrow(lean(run), T.StructType([*kept, *added]))
