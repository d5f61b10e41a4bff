"""Quality classifier: supervised subword embeddings, averaged, with softmax output.

Features of a text are its words, its pairs of neighbouring words (a word said twice
is one more) and the 3- and 4-byte n-grams of its words, hashed into one table of learned vectors. A document
is the mean of its feature vectors; a linear layer and softmax give the class.
Training is plain stochastic gradient descent in numpy, over a bounded sample of
labelled rows, in one executor task. For scoring, table and layer are folded to
one number for each bucket, so that a text costs a few vectorised passes.

Edge cases: null or empty texts have no features and score as the mean vector 0
does (0.5 at balanced classes); without labelled rows of both classes all texts
score 0.5; ids may be null or repeat; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from calltide.llm.common import Spans, chunks, labelled_sample, mix, packed, runs_of

BITS = 18
DIMENSIONS = 8
SAMPLE_ROWS = 4000
EPOCHS = 4
RATE = 0.5
_AGAIN = mix(np.array([0xA6A1], np.uint64))[0]
# Texts are worked on in blocks of about so many bytes; a longer text is cut at
# blanks into parts of this size, and pairs of words do not span such cuts.
BLOCK = 2 << 20


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features in ``data`` and the byte position of each."""
    shift = np.uint64(64 - BITS)
    word = data > 0x20
    starts, stops = runs_of(word)
    hashes = Spans(data).of(starts, stops)
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    near = starts[1:] - stops[:-1] == 1
    out, where = [hashes >> shift, pairs[near] >> shift], [starts, starts[:-1][near]]
    # A pair of equal words is a feature of its own, whatever the word.
    again = starts[:-1][near & (hashes[:-1] == hashes[1:])]
    out.append(np.full(len(again), _AGAIN, np.uint64) >> shift)
    where.append(again)
    if len(data) >= 4:
        padded = np.where(word, data, 0x20).astype(np.uint64)
        triple = padded[:-2] | padded[1:-1] << np.uint64(8) | padded[2:] << np.uint64(16)
        inner = word[1:-1]
        at = np.flatnonzero(inner)
        out.append(mix(triple[at] | np.uint64(3 << 32)) >> shift)
        where.append(at)
        at = np.flatnonzero(inner[:-1] & inner[1:])
        out.append(mix(triple[at] | padded[at + 3] << np.uint64(24) | np.uint64(4 << 32)) >> shift)
        where.append(at)
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def separated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with two blanks after each, so that no feature spans two of them."""
    sizes = np.diff(offsets)
    begins = offsets[:-1] + 2 * np.arange(len(sizes))
    out = np.full(len(data) + 2 * len(sizes), 0x20, np.uint8)
    out[np.repeat(begins - offsets[:-1], sizes) + np.arange(len(data))] = data
    return out, begins


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """One number for each bucket: how much the feature speaks for label 1."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    layer = np.zeros((DIMENSIONS, 2))
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32)
    bags = []
    for text in texts:
        buckets, count = np.unique(features(np.frombuffer(b" " + text + b" ", np.uint8))[0], return_counts=True)
        bags.append((buckets, count / max(1, count.sum())))
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            buckets, share = bags[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = share @ table[buckets]
            raw = mean @ layer
            grade = np.exp(raw - raw.max())
            grade /= grade.sum()
            grade[labels[k]] -= 1
            back = layer @ grade
            layer -= rate * np.outer(mean, grade)
            # Shares are small: the table learns at the pace of a mean of 30 features.
            table[buckets] -= (30 * rate * share)[:, None] * back
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32)


def _parts(text: np.ndarray) -> Iterator[np.ndarray]:
    while len(text) > BLOCK:
        blanks = np.flatnonzero(text[:BLOCK] <= 0x20)
        cut = int(blanks[-1]) + 1 if len(blanks) else BLOCK
        yield text[:cut]
        text = text[cut:]
    yield text


def scores_of(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of the texts that ``offsets`` cut ``data`` into."""
    n = len(offsets) - 1
    sums, counts = np.zeros(n), np.zeros(n)
    if len(data) > 2 * BLOCK:
        blocks = [(k, part) for k in range(n) for part in _parts(data[offsets[k] : offsets[k + 1]])]
    else:
        blocks = [(None, data)]
    for k, part in blocks:
        ends = offsets if k is None else np.array([0, len(part)])
        text, begins = separated(part, ends)
        # A leading blank closes n-grams at the start of the first text.
        buckets, where = features(np.concatenate([np.full(2, 0x20, np.uint8), text]))
        # An n-gram that starts at the blank before a text belongs to that text.
        of = np.searchsorted(begins + 2, where + 1, side="right") - 1
        keep = of >= 0
        of, value = of[keep], weights[buckets[keep]]
        total = np.bincount(of, value, len(begins))
        count = np.bincount(of, minlength=len(begins))
        if k is None:
            sums, counts = total, count
        else:
            sums[k] += total[0]
            counts[k] += count[0]
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Bucket weights learned from at most ``rows`` labelled rows, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [
            ((text or "").encode(), value, key if key is not None else -1)
            for batch in batches
            for text, value, key in zip(*(batch.column(x).to_pylist() for x in ("text", "label", "doc_id")))
        ]
        held.sort(key=lambda x: (x[2], x[0]))
        weights = fit([x[0] for x in held], np.array([x[1] for x in held], int))
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})

    sample = labelled_sample(docs, labels, label, rows)
    model = sample.repartition(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(model[0][0], np.float32) if model else np.zeros(1 << BITS, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of every whole text in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(weights.tobytes())
    kept = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.float32)
        for batch in (part for whole in batches for part in chunks(whole, text, BLOCK)):
            values = scores_of(*packed(batch, text), table)
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(values)], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
