"""Token ids as files of patched frame-of-reference blocks.

A block holds 256 values: their minimum, a bit width, the packed differences to
the minimum, and an exception list with the values that need more bits. The width
is the one that a percentile of the block's values fits in. A file has an index of
block starts, so that any range of values is decoded alone, and the ids and
lengths of its documents. Files are rows (``task``, ``number``, ``content``) of a
Parquet table, so that any store that Spark writes to can hold them.

Edge cases: a null or empty text is a document of the end id only; null ids come
first; rows of the same id are all kept, ordered by a hash of their text; values
may be any unsigned 32-bit integers; an empty table makes no file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.bpe import Numbers, Rows, words_of
from calltide.llm.common import chunks, texts_of

MAGIC = b"PFOR0001"
BLOCK = 256
PERCENTILE = 90
# Tokens after which a file is closed.
FILE_TOKENS = 4 << 20
# Words that a worker keeps, about 180 bytes each; beyond that it begins anew.
CACHE_WORDS = 1_600_000
# Words encoded together, and how the vocabulary writes a space.
_GROUP, _SPACE = 128, "\u0120"
_HEAD = struct.Struct("<IBH")  # minimum, width, number of exceptions
_FILE = struct.Struct("<8sQQQ")  # magic, values, blocks, documents
_BITS = 1 << np.arange(32, dtype=np.uint64)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of unsigned 32-bit ``values`` and the start of each block."""
    n = len(values)
    count = -(-n // BLOCK)
    table = np.zeros(count * BLOCK, np.uint32)
    table[:n] = values
    table[n:] = values[-1] if n else 0
    table = table.reshape(count, BLOCK)
    least = table.min(axis=1)
    over = table - least[:, None]
    bits = _widths(over)
    place = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, place, axis=1)[:, place] if count else np.zeros(0, np.uint8)
    outlier = bits > width[:, None]
    spare = outlier.sum(axis=1)
    sizes = _HEAD.size + width.astype(np.int64) * (BLOCK // 8) + spare * 5
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(count, 4)
    out[starts + 4] = width
    out[starts[:, None] + np.arange(5, 7)] = spare.astype("<u2").view(np.uint8).reshape(count, 2)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)):
            if w and len(part):
                wide = (over[part][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
                packed = np.packbits(wide.reshape(len(part), -1), axis=1, bitorder="little")
                out[starts[part][:, None] + _HEAD.size + np.arange(packed.shape[1])] = packed
    block, position = np.nonzero(outlier)
    within = np.arange(len(block)) - np.repeat(np.cumsum(spare) - spare, spare)
    base = starts[block] + _HEAD.size + width[block].astype(np.int64) * (BLOCK // 8)
    out[base + within] = position
    values_at = base + spare[block] + 4 * within
    out[values_at[:, None] + np.arange(4)] = over[outlier].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All values of the blocks that begin at ``starts``."""
    count = len(starts)
    least = data[starts[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width = data[starts + 4].astype(np.int64)
    spare = data[starts[:, None] + np.arange(5, 7)].copy().view("<u2").ravel().astype(np.int64)
    over = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)):
            if w and len(part):
                packed = data[starts[part][:, None] + _HEAD.size + np.arange(w * BLOCK // 8)]
                wide = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                total = np.zeros((len(part), BLOCK), np.uint32)
                for k in range(w):
                    total |= wide[:, :, k].astype(np.uint32) << np.uint32(k)
                over[part] = total
    block = np.repeat(np.arange(count), spare)
    within = np.arange(len(block)) - np.repeat(np.cumsum(spare) - spare, spare)
    base = starts[block] + _HEAD.size + width[block] * (BLOCK // 8)
    position = data[base + within]
    values_at = base + spare[block] + 4 * within
    over[block, position] = data[values_at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (over + least[:, None]).ravel()


def write_file(values: np.ndarray, ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A file: head, block starts, document ids, nulls and lengths, then the blocks."""
    blocks, starts = pack(values)
    known = np.array([0 if x is None else x for x in ids], "<i8")
    nulls = np.array([x is None for x in ids], np.uint8)
    return b"".join(
        [
            _FILE.pack(MAGIC, len(values), len(starts), len(ids)),
            starts.astype("<u8").tobytes(),
            known.tobytes(),
            nulls.tobytes(),
            np.asarray(sizes, "<u8").tobytes(),
            blocks,
        ]
    )


class TokenFile:
    """Reader of one file; ``values`` decodes only the blocks that a range touches."""

    def __init__(self, content: bytes):
        if len(content) < _FILE.size:
            raise ValueError("file is cut short")
        magic, self.count, blocks, documents = _FILE.unpack_from(content)
        if magic != MAGIC:
            raise ValueError(f"not a token file: {magic!r}")
        at = _FILE.size
        if len(content) < at + 8 * blocks + 17 * documents:
            raise ValueError("file is cut short")
        self.starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        self.ids = np.frombuffer(content, "<i8", documents, at)
        at += 8 * documents
        self.nulls = np.frombuffer(content, np.uint8, documents, at).astype(bool)
        at += documents
        self.sizes = np.frombuffer(content, "<u8", documents, at).astype(np.int64)
        at += 8 * documents
        self.data = np.frombuffer(content, np.uint8, offset=at)
        if int(self.sizes.sum()) != self.count or -(-self.count // BLOCK) != blocks:
            raise ValueError("lengths do not add up")

    def values(self, start: int, stop: int) -> np.ndarray:
        first = start // BLOCK
        part = unpack(self.data, self.starts[first : -(-stop // BLOCK)])
        return part[start - first * BLOCK : stop - first * BLOCK]


class Encoder:
    """Ids of words by the tokenizers library, remembered in one table of ids.

    Words without blanks inside are encoded many at once, with a space before each:
    the tokens that begin with a space tell where a word begins.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts with one of these are not cut: the library itself finds them there.
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[number for token, number in vocabulary.items() if token.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = Numbers(CACHE_WORDS)  # words that begin a text with a space before them, others without
        self.rows = Rows(np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in coded]

    def _learn(self, words: list[str]) -> None:
        """Adds the rows of new words: many at once if they are plain, without blanks
        inside or at their ends."""
        plain = np.array([w != "" and " " not in w and w == w.strip() for w in words], bool)
        many = [words[k] for k in np.flatnonzero(plain).tolist()]
        each = [words[k] for k in np.flatnonzero(~plain).tolist()]
        groups = [many[k : k + _GROUP] for k in range(0, len(many), _GROUP)]
        parts = self._ids([" " + " ".join(group) for group in groups])
        ids = np.concatenate([np.empty(0, np.uint32), *parts])
        known = Rows(np.uint32)
        known.add(ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        parts = self._ids([w[1:] if w[:1] == " " else f" {w}" for w in each]) if each else []
        known.add(np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64))
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(len(many)), len(many) + np.arange(len(each))
        self.rows.add(*known.of(place))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers, ``end`` after each."""
        whole = {k for k, text in enumerate(texts) if any(token in text for token in self.added)}
        if whole:
            out = iter(self._by_words([text for k, text in enumerate(texts) if k not in whole], end))
            return [self._ids([text])[0].astype("<u4").tobytes() + end if k in whole else next(out) for k, text in enumerate(texts)]
        return self._by_words(texts, end)

    def _by_words(self, texts: list[str], end: bytes) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self._forget()
        met, rows = len(self.words), []
        for text in texts:
            words = words_of(text)
            words[0] = f" {words[0]}"
            rows.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        new = list(islice(reversed(self.words), len(self.words) - met))
        self._learn(new[::-1])
        ids, sizes = self.rows.of(np.concatenate([np.empty(0, np.int32), *rows]))
        data = ids.astype("<u4").tobytes()
        cuts = 4 * np.cumsum(np.append(0, sizes))[np.cumsum([0, *map(len, rows)])]
        return [data[a:b] + end for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def write_tokens(
    docs: DataFrame,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Files of the ids of all texts in ascending order of ``key``: (task, number,
    before, tokens, content), where ``before`` counts the task's earlier tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, task = _ENCODERS[path], TaskContext.get().partitionId()
        number, before, ids, coded, size = 0, 0, [], [], 0

        def close():
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            content = write_file(np.frombuffer(b"".join(coded), "<u4"), ids, sizes)
            fields = {"task": [task], "number": [number], "before": [before], "tokens": [size], "content": [content]}
            return pa.RecordBatch.from_pydict(fields)

        for batch in (part for whole in batches for part in chunks(whole, text, 2 << 20)):
            for one, code in zip(batch.column(key).to_pylist(), encoder.encode(texts_of(batch, text), end)):
                ids.append(one)
                coded.append(code)
                size += len(code) // 4
                if size >= file_tokens:
                    yield close()
                    number, before, ids, coded, size = number + 1, before + size, [], [], 0
        if ids:
            yield close()

    tie = F.xxhash64(text).alias("_tie")
    ordered = docs.select(key, text, tie).repartitionByRange(key, "_tie").sortWithinPartitions(key, "_tie")
    return ordered.select(key, text).mapInArrow(
        run, "task long, number long, before long, tokens long, content binary"
    )


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the files: (doc_id, start, ids), ids as little-endian 32-bit
    integers and ``start`` the number of tokens of all documents before.

    ``files`` must be a written table: range bounds are sampled and another run may
    deal the documents otherwise. Only a token count for each writing task comes to
    the driver.
    """
    totals = sorted(tuple(x) for x in files.groupBy("task").agg(F.sum("tokens")).collect())
    bases, total = {}, 0
    for task, tokens in totals:
        bases[task] = total
        total += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, before, content in zip(*(batch.column(x).to_pylist() for x in ("task", "before", "content"))):
                file = TokenFile(content)
                ends = np.cumsum(file.sizes)
                starts = ends - file.sizes
                a = 0
                while a < len(ends):  # runs of documents of a bounded number of tokens
                    b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), side="right")))
                    values = file.values(int(starts[a]), int(ends[b - 1])).astype("<u4")
                    cuts = (np.concatenate([starts[a:b], ends[b - 1 : b]]) - starts[a]) * 4
                    codes = pa.BinaryArray.from_buffers(
                        pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(values)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.ids[a:b], pa.int64(), mask=file.nulls[a:b]),
                            pa.array(starts[a:b] + before + bases[task], pa.int64()),
                            codes,
                        ],
                        names=["doc_id", "start", "ids"],
                    )
                    a = b

    return files.select("task", "before", "content").mapInArrow(run, "doc_id long, start long, ids binary")
