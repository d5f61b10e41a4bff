"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Every neighbouring pair whose joined
bytes are in the vocabulary waits in the bucket of its merge rank; a two-level
bitmap over the buckets yields the lowest rank by find-first-set. Entries whose
pair has changed since are stale and skipped when met. A pre-token of n bytes
costs O(n log n) at worst, so megabyte-long pre-tokens are no special case.

Short pre-tokens share one queue: a bucket then holds pairs of many of them, and the
leftmost of each are merged together. A pre-token sees its own merges in the order
that a queue of its own would give, for the lowest rank of all is the lowest of each
that has it.

Edge cases: a null text is an empty text, empty text has no ids, a null id list
decodes to empty bytes. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from calltide.llm.common import chunks, held, texts_of

_SHIFT = 8  # a bitmap word holds 2**_SHIFT ranks
_MASK = (1 << _SHIFT) - 1
_BIT = [1 << k for k in range(4096)]
# Words that a worker keeps, and their characters; beyond that it begins anew.
CACHE_WORDS, CACHE_LETTERS = 250_000, 8 << 20
# Pre-tokens that share a queue, and the bytes of the longest that does.
SHARED, SHORT = 64_000, 64
# Words matched together; bytes that are decoded, and texts that are encoded, at once.
_GROUP, _STEP, _CHUNK = 2048, 1 << 20, 4 << 20


class Numbers(defaultdict):
    """Numbers of keys by their first use; ``limit`` is heeded by the user of it."""

    def __init__(self, limit: int):
        super().__init__(count().__next__)
        self.limit = limit

    def clear(self) -> None:
        super().clear()
        self.default_factory = count().__next__


class Rows:
    """Rows of ids after each other in one growing array."""

    def __init__(self, kind: type):
        self.ids, self.ends, self.count = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of ``sizes`` ids each."""
        used, more = int(self.ends[self.count]), len(sizes)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used // 2 + 2 * len(ids), self.ids.dtype)])
        if self.count + more + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.count + 1], np.zeros(self.count // 2 + 2 * more, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[self.count + 1 : self.count + more + 1] = used + np.cumsum(sizes)
        self.count += more

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows``, and how many each row has."""
        start = self.ends[rows]
        sizes = self.ends[rows + 1] - start
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(start - (upto - sizes), sizes) + np.arange(total)], sizes


# Blanks other than space and newline, as the pattern or Python see blanks.
_OTHER_BLANK = re.compile("[\\x09\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str) -> list[str]:
    """``text`` cut at the single spaces that stand between two non-blank characters.

    No match of the pattern crosses such a cut and none looks beyond it, so the
    words, each with the space before it, can be matched one by one and remembered.
    """
    parts = text.split(" ")
    if "  " not in text and "\n " not in text and " \n" not in text and not _OTHER_BLANK.search(text):
        return parts
    words = [parts[0]]
    for part in parts[1:]:
        last = words[-1]
        if part and last and not part[0].isspace() and not last[-1].isspace():
            words.append(part)
        else:
            words[-1] = f"{last} {part}"
    return words


class Codec:
    """Encoder and decoder over a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        tokens = {rank: token for token, rank in ranks.items()}
        listed = [tokens.get(rank, b"") for rank in range(max(tokens, default=-1) + 1)]
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.sizes = np.array([len(x) for x in listed], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.find = regex.compile(pattern).findall
        self.leaves = [0] * ((max(ranks.values(), default=0) >> _SHIFT) + 1)
        self.doubles = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.doubles_array = np.array(self.doubles, np.int64)
        self.single = np.array([ranks.get(bytes((a,)), -1) for a in range(256)], np.int64)
        # Ranks of all tokens by the two tokens that they may be joined from.
        self.base = len(listed)
        splits = [
            (ranks[token[:k]] * self.base + ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        joined = np.array(sorted(splits), np.int64).reshape(-1, 2)
        self.pairs = np.append(joined[:, 0], np.iinfo(np.int64).max)
        self.joined = np.append(joined[:, 1], -1).astype(np.int32)
        # Pre-tokens that wait to be encoded together, and the words kept with their ids.
        self.pieces = Numbers(SHARED)
        self.words = Numbers(CACHE_WORDS)
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.letters, self.rows = 0, Rows(np.int32)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        look = self.ranks.get
        whole = look(data)
        if whole is not None:
            return [whole]
        n = len(data)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        pair = [-1] * n
        # The rank queue: positions by rank, a bit for each rank that has some,
        # and in ``top`` a bit for each bitmap word that has a bit.
        buckets: dict[int, list[int]] = {}
        leaves = self.leaves
        top = 0
        doubles = self.doubles
        for i in range(n - 1):
            rank = doubles[data[i] << 8 | data[i + 1]]
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> _SHIFT
                    leaves[word] |= _BIT[rank & _MASK]
                    top |= _BIT[word]
        while top:
            # Find first set: the lowest rank, of it the leftmost position.
            word = (top & -top).bit_length() - 1
            leaf = leaves[word]
            bit = leaf & -leaf
            rank = (word << _SHIFT) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaf ^= bit
                leaves[word] = leaf
                if not leaf:
                    top ^= _BIT[word]
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            pair[gone] = pair[i] = -1
            after[i] = end
            left = before[i]
            if left >= 0:
                rank = look(data[left:end])
                if rank is None:
                    pair[left] = -1
                else:
                    pair[left] = rank
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        word = rank >> _SHIFT
                        leaves[word] |= _BIT[rank & _MASK]
                        top |= _BIT[word]
            if end < n:
                before[end] = i
                rank = look(data[i : after[end]])
                if rank is not None:
                    pair[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> _SHIFT
                        leaves[word] |= _BIT[rank & _MASK]
                        top |= _BIT[word]
        ids = []
        i = 0
        while i < n:
            end = after[i]
            ids.append(look(data[i:end]))
            i = end
        return ids

    def together(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens that are no tokens, and how many each has, by one rank queue."""
        owner = np.repeat(np.arange(len(data)), [len(x) for x in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        n = len(flat)
        owner = np.append(owner, -1)  # the last place stands for no place
        token = np.append(self.single[flat], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        pair = np.full(n + 1, -1)
        if n:
            double = self.doubles_array[flat[:-1].astype(np.int64) << 8 | flat[1:]]
            pair[: n - 1] = np.where(owner[: n - 1] == owner[1:n], double, -1)
        some = np.flatnonzero(pair >= 0)
        some = some[np.argsort(pair[some], kind="stable")]
        ranks, cuts = np.unique(pair[some], return_index=True)
        buckets = {rank: x.tolist() for rank, x in zip(ranks.tolist(), np.split(some, cuts[1:]))}
        leaves, top = self.leaves, 0
        for rank in buckets:
            leaves[rank >> _SHIFT] |= _BIT[rank & _MASK]
            top |= _BIT[rank >> _SHIFT]
        while top:
            # Find first set: the lowest rank, of it the leftmost position of each pre-token.
            word = (top & -top).bit_length() - 1
            leaf = leaves[word]
            bit = leaf & -leaf
            rank = (word << _SHIFT) + bit.bit_length() - 1
            at = np.array(buckets.pop(rank))
            at = at[pair[at] == rank]  # the others are stale
            at.sort()
            of = owner[at]
            later = np.flatnonzero(of[1:] == of[:-1])
            if len(later):
                buckets[rank] = at[later + 1].tolist()
                at = np.delete(at, later + 1)
            else:
                leaf ^= bit
                leaves[word] = leaf
                if not leaf:
                    top ^= _BIT[word]
            gone = after[at]
            end = after[gone]
            pair[gone] = -1
            alive[gone] = False
            token[at] = rank
            after[at] = end
            before[end] = at
            place = np.concatenate([before[at], at])
            other = np.concatenate([at, end])
            key = token[place] * self.base + token[other]
            found = np.searchsorted(self.pairs, key)
            fits = (self.pairs[found] == key) & (owner[place] == owner[other])
            pair[place] = -1
            place, new = place[fits], self.joined[found[fits]]
            pair[place] = new
            for i, rank in zip(place.tolist(), new.tolist()):
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> _SHIFT
                    leaves[word] |= _BIT[rank & _MASK]
                    top |= _BIT[word]
        return token[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(data))

    def _flush(self, into: Rows) -> None:
        """Adds a row for each waiting pre-token, in order."""
        data = [piece.encode() for piece in self.pieces]
        whole = np.array([self.ranks.get(x, -1) for x in data], np.int64)
        size = np.ones(len(data), np.int64)
        length = np.array([len(x) for x in data], np.int64)
        short = np.flatnonzero((whole < 0) & (length <= SHORT))
        ids, size[short] = self.together([data[k] for k in short.tolist()])
        long = {k: self.piece(data[k]) for k in np.flatnonzero((whole < 0) & (length > SHORT)).tolist()}
        size[list(long)] = [len(x) for x in long.values()]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[start[whole >= 0]] = whole[whole >= 0]
        of = size[short]
        out[np.repeat(start[short] - (np.cumsum(of) - of), of) + np.arange(len(ids))] = ids
        for k, part in long.items():
            out[start[k] : start[k] + len(part)] = part
        into.add(out, size)
        self.pieces.clear()

    def _found(self, words: list[str], plain: bool) -> tuple[list[str], list[int]]:
        """The pre-tokens of words, and how many each word has. A word that begins a
        text comes with a space before it, which it has not got; the others without the
        space that they have. Plain words, without blanks at their ends, go together."""
        if not plain:
            parts = [self.find(w[1:] if w[:1] == " " else f" {w}") for w in words]
            return [piece for part in parts for piece in part], [len(part) for part in parts]
        pieces = self.find(" " + " ".join(words))
        ends = np.cumsum([len(x) for x in pieces])
        upto = np.searchsorted(ends, np.cumsum([len(w) + 1 for w in words]), side="right")
        return pieces, np.diff(upto, prepend=0).tolist()

    def _learn(self, words: list[str]) -> None:
        """Adds the rows of new words."""
        is_plain = np.array([w != "" and w == w.strip() for w in words], bool)
        by = np.argsort(is_plain, kind="stable")  # the plain ones last
        order, others = by.tolist(), len(words) - int(is_plain.sum())
        numbers, sizes, known = [], [], Rows(np.int32)
        done = Rows(np.int32)

        def close():
            self._flush(known)
            ids, counts = known.of(np.concatenate([np.empty(0, np.int64), *numbers]))
            ends = np.cumsum(np.append(0, counts))
            upto = ends[np.cumsum(sizes)] if sizes else np.empty(0, np.int64)
            done.add(ids, np.diff(upto, prepend=0))

        a = 0
        while a < len(order):
            b = min(a + _GROUP, others if a < others else len(order))
            pieces, counts = self._found([words[k] for k in order[a:b]], a >= others)
            numbers.append(np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces)))
            sizes += counts
            a = b
            if len(self.pieces) >= self.pieces.limit:
                close()
                numbers, sizes, known = [], [], Rows(np.int32)
        close()
        place = np.empty(len(order), np.int64)
        place[by] = np.arange(len(order))
        self.rows.add(*done.of(place))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, without special tokens, and how many each text has."""
        if len(self.words) > self.words.limit or self.letters > CACHE_LETTERS:
            self._forget()
        met, rows = len(self.words), []
        for text in texts:
            words = words_of(text)
            words[0] = f" {words[0]}"
            rows.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        new = list(islice(reversed(self.words), len(self.words) - met))[::-1]
        self.letters += sum(map(len, new))
        self._learn(new)
        ids, sizes = self.rows.of(np.concatenate([np.empty(0, np.int32), *rows]))
        ends = np.cumsum(np.append(0, sizes))[np.cumsum([0, *map(len, rows)])]
        return ids, np.diff(ends)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without special tokens, as native 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids after each other, and the number of bytes of each id."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        first = self.starts[ids] - (ends - sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        a = 0
        while a < len(ids):  # in steps of bounded memory
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
            stop = int(ends[b - 1])
            out[base:stop] = self.bytes[np.repeat(first[a:b], sizes[a:b]) + np.arange(base, stop)]
            a = b
        return out, sizes


def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker process; its word cache serves all its tasks."""
    return held(("bpe", path, pattern), lambda: Codec.load(path, pattern))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, drop: str | None = None) -> pa.RecordBatch:
    kept = [i for i, x in enumerate(batch.schema.names) if x not in (name, drop)]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + [column], names=[batch.schema.names[i] for i in kept] + [name]
    )


def _schema(df: DataFrame, name: str, kind: T.DataType, drop: str | None = None) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (name, drop)] + [T.StructField(name, kind)])


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep_text: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """``df`` with the ids of every whole text as an array; the text goes unless kept.

    ``path`` is a rank file that every executor has. Rows stay where they are.
    ``decoded`` names a column for the bytes that the ids decode to, as ``decode``
    gives them, without a second pass through Python.
    """
    drop = None if keep_text else text
    schema = _schema(df, ids, T.ArrayType(T.IntegerType()), drop)
    if decoded:
        schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (part for whole in batches for part in chunks(whole, text, _CHUNK)):
            values, sizes = own.encode_all(texts_of(batch, text))
            ends = np.cumsum(np.append(0, sizes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            coded = _with(batch, ids, lists, drop)
            yield _with(coded, decoded, _decoded(own, lists)) if decoded else coded

    return df.mapInArrow(run, schema)


def _decoded(own: Codec, lists: pa.ListArray) -> pa.Array:
    lists = lists.fill_null([]) if lists.null_count else lists
    offsets = lists.offsets.to_numpy()
    data, sizes = own.decode(lists.values.to_numpy()[offsets[0] : offsets[-1]])
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its id lists stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            if batch.num_rows:
                yield _with(batch, out, _decoded(own, batch.column(ids)))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))
