"""Zstandard WARC archives: writing with revisit records, and a validating reader.

An archive is a skippable frame with the dictionary, then one zstd frame for each
record. Archives are rows (``archive``, ``content``) of a Parquet table, so that
any store that Spark writes to can hold them; the content bytes are those of a
``.warc.zst`` file.

Edge cases: a null payload is empty, a null id is written as ``null`` and read
back as null, a null address leaves its header out, rows repeated with the same
id and payload are all of the same type, an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import batches_of, chunks

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD = 0xFD2FB528
VERSION = "WARC/1.1"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_ID = "urn:page:"
# An archive is closed at about this many payload bytes; its dictionary is trained
# on at most so many bytes from the start of so many of its first records.
ARCHIVE_BYTES = 8 << 20
_DICTIONARY_BYTES, _SAMPLES, _SAMPLE_BYTES = 16 << 10, 128, 4096
_FEED = 32 << 10


def record_types(
    pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0
) -> DataFrame:
    """``pages`` with the binary ``_payload`` and ``_refers_to``: the smallest key of
    the same payload where that is another row's, else null.

    The payload travels once, by its own key; the join by digest carries keys only.
    Columns of ``pages`` with the names used here give way.
    """
    pages = pages.drop("_payload", "_refers_to", "_sha", "_sha2", "_key", "_n")
    data: Column = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages = pages.withColumn("_payload", data).withColumn("_sha", F.sha2("_payload", 256))
    keys = pages.where(F.length("_payload") >= least_bytes).select(F.col(key).alias("_key"), "_sha").distinct()
    first = (
        keys.groupBy("_sha")
        .agg(F.min("_key").alias("_refers_to"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_sha", "_refers_to")
    )
    revisits = keys.join(first, "_sha").where(~F.col("_key").eqNullSafe(F.col("_refers_to")))
    revisits = revisits.withColumnRenamed("_sha", "_sha2")
    same = pages[key].eqNullSafe(revisits["_key"]) & (pages["_sha"] == revisits["_sha2"])
    return pages.join(revisits, same, "left").drop("_key", "_sha", "_sha2")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(key, url: str | None, payload: bytes, refers_to) -> bytes:
    """One uncompressed record: a response, or a revisit where ``refers_to`` is given."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'null' if key is None else key}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: dictionary frame, then a frame for each record."""
    samples = [x[:_SAMPLE_BYTES] for x in records[:_SAMPLES]]
    try:
        words = zstandard.train_dictionary(_DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too little to train on
        words = zstandard.ZstdCompressionDict(b"".join(samples)[:_DICTIONARY_BYTES].ljust(8, b"\0"))
    raw = words.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(packer.compress, records)])


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archives of rows that ``record_types`` has marked, as (archive, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"pages-{task:06d}-{count:06d}.warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [archive(held)]})

        for batch in (part for whole in batches for part in chunks(whole, "_payload")):
            columns = (batch.column(x).to_pylist() for x in (key, url, "_payload", "_refers_to"))
            for row in zip(*columns):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    count, held, size = count + 1, [], 0
        if held:
            yield close()

    return pages.select(key, url, "_payload", "_refers_to").mapInArrow(run, "archive string, content binary")


def frames(content: bytes) -> Iterator[bytes]:
    """Decoded records of an archive; raises ValueError where it is damaged."""
    view, at, words = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("dictionary frame is cut short")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", ZSTD):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        words = zstandard.ZstdCompressionDict(raw)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(view):
        one, out = reader.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise ValueError("record frame is cut short")
                piece = view[at : at + _FEED]
                out.append(one.decompress(piece))
                at += len(piece)
            at -= len(one.unused_data)
        except zstandard.ZstdError as error:
            raise ValueError(f"record frame at {at}: {error}") from error
        yield b"".join(out)


def _key(value: str | None):
    if value is None:
        return None
    if not (value.startswith(f"<{_ID}") and value.endswith(">")):
        raise ValueError(f"record id {value!r}")
    inner = value[len(_ID) + 1 : -1]
    return None if inner == "null" else int(inner)


def parse(data: bytes) -> dict:
    """A record's fields after checks of version, headers, lengths and digest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"version line {lines[0][:40]!r}")
    names = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:80]!r}")
        names[name.strip().lower()] = value.strip()
    for name in NEEDED:
        if name.lower() not in names:
            raise ValueError(f"no header {name}")
    length = int(names["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, block of {len(rest) - 4}")
    kind = names["warc-type"]
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    stated = names.get("warc-payload-digest", "").removeprefix("sha1:")
    size = int(names.get("x-payload-length", len(payload)))
    if kind == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError("payload does not match its digest or length")
    if kind == "revisit" and "warc-refers-to" not in names:
        raise ValueError("revisit without WARC-Refers-To")
    return {
        "page_id": _key(names["warc-record-id"]),
        "record_type": kind,
        "refers_to": _key(names.get("warc-refers-to")),
        "url": names.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": stated,
        "payload": payload if kind == "response" else None,
        "error": None,
    }


_FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


def read_archives(archives: DataFrame, strict: bool = True) -> DataFrame:
    """Records of archives (archive, content). Damage raises, or with ``strict``
    off gives a row that holds only ``error``; the rest of a cut archive is lost."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                records = frames(content or b"")
                while True:
                    try:
                        data = next(records)
                    except StopIteration:
                        break
                    except ValueError as error:
                        if strict:
                            raise ValueError(f"{name}: {error}") from error
                        yield dict.fromkeys(_FIELDS.names) | {"error": f"{name}: {error}"}
                        break
                    try:
                        yield parse(data)
                    except ValueError as error:
                        if strict:
                            raise ValueError(f"{name}: {error}") from error
                        yield dict.fromkeys(_FIELDS.names) | {"error": f"{name}: {error}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), _FIELDS, 256)

    return archives.select("archive", "content").mapInArrow(
        run,
        "page_id long, record_type string, refers_to long, url string, payload_bytes long, "
        "payload_digest string, payload binary, error string",
    )
