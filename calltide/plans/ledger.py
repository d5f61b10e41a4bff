"""Tables that grow by batches and stay small: folders under one manifest.

Every batch is a folder of its own. A manifest, one small numbered file, names the
folders that make up the table: one snapshot with the newest row of every key, and the
batches after it. A batch or a new snapshot counts from the moment its manifest is
there, so a reader sees one state or the next and never half of one. After ``every``
batches they are folded into a new snapshot. The folders of the manifest before stay
for readers that still hold it and go with the next folding, so the number of folders
is bounded however long a stream runs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from calltide.storage import Store

_MANIFESTS = "_manifest"
EVERY = 20


@dataclass
class Manifest:
    number: int = 0
    snapshot: str | None = None
    batches: list[str] = field(default_factory=list)
    last_batch: int = -1
    schema: str | None = None

    @property
    def folders(self) -> list[str]:
        return ([self.snapshot] if self.snapshot else []) + self.batches


class Ledger:
    """The table under ``path``; with ``keys`` it is folded after ``every`` batches.

    ``order`` names columns that tell which row of a key is newer; without them a later
    batch wins. ``partition_by`` is kept in every folder, for pruning.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str] | None = None,
        every: int = EVERY,
        order: list[str] | None = None,
        partition_by: str | None = None,
    ):
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, every
        self.order, self.partition_by = order or [], partition_by
        self._store = Store(spark, path)

    # --- Manifests

    def _manifest(self) -> Manifest:
        """The newest whole manifest; one that is just being written does not count yet."""
        for name in reversed(self._store.names(_MANIFESTS)):
            try:
                return Manifest(**json.loads(self._store.text(f"{_MANIFESTS}/{name}")))
            except (ValueError, TypeError):
                continue
        return Manifest()

    def _publish(self, manifest: Manifest) -> bool:
        return self._store.create(f"{_MANIFESTS}/{manifest.number:012d}", json.dumps(asdict(manifest)))

    # --- Writing

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{name}")
        return name

    def put(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds a batch. With a number, a batch that is in the table already (a stream that
        runs it again) is left alone; without one, several writers may add at once."""
        now = self._manifest()
        if batch is not None and batch <= now.last_batch:
            return
        name = self._write(rows, "batch")
        while True:
            new = Manifest(
                now.number + 1,
                now.snapshot,
                [*now.batches, name],
                now.last_batch if batch is None else batch,
                rows.schema.json(),
            )
            if self._publish(new):
                break
            now = self._manifest()  # another writer was faster: add to its state
        if self.keys and len(new.batches) >= self.every:
            self.fold()

    def fold(self) -> None:
        """One snapshot instead of the batches; then what no reader can hold goes."""
        now = self._manifest()
        if not now.folders:
            return
        name = self._write(self._newest(now), "snapshot")
        new = Manifest(now.number + 1, name, [], now.last_batch, now.schema)
        if not self._publish(new):
            self._store.remove(name)  # a batch came in between: the next folding takes both
            return
        held = {*now.folders, *new.folders}
        for other in self._store.names():
            if other != _MANIFESTS and other not in held:
                self._store.remove(other)
        for other in self._store.names(_MANIFESTS):
            if int(other) < now.number:
                self._store.remove(f"{_MANIFESTS}/{other}")

    # --- Reading

    def _rows(self, manifest: Manifest) -> DataFrame:
        """All rows of a state, with ``_batch``: -1 in the snapshot, else the place of the batch."""
        if not manifest.folders:
            raise FileNotFoundError(f"no batch has been written under {self.path}")
        schema = StructType.fromJson(json.loads(manifest.schema))
        read = self.spark.read.schema(schema)
        first = -1 if manifest.snapshot else 0
        parts = [
            read.parquet(f"{self.path}/{name}").select(*schema.names, F.lit(first + k).alias("_batch"))
            for k, name in enumerate(manifest.folders)
        ]
        return reduce(DataFrame.unionByName, parts)

    def _newest(self, manifest: Manifest) -> DataFrame:
        rows = self._rows(manifest)
        fields = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        row = F.struct(*fields)
        order = F.struct(*self.order, "_batch", F.xxhash64(row))
        newest = rows.groupBy(*self.keys).agg(F.max_by(row, order).alias("_row"))
        return newest.select(*[c if c in self.keys else f"_row.{c}" for c in rows.columns if c != "_batch"])

    def read(self) -> DataFrame:
        """The newest row of every key; all rows of a table without keys."""
        now = self._manifest()
        return self._newest(now) if self.keys else self._rows(now).drop("_batch")

    def read_all(self) -> DataFrame:
        """All rows that are still there, those that a newer row replaces included."""
        return self._rows(self._manifest()).drop("_batch")

    def folders(self) -> list[str]:
        return [name for name in self._store.names() if name != _MANIFESTS]
