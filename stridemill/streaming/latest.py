"""The newest row of each key of an update stream, as versioned files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.schema import require_columns

# Batches of changes that are read beside a snapshot before a new one is written.
DELTAS = 8

_BATCH = "__batch"


class LatestTable:
    """Keys and their newest rows below ``path``, written batch by batch.

    A batch writes its changed rows as a delta; after ``deltas`` of them,
    snapshot and deltas are folded into a new snapshot. What belongs to the
    table is said by a small version file, named by the batch and moved to its
    name when all else is written: readers see a batch wholly or not at all,
    and read one snapshot and a bounded number of deltas, however many batches
    there were. A batch at or below the newest version changes nothing, so a
    batch that is run again is safe. Files that neither the new nor the last
    version needs are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], deltas: int = DELTAS):
        self.spark, self.path, self.keys, self.deltas = spark, path.rstrip("/"), list(keys), deltas
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}" if folder else self.path)
        return [f.getPath().getName() for f in self._system.listStatus(place)] if self._system.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def _content(self, version: int) -> dict:
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{version}").collect()
        return json.loads(rows[0]["value"])

    def _newest(self, frames: Sequence[DataFrame]) -> DataFrame:
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        others = [c for c in rows.columns if c not in (*self.keys, _BATCH)]
        newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in (_BATCH, *others)]), _BATCH).alias("s")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "s.*")

    def _frames(self, content: dict) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{name}") for name in content["files"]]

    def commit(self, batch: DataFrame, batch_id: int) -> None:
        """Write the changed rows of a batch, each key once; for ``foreachBatch``."""
        require_columns(batch, *self.keys)
        known = self.versions()
        if known and batch_id <= known[-1]:
            return
        content = self._content(known[-1]) if known else {"files": []}
        delta = f"delta-{batch_id}"
        batch.withColumn(_BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{delta}")
        files = [*content["files"], delta]
        if sum(f.startswith("delta") for f in files) > self.deltas:
            snapshot = f"snapshot-{batch_id}"
            self._newest(self._frames({"files": files})).write.mode("overwrite").parquet(f"{self.path}/{snapshot}")
            files = [snapshot]
        self._publish(batch_id, {"files": files})
        self._clean(set(files) | set(content["files"]), [*known[-1:], batch_id])

    def _publish(self, version: int, content: dict) -> None:
        hidden = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = self._system.create(hidden, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._system.rename(hidden, self._path(f"{self.path}/versions/{version}")):
            raise OSError(f"cannot publish version {version} of {self.path}")

    def _clean(self, files: set[str], versions: list[int]) -> None:
        for name in self._names(""):
            if name.startswith(("delta-", "snapshot-")) and name not in files:
                self._system.delete(self._path(f"{self.path}/{name}"), True)
        for version in self.versions():
            if version not in versions:
                self._system.delete(self._path(f"{self.path}/versions/{version}"), False)

    def read(self) -> DataFrame:
        """The newest row of each key."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"{self.path} has no version")
        return self._newest(self._frames(self._content(known[-1]))).drop(_BATCH)
