"""Small records by micro-batch, in any store that Spark can open: what a replayed batch has to find again."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Ledger:
    """One record a micro-batch. A record is there as a whole or not at all: it is written aside and renamed."""

    def __init__(self, spark: SparkSession, path: str, kept: int | None = None):
        """``kept``: how many of the latest records stay; all, if not said."""
        self.spark, self.folder, self.kept = spark, path.rstrip("/"), kept
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.folder))

    def batches(self) -> list[int]:
        """Numbers of the batches with a record, in order."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _file(self, batch: int) -> str:
        return f"{self.folder}/{batch:012}.json"

    def get(self, batch: int) -> Any | None:
        target = self._path(self._file(batch))
        if not self.fs.exists(target):
            return None
        stream = self.fs.open(target)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def put(self, batch: int, record: Any) -> None:
        aside, target = self._path(f"{self._file(batch)}.tmp"), self._path(self._file(batch))
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        self.fs.delete(target, False)
        self.fs.rename(aside, target)
        if self.kept is not None:
            for old in self.batches()[: -self.kept]:
                self.fs.delete(self._path(self._file(old)), False)

    def before(self, batch: int) -> tuple[int, Any] | None:
        """(batch, record) of the latest batch before ``batch``."""
        earlier = [b for b in self.batches() if b < batch]
        return (earlier[-1], self.get(earlier[-1])) if earlier else None
