"""Rules that change while a stream runs: versions by the micro-batch from which they hold."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import match_rules
from ..plans.catalog import FieldCatalog, RuleError
from ..plans.rules import RuleSnapshot, compile_rules
from .ledger import Ledger

#: A folder that has changed is read once it has been quiet for so long.
QUIET_S = 1.0
#: Batches of which the version is known; a stream replays only its last one.
BATCHES_KEPT = 100


class VersionedRules:
    """The rules of a folder (``*.toml``, by path), with a version that outlives the process.

    A batch's version is written down before the batch is matched, and a version's texts before
    any batch has it, so a replayed batch gets the rules that it had, whatever the folder holds by
    then. A folder that changed is read once it has been quiet for ``quiet_s`` seconds. A bad set of rules
    changes nothing but ``last_error``; an empty folder is a good set after the first load.
    """

    def __init__(self, spark: SparkSession, folder: str, catalog: FieldCatalog, state: str, quiet_s: float = QUIET_S, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.catalog, self.quiet_s, self.clock = spark, folder, catalog, quiet_s, clock
        self.batches, self.versions = Ledger(spark, f"{state}/batches", BATCHES_KEPT), Ledger(spark, f"{state}/versions")
        self.last_error, self._compiled, self._tried, self._waits = "", {}, None, None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self) -> list[tuple[str, int, int]]:
        """(path, time of change in ms, size) of the rule files."""
        if not self._fs.exists(self._path):
            raise RuleError("RulePathNotFound", f"No rule file found at '{self.folder}'")
        out, files = [], self._fs.listFiles(self._path, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".toml"):
                out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
        return sorted(out)

    def _texts(self) -> list[str]:
        jvm, out = self.spark.sparkContext._jvm, []
        for path, _, _ in self._files():
            stream = self._fs.open(jvm.org.apache.hadoop.fs.Path(path))
            try:
                out.append(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
            finally:
                stream.close()
        return out

    def _snapshot(self, version: int) -> RuleSnapshot:
        if version not in self._compiled:
            self._compiled = {version: compile_rules(self.versions.get(version), self.catalog, allow_empty=True)}
        return self._compiled[version]

    def _quiet(self, files: list[tuple[str, int, int]]) -> bool:
        """Whether the folder has been as it is for long enough: since its last change, or since it was first seen so."""
        now = self.clock()
        if self._waits is None or self._waits[0] != files:
            self._waits = files, now
        changed = max((t for _, t, _ in files), default=0) / 1000
        return now - self._waits[1] >= self.quiet_s or (bool(files) and now - changed >= self.quiet_s)

    def for_batch(self, batch: int) -> tuple[RuleSnapshot, int]:
        """(rules, version) of a micro-batch; the same ones each time it is asked for."""
        had = self.batches.get(batch)
        if had is not None:
            return self._snapshot(had), had
        known = self.versions.batches()
        version = known[-1] if known else 0
        try:
            files = self._files()
            if not version or (files != self._tried and self._quiet(files)):
                self._tried, texts = files, self._texts()
                if not version or texts != self.versions.get(version):
                    compile_rules(texts, self.catalog, allow_empty=bool(version))
                    version += 1
                    self.versions.put(version, texts)
                self.last_error = ""
        except (RuleError, OSError, UnicodeDecodeError) as e:
            if not version:
                raise
            self.last_error = str(e)
        self.batches.put(batch, version)
        return self._snapshot(version), version


def run_with_reload(events: DataFrame, rules: VersionedRules, sink: Callable[[DataFrame, int, int], Any], checkpoint: str) -> StreamingQuery:
    """Matches of every micro-batch by the rules that hold then; ``sink`` gets matches, batch and rule version.

    A batch that is replayed after a failure goes to the sink again, with the same rules.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        snapshot, version = rules.for_batch(batch_id)
        sink(match_rules(batch, snapshot), batch_id, version)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
