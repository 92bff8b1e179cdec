"""Session helpers shared by the operators: shared checkpoint folder, table access, loop control."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import checkpoint_dir

_KEPT: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task: one at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """Operators that keep nothing free what another one has left in the worker."""
    _KEPT.clear()


#: Rows of texts that go to a Python worker at once; with Spark's default of 10,000 a batch of long texts is large.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sends at most ``BATCH_ROWS`` rows to Python at once, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_WRITTEN: list[tuple[SparkSession, str]] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read from there: its lineage ends.

    The files survive the loss of executors. Shuffle files of the step are removed as soon as the
    table is there; the table itself goes with ``drop_tables`` or when the Python process ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def tables_written() -> int:
    """How many tables operators have written so far and nobody has dropped."""
    return len(_WRITTEN)


def drop_tables(first: int = 0, keep: int = 0) -> None:
    """Deletes the tables from number ``first`` on, but the last ``keep`` ones; results that still read them end with them."""
    gone = _WRITTEN[first : len(_WRITTEN) - keep]
    del _WRITTEN[first : len(_WRITTEN) - keep]
    for spark, path in gone:
        if spark.sparkContext._jsc is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone first
        drop_tables()


atexit.register(_at_exit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir``; always through Spark's reader, so any store it can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
