"""Registered queries of streams, each with the SQL of the same rows in batch.

Tables are dealt out of order over files, and a stream reads a few of them at a time: neighbours
in time come in different micro-batches, up to a known lateness apart. A last file holds one row
without content whose time is later than all others, as a clock would give it.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import queries as Q
from .operators.sequence import utc_micros
from .plans.catalog import bench_catalog
from .queries import query, table
from .sources.shared import checkpoint_dir
from .streaming.matching import stream_matches, stream_sequences
from .streaming.numbering import stream_response_ids
from .streaming.ordered import start
from .streaming.reload import VersionedRules, run_with_reload
from .streaming.staleness import stream_stale_heartbeats
from .streaming.watchdog import stream_lost_programs

#: Parts that a table is dealt over, and files that a micro-batch reads.
PARTS, FILES_AT_ONCE = 20, 5


def drained(out: DataFrame, base: str | None = None) -> DataFrame:
    """What a stream gives for the input that is there, by a file sink in the shared folder."""
    spark = out.sparkSession
    base = base or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    start(out, writer).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream of files takes a folder or a pattern but not the path of one file.
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def dealt_stream(rows: DataFrame, ts: str, micros: int = 1) -> tuple[DataFrame, str, int]:
    """(stream of ``rows``, how late they are at most, a sixth of that in ms for spans): each part has rows of two neighbouring spans of time.

    ``ts`` is a time without zone, or a number of units of ``micros`` microseconds. The last row of the stream has nothing but a time after the lateness.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/dealt-{uuid.uuid4().hex}"
    kind = dict(rows.dtypes)[ts]
    at = utc_micros(F.col(ts)) if kind == "timestamp_ntz" else F.col(ts) * micros
    first, last = rows.agg(F.min(at), F.max(at)).first()
    width = max(1, -(-(last - first + 1) // (PARTS - 1)))
    part = F.floor((at - first) / width) + F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    rows.withColumn("part", F.coalesce(part, F.lit(0)).cast("int")).repartition("part").write.partitionBy("part").parquet(folder)
    late = 3 * width
    end = last + 10 * late
    tick = F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=end)) if kind == "timestamp_ntz" else -(-end // micros)).cast(kind)
    none = spark.range(1).select(*[(tick if c == ts else F.lit(None).cast(of)).alias(c) for c, of in rows.dtypes], F.lit(PARTS + 1).alias("part"))
    none.write.partitionBy("part").mode("append").parquet(folder)
    # Files are read in the order of their times of change.
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begun = 1_000_000_000_000
    for d in fs.listStatus(path):
        number = d.getPath().getName().partition("=")[2]
        for f in fs.listStatus(d.getPath()) if number else ():
            fs.setTimes(f.getPath(), begun + 60_000 * int(number), -1)
    stream = spark.readStream.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).option("maxFilesPerTrigger", FILES_AT_ONCE).parquet(folder)
    return stream.drop("part"), f"{late} microseconds", max(1, late // 6000)


@query(f"SELECT event_id, rule_id, severity FROM ({Q.MATCHES_SQL})")
def stream_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(stream_matches(event_stream(spark, sf_dir), Q.ruleset()).select("event_id", "rule_id", "severity"))


@query(f"{Q._TWO} SELECT root_event, last_event, 1 AS steps FROM s1")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences over files in shuffled order: the rows of the batch."""
    snapshot = Q.two_step()
    events, late, span = dealt_stream(table(spark, sf_dir, "events"), "ts")
    out = drained(stream_sequences(events, snapshot, late, span_ms=span))
    return out.where("type = 'completed'").select(Q.event_no("root_order").alias("root_event"), Q.event_no("event_order").alias("last_event"), "steps")


@query(f"{Q._THREE} SELECT root_event, 0 AS step_idx, 'look' AS matched_rule_id, last_event AS step_event FROM s1 UNION ALL SELECT root_event, 1, 'buy', last_event FROM s2")
def stream_sequence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of sequences of two steps, over files in shuffled order."""
    events, late, span = dealt_stream(table(spark, sf_dir, "events"), "ts")
    out = drained(stream_sequences(events, Q.three_step(), late, span_ms=span))
    return out.where("type = 'step'").select(Q.event_no("root_order").alias("root_event"), "step_idx", "matched_rule_id", Q.event_no("event_order").alias("step_event"))


@query(Q.ORACLE_SQL["progs_dropped"])
def stream_progs_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, late, span = dealt_stream(Q.heartbeats(spark, sf_dir), "ts_ms", 1000)
    return drained(stream_lost_programs(rows, "event_id", late, span_ms=span))


@query(Q.ORACLE_SQL["heartbeat_stale"])
def stream_heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale heartbeats; after the last heartbeat of all, only ticks move the time, and every key fires once."""
    rows, late, span = dealt_stream(Q.heartbeats(spark, sf_dir).select("key", "ts_ms"), "ts_ms", 1000)
    ticks = rows.where("key IS NULL")
    return drained(stream_stale_heartbeats(rows.where("key IS NOT NULL"), ticks, late, span_ms=span))


_OLD, _NEW = ("event.value", ">", 60), ("event.value", ">", 90)


@query(f"SELECT event_id, 'big' AS rule_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS version FROM events WHERE {Q.VALUE} > CASE WHEN event_id % 3 = 0 THEN 60 ELSE 90 END")
def stream_with_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three micro-batches: the rules change after the first one, and each run starts anew."""
    base = f"{checkpoint_dir(spark)}/reload-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    rules = (_OLD, _NEW, _NEW)
    for part, condition in enumerate(rules):
        if not part or condition != rules[part - 1]:
            text = spark.createDataFrame([(Q.rule_toml("big", [condition]),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{base}/written")
            _as_rule(spark, f"{base}/written", f"{base}/rules/big.toml")
        events.where(F.col("event_id") % 3 == part).write.parquet(f"{base}/in/part={part}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in/part=*")
        versions = VersionedRules(spark, f"{base}/rules", bench_catalog(), f"{base}/versions", quiet_s=0.0)
        out = lambda matches, batch, version: matches.select("event_id", "rule_id", F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        run_with_reload(stream, versions, out, f"{base}/state").awaitTermination()
    return spark.read.schema("event_id long, rule_id string, version int").option("basePath", f"{base}/out").parquet(f"{base}/out").select("event_id", "rule_id", "version")


def _as_rule(spark: SparkSession, written: str, target: str) -> None:
    """The one part file below ``written`` as the file ``target``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    part = next(f.getPath() for f in fs.listStatus(path(written)) if f.getPath().getName().startswith("part-"))
    fs.delete(path(target), False)
    fs.rename(part, path(target))


@query(f"SELECT event_id, rule_id, row_number() OVER (ORDER BY event_id % 3, event_id, cand_pos) - 1 AS id FROM ({Q.MATCHES_SQL})")
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of matches over three micro-batches, each in a run of its own."""
    base = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.parquet(f"{base}/in/part={part}")
        stream = stream_matches(spark.readStream.schema(events.schema).parquet(f"{base}/in/part=*"), Q.ruleset())
        stream_response_ids(stream.select("event_id", "cand_pos", "rule_id"), ["event_id", "cand_pos"], f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("event_id long, cand_pos int, rule_id string, id long").option("basePath", f"{base}/out").parquet(f"{base}/out").select("event_id", "rule_id", "id")
