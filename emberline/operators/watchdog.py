"""Heartbeat supervision in batch: stale heartbeats, lost programs.

Both look at the heartbeats of a key in order of time. Rows are dealt by key and slab of time, and
what a slab has to know of those before it comes from one row per slab, so a key with most of
all heartbeats is many tasks. Heartbeats without key or time are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECK_MS, STALE_MS = 5_000, 15_000
SLAB_MS = 3_600_000


def in_slabs(heartbeats: DataFrame, key: str, slab_ms: int = SLAB_MS) -> DataFrame:
    return heartbeats.where(F.col(key).isNotNull() & F.col("ts_ms").isNotNull()).withColumn("_slab", F.expr(f"ts_ms div {slab_ms}"))


def from_agent(heartbeats: DataFrame, key: str) -> DataFrame:
    """Heartbeats of the process that sent the first one; others are ignored."""
    first = heartbeats.groupBy(key).agg(F.min_by("pid", F.struct("ts_ms", "pid")).alias("_agent"))
    return heartbeats.join(first, key).where(F.col("pid") == F.col("_agent")).drop("_agent")


def stale_heartbeats(heartbeats: DataFrame, key: str, armed_ms: int = 0, check_ms: int = CHECK_MS, stale_ms: int = STALE_MS) -> DataFrame:
    """``key, last_ts, fired_at, age_ms``: the first check of each gap at which the heartbeat was too old.

    Checks run every ``check_ms`` from ``armed_ms``; a gap fires once, and only if such a check
    comes before the next heartbeat. The last heartbeat of a key has no next one and fires.
    """
    rows = in_slabs(heartbeats.select(key, "ts_ms"), key)
    following = F.lead("ts_ms").over(Window.partitionBy(key, "_slab").orderBy("ts_ms"))
    inside = rows.select(key, F.col("ts_ms").alias("last_ts"), following.alias("next_ts")).where(F.col("next_ts").isNotNull())
    ends = rows.groupBy(key, "_slab").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    across = ends.select(key, F.col("last").alias("last_ts"), F.lead("first").over(Window.partitionBy(key).orderBy("_slab")).alias("next_ts"))
    gaps = inside.unionByName(across)
    ticks = F.ceil((F.col("last_ts") + stale_ms - armed_ms) / F.lit(check_ms)).cast("long")
    fired = gaps.withColumn("fired_at", ticks * check_ms + armed_ms).where(F.col("next_ts").isNull() | (F.col("fired_at") < F.col("next_ts")))
    return fired.select(key, "last_ts", "fired_at", (F.col("fired_at") - F.col("last_ts")).alias("age_ms"))


def lost_programs(heartbeats: DataFrame, key: str, arrival: str) -> DataFrame:
    """``key, ts_ms, severity, kind, reason``: the first drop below the most programs ever seen, once until recovery.

    Heartbeats of one millisecond are in the order of ``arrival``, and those of one arrival in that
    of their numbers, so rows dealt otherwise give the same. One without a number ends a drop.
    """
    rows = in_slabs(heartbeats.select(key, "ts_ms", "n_progs", F.col(arrival).alias("_nth")), key)
    # Nulls come last, as on a stream.
    place = F.struct("ts_ms", F.col("_nth").isNull(), "_nth", F.col("n_progs").isNull(), "n_progs")
    slabs = rows.groupBy(key, "_slab").agg(F.max("n_progs").alias("hi"), F.max_by("n_progs", place).alias("last"))
    earlier = Window.partitionBy(key).orderBy("_slab")
    known = slabs.select(key, "_slab", F.max("hi").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("most_before"), F.lag("last").over(earlier).alias("last_before"))
    order = Window.partitionBy(key, "_slab").orderBy("ts_ms", F.col("_nth").asc_nulls_last(), F.col("n_progs").asc_nulls_last())
    so_far = F.max("n_progs").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = rows.join(known, [key, "_slab"]).withColumn("most", F.greatest(so_far, "most_before"))

    def below(n: str, most: str) -> Column:
        return F.coalesce((F.col(most) > 0) & (F.col(n) < F.col(most)), F.lit(False))

    low = seen.withColumn("low", below("n_progs", "most"))
    # The latch: a drop is told where the row before was none; before the first row of a slab is the last one of the slab before.
    before = F.coalesce(F.lag("low").over(order), below("last_before", "most_before"))
    lows = low.withColumn("before", before).where(F.col("low") & ~F.col("before"))
    zero = F.col("n_progs") == 0
    return lows.select(
        key,
        "ts_ms",
        F.when(zero, F.lit(5)).otherwise(F.lit(3)).alias("severity"),
        F.when(zero, F.lit(2)).otherwise(F.lit(1)).alias("kind"),
        F.when(zero, F.lit("bpf-progs-zero-while-alive")).otherwise(F.format_string("bpf-progs-dropped-%d-of-%d", F.col("n_progs"), F.col("most"))).alias("reason"),
    )


def unload_events(heartbeats: DataFrame, key: str) -> DataFrame:
    """The record with which supervision of each key ends."""
    return heartbeats.groupBy(key).agg(F.max("ts_ms").alias("ts_ms")).select(key, "ts_ms", F.lit(4).alias("severity"), F.lit(3).alias("kind"), F.lit("watchdog-unloading").alias("reason"))
