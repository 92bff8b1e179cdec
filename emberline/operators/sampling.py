"""Token-bucket sampling of raw events for display; alerts are never sampled.

A bucket is a state over the rows of its group in order, but it forgets: what a row leaves behind
is used up ``burst`` cells later, so after a longer gap the next row finds a full bucket, as the
first row of all does. Groups are cut into sessions at such gaps, and sessions are dealt over
tasks. Gaps are found by slabs of time, of which a group has many, and one row a slab carries
what its rows have to know of the slabs before. A group that is never idle so long is one session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

RATE_PER_S, BURST = 10, 50
#: Length of a slab of time in gaps that end a session.
SLAB = 100


def with_sessions(rows: DataFrame, reset: int, order: list[str]) -> DataFrame:
    """``rows`` (``_group, _t``) with ``_session``: the time at which their session began."""
    slabbed = rows.withColumn("_slab", F.expr(f"_t div {SLAB * reset}") - F.when(F.col("_t") < 0, 1).otherwise(0))
    ends = slabbed.groupBy("_group", "_slab").agg(F.max("_t").alias("_end"))
    slabs = Window.partitionBy("_group").orderBy("_slab")
    earlier = ends.select("_group", "_slab", F.lag("_end").over(slabs).alias("_end_before"))
    inside = Window.partitionBy("_group", "_slab").orderBy("_t", *order)
    known = slabbed.join(earlier, ["_group", "_slab"])
    before = F.coalesce(F.lag("_t").over(inside), F.col("_end_before"))
    begins = F.when(before.isNull() | (F.col("_t") - before > reset), F.col("_t"))
    known = known.withColumn("_begins", begins).withColumn("_own", F.last("_begins", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The last beginning in each slab, and from it what a slab's first rows belong to.
    last = known.groupBy("_group", "_slab").agg(F.max("_begins").alias("_last"))
    carried = last.select("_group", "_slab", F.last("_last", ignorenulls=True).over(slabs.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return known.join(carried, ["_group", "_slab"]).withColumn("_session", F.coalesce("_own", "_carried"))


def token_bucket(events: DataFrame, order: list[str], ts_ns: str, group: str | None = None, rate: int = RATE_PER_S, burst: int = BURST) -> DataFrame:
    """``events`` with ``shown``: a row is shown if a token is there, by the theoretical arrival time of its group.

    Rows of a group come in the order of their time and of ``order``. Rows without a time are not
    shown and take no token; a null group is a group.
    """
    cell = 1_000_000_000 // rate
    room = cell * (burst - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, due = None, 0
        for batch in batches:
            shown = []
            for key, t in zip(zip(batch["_group"].tolist(), batch["_session"].tolist()), batch["_t"].tolist()):
                if key != current:
                    current, due = key, t
                due = max(due, t)
                ok = due - t <= room
                shown.append(ok)
                due += cell if ok else 0
            yield batch.drop(columns=["_group", "_session", "_t"]).assign(shown=shown)

    key = F.to_json(F.struct(F.col(group))) if group else F.lit("")
    keyed = events.withColumn("_group", key).withColumn("_t", F.col(ts_ns).cast("long"))
    sessions = with_sessions(keyed.where("_t IS NOT NULL"), cell * burst, order)
    dealt = sessions.repartition("_group", "_session").sortWithinPartitions("_group", "_session", "_t", *order)
    schema = StructType([*events.schema.fields, StructField("shown", BooleanType())])
    timed = dealt.select(*events.columns, "_group", "_session", "_t").mapInPandas(run, schema)
    return timed.unionByName(events.where(F.col(ts_ns).cast("long").isNull()).withColumn("shown", F.lit(False)))
