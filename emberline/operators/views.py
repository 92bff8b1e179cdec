"""Counters and bounded views over matches, events and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import SEVERITIES
from ..sources.shared import cut

RING = 250


def severity_table(spark: SparkSession) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("severity_idx"), F.lit(s).alias("severity")) for i, s in enumerate(SEVERITIES)])
    return spark.range(1).select(F.inline(entries))


def severity_counts(matches: DataFrame) -> DataFrame:
    """Matches of every severity, in order, zeros kept."""
    counts = matches.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return severity_table(matches.sparkSession).join(F.broadcast(counts), "severity", "left").select("severity_idx", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def rule_counts(matches: DataFrame, order: Column, latest: dict[str, str]) -> DataFrame:
    """Per rule: matches, hash and severity of its first, and the ``latest`` columns of its last match."""
    aggs = [F.max_by(column, order).alias(name) for name, column in latest.items()]
    return matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("rule_hash", order).alias("rule_hash"), F.min_by("severity", order).alias("severity"), *aggs)


def last_rows(df: DataFrame, group: list[Column], order: list[str], most: int = RING, first: bool = False) -> DataFrame:
    """The last (or ``first``) ``most`` rows of each group. Ranks are cut per salt before they meet, so a hot group is no hot task."""
    ranked = [F.asc(c) if first else F.desc(c) for c in order]
    named = df.select("*", *[g.alias(f"_g{i}") for i, g in enumerate(group)])
    keys = [f"_g{i}" for i in range(len(group))]
    salted = named.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(32)))
    local = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*ranked))).where(F.col("_n") <= most)
    whole = local.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked))).where(F.col("_n") <= most)
    return whole.drop("_n", "_salt", *keys)


def event_tab(kind: Column) -> Column:
    return F.when(kind.isin("InetSock", "Socket"), F.lit("network")).otherwise(F.lit("general"))


def correlation_order(df: DataFrame) -> DataFrame:
    """Records of a correlation view in its order: by step, completions last."""
    return df.orderBy(F.coalesce("step_idx", F.lit(2147483647)), "event_order")


#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_ROW_BITS = 33


def response_ids(responses: DataFrame, order: list[str]) -> DataFrame:
    """Ids 0, 1, 2 … in emission order: a range sort, written once, then each partition's rows moved by the sizes before it.

    The sorted rows are a checkpoint, so sizes and rows speak of the same partitions; no row meets another again.
    """
    spread = responses.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = cut(spread.withColumn("_at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row a partition: the window and the broadcast are as small as that.
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return spread.withColumn("_part", part).join(F.broadcast(starts), "_part", "left").withColumn("id", F.col("_start") + nth).drop("_part", "_start", "_at")


def enabled_hooks(hooks: DataFrame) -> DataFrame:
    return hooks.agg(F.count_if("enabled").alias("n_enabled"))


def pipeline_stats(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, object]:
    """Counters that are filled in while ``df`` is computed; read them from the observation afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen
