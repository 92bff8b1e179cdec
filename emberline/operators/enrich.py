"""Lookups beside the event stream: containers, blocked addresses, denied programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import container_id, container_runtime

#: Dimensions up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def sized(dimension: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``dimension`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension


def container_table(cgroups: DataFrame) -> DataFrame:
    """``cgroup_id, container`` from cgroup paths; paths without a container id are left out."""
    found = cgroups.select("cgroup_id", container_id(F.col("path")).alias("cid"), container_runtime(F.col("path")).alias("runtime")).where(F.col("cid").isNotNull())
    container = F.struct(
        F.col("cid").alias("container_id"),
        F.lit("<unknown>").alias("image"),
        F.lit(None).cast("string").alias("pod"),
        F.lit(None).cast("string").alias("namespace"),
        F.col("cgroup_id"),
        F.col("runtime"),
    )
    return found.select("cgroup_id", container.alias("container")).dropDuplicates(["cgroup_id"])


def enrich_containers(events: DataFrame, containers: DataFrame, key: str = "cgroup_id") -> DataFrame:
    """Events with the container of their cgroup, null where there is none."""
    return events.join(sized(containers), key, "left")


def kubernetes_metadata(containers: DataFrame, sandboxes: DataFrame) -> DataFrame:
    """``container_id, pod, namespace, image`` of containers whose sandbox is known: two hops, both needed."""
    return containers.join(sized(sandboxes), containers["sandbox_id"] == sandboxes["id"]).select(containers["container_id"], sandboxes["pod"], sandboxes["namespace"], F.coalesce(containers["image"], F.lit("")).alias("image"))


def drop_blocked(packets: DataFrame, blocked: DataFrame, address: Column) -> DataFrame:
    """Packets whose source address is not blocked."""
    probe = packets.withColumn("_address", address)
    return probe.join(sized(blocked.select(F.col("ip").alias("_address")).distinct()), "_address", "left_anti").drop("_address")


def flag_denied(execs: DataFrame, denied: DataFrame, key: Column) -> DataFrame:
    """All program starts, with ``denied`` where the exact key is listed."""
    listed = denied.select(F.col("path_key").alias("_key")).distinct().withColumn("denied", F.lit(True))
    return execs.withColumn("_key", key).join(sized(listed), "_key", "left").drop("_key").withColumn("denied", F.coalesce("denied", F.lit(False)))


def upsert_dimension(current: DataFrame, responses: DataFrame, kind: str, field: str, column: str) -> DataFrame:
    """A block or deny list after executed responses are added to it."""
    added = responses.where("success").select(F.explode("actions").alias("a")).where(F.col("a.kind") == kind).select(F.col(f"a.{field}").alias(column))
    return current.select(column).unionByName(added).distinct()
