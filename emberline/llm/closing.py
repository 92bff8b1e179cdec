"""Linked pairs inside groups, closed transitively without writing the pairs.

A kernel sees the members of a group at once, compares those that are not in one component yet
and gives a spanning forest of its links, so a group costs rows in proportion to its members.
Groups beyond a size are dealt over chunks in two passes:

1. every chunk also gets the hubs of its group, some members that a digest picks. Members that
   link to hubs are in one component afterwards, in most groups all of them;
2. where components are left apart, each pair of different components has a member outside the
   group's largest one. Members that may link share further keys, so such a member visits the
   chunks where a member of another component has one of its keys, and no others: members that
   have nothing but their group in common cost nothing. Chunks without a visitor stay at home.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .components import connected_components
from .runtime import cut_table

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``rows`` rows or more where there are as many, from rows sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        last = batch.num_rows - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        same = bool(held) and held[-1].column(column)[-1].as_py() == int(keys[0])
        if n >= rows and not same:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
        if last and n + last >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held, n = [], 0
            batch = batch.slice(last)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of the component of each of ``n`` numbers, with links ``a, b``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != (next_label := label[label])).any():
            label = next_label
        apart = la != lb
        a, b = a[apart], b[apart]
    return label


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows ``a, b`` that connect what links between places of ``nodes`` connect: one for each node but the first."""
    known, place = np.unique(nodes, return_inverse=True)
    label = roots(len(known), place[a], place[b])
    rest = np.flatnonzero(label != np.arange(len(known)))
    return pa.RecordBatch.from_arrays([pa.array(known[rest], pa.int64()), pa.array(known[label[rest]], pa.int64())], ["a", "b"])


def _linked_in(tasks: DataFrame, payload: list[str], kernel: Kernel) -> DataFrame:
    """Links inside the tasks of ``tasks``."""
    return cut_table(tasks.select("task", "node", *payload).repartition("task").sortWithinPartitions("task").mapInArrow(kernel, "a long, b long"))


def second_pass(large: DataFrame, labels: DataFrame | None, keys: DataFrame, payload: list[str], most_rows: int, most_weight: int) -> DataFrame | None:
    """``task, node, *payload`` of what is left to compare in the groups ``large`` (with ``chunks, home, hub``); None if nothing is."""
    labelled = large.withColumn("label", F.col("node"))
    if labels is not None:
        labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.select("grp", "node", "weight", "home", "hub", "label")
    counts = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("all")).where("main.c < all")
    largest = cut(largest.select("grp", F.col("main.label").alias("main")))
    if largest.isEmpty():
        return None
    # Hubs have met everybody.
    apart = labelled.where("NOT hub").join(largest, "grp").join(keys, "node").withColumn("key", F.explode("keys")).where("key <> grp").drop("keys", "hub")
    asking = cut_table(apart.where("label <> main").select("grp", "key", "node", "weight", "home", "label"))
    asked = asking.select("grp", "key").distinct()
    holders = apart.join(asked, ["grp", "key"], "left_semi").groupBy("grp", "key", F.col("home").alias("at")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    visits = asking.join(holders, ["grp", "key"]).where("at <> home AND (low <> label OR high <> label)")
    visits = cut_table(visits.groupBy("grp", "node", "at").agg(F.first("weight").alias("weight")))
    load = visits.groupBy("grp", "at").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_rows), F.ceil(F.sum("weight") / most_weight)).cast("int").alias("turns"))
    load = cut(load)
    if load.isEmpty():
        return None
    body = large.where("NOT hub").select("grp", "node", "home", *payload)
    guests = body.join(visits.select("grp", "node", "at"), ["grp", "node"]).join(load, ["grp", "at"]).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(2)), F.col("turns")).cast("int"))
    hosts = body.withColumn("at", F.col("home")).join(load, ["grp", "at"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    task = F.xxhash64("grp", "at", "turn").alias("task")
    return hosts.select(task, "node", *payload).unionByName(guests.select(task, "node", *payload))


def close_groups(members: DataFrame, keys: DataFrame, payload: list[str], kernel: Kernel, most_rows: int, most_weight: int, hubs: int = 16) -> DataFrame | None:
    """``node, label`` of all nodes with a link; None without links.

    ``members``: ``grp, node, weight`` and the columns ``payload``; a node may be in many groups.
    ``keys``: ``node, keys``, a row for each node: arrays of which two nodes that may link share at
    least two entries (the number of their group may be one of them).
    ``kernel`` gets rows ``task, node, *payload`` sorted by task and gives links ``a, b`` inside tasks.
    """
    # A table of its own, so that the join has two plain exchanges and Spark can split a hot group.
    sizes = cut(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("mass")).where("n > 1"))
    chunks = F.when(F.col("n") > 2 * hubs, F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("mass") / most_weight))).otherwise(F.lit(1))
    sized = members.join(sizes.select("grp", F.col("n").alias("of"), chunks.cast("int").alias("chunks")), "grp")
    home = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("of") / hubs))) == 0
    sized = sized.withColumn("home", home).withColumn("hub", hub)
    places = F.when((F.col("chunks") > 1) & ~F.col("hub"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    first = sized.withColumn("chunk", F.explode(places)).withColumn("task", F.xxhash64("grp", "chunk"))
    links = _linked_in(first, payload, kernel)
    labels = None if links.isEmpty() else connected_components(links)

    large = sized.where("chunks > 1")
    if large.isEmpty():
        return labels
    tasks = second_pass(large, labels, keys, payload, most_rows, most_weight)
    rest = None if tasks is None else _linked_in(tasks, payload, kernel)
    if rest is None or rest.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")) if labels is not None else None
    return connected_components(rest if known is None else rest.unionByName(known))
