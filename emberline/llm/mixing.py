"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in the order of a digest of their ids, are one stretch of characters that
is cut into blocks. The target weights are shares of a frame of slots, one block each. The frame
is so long that the smallest weight has ``least_slots`` of it, so whole slots are away from a
weight by less than one in ``least_slots``; weights below ``least_slots`` in ``MOST_FRAME`` of all
have fewer, and the smallest of these one.
Block k of a source with share a is released at slot ``floor(k * frame / a)`` and due by slot
``ceil((k + 1) * frame / a)``; each slot goes to the released block with the earliest deadline.
Shares fill the frame exactly, so every deadline is met and after any number of slots no source
is a whole block away from its share. The schedule repeats from frame to frame, so it is made
once for a frame, from the weights alone, and rows find their slot by division: nothing is
simulated over the data.

Sources beyond ``max_sources`` are dealt into groups by a digest of their names. A group's blocks
are scheduled among its sources, and the groups among each other, by the same rule; a source of
share w in a group of share W then is less than 1 + w / W blocks away.

A document's place in its source is a prefix sum in two steps (digest buckets, then rows within
a bucket), so a source that holds most rows is spread over as many tasks as any other data.
A source that runs out leaves its slots empty; the others keep their proportions, and no
document is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut_table

#: The longest frame, and how many of its slots are scheduled before they are joined to the rest.
MOST_FRAME, STRETCH = 1_000_000, 500


def frame_for(weights: DataFrame, frame: int, least_slots: int) -> int:
    """Slots in which the smallest weight of every group has ``least_slots``; ``frame`` at least."""
    needed = weights.groupBy("grp").agg((F.sum("w") / F.min("w")).alias("n")).agg(F.max("n")).first()[0]
    return frame if needed is None else min(MOST_FRAME, max(frame, math.ceil(round(needed * least_slots, 6))))


def shares(weights: DataFrame, frame: int) -> DataFrame:
    """``grp, entries``: arrays of (source, share), the shares of a group adding up to ``frame``.

    ``weights``: ``grp, source, w``. A source has what its weight makes of the frame, rounded by
    largest remainder (ties by name), but one slot at least; the slots for that come from the
    others, in proportion to what they have beyond one.
    """
    one = weights.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("source", "w"))).alias("e"))
    one = one.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x["w"]))
    beyond = F.transform("e", lambda x: F.struct(x["source"].alias("source"), F.greatest(F.lit(frame) * x["w"] / F.col("total") - 1, F.lit(0.0)).alias("b")))
    one = one.select("grp", beyond.alias("e")).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x["b"]))
    exact = lambda x: F.when(F.col("total") > 0, (F.lit(frame) - F.size("e")) * x["b"] / F.col("total")).otherwise(F.lit(0.0))
    quota = one.select("grp", F.transform("e", lambda x: F.struct(x["source"].alias("source"), F.floor(exact(x)).cast("int").alias("whole"), exact(x).alias("exact"))).alias("q"))
    left = F.lit(frame) - F.size("q") - F.aggregate("q", F.lit(0), lambda a, x: a + x["whole"])
    ranked = quota.withColumn("left", left).withColumn("by_rest", F.array_sort(F.transform("q", lambda x: F.struct((x["whole"] - x["exact"]).alias("rest"), x["source"].alias("source")))))
    extra = F.transform(F.slice("by_rest", F.lit(1), F.greatest(F.col("left"), F.lit(0))), lambda x: x["source"])
    return ranked.withColumn("extra", extra).select(
        "grp", F.transform("q", lambda x: F.struct(x["source"].alias("source"), (x["whole"] + 1 + F.array_contains("extra", x["source"]).cast("int")).alias("share"))).alias("entries")
    )


def frame_schedule(entries: DataFrame, frame: int) -> DataFrame:
    """``grp, source, share, nth, frame_slot``: the slot in a frame of each source's nth block there.

    Earliest deadline first, as a fold over the slots of one frame; ``frame`` rows a group. The
    picks are a text, joined in stretches, so that a long frame is not copied at every slot.
    """

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        ready = F.transform(
            F.col("entries"),
            lambda e, i: once(
                F.get(acc["done"], i),
                lambda d: F.when((d < e["share"]) & (F.floor(d * F.lit(frame).cast("long") / e["share"]) <= t), F.struct(F.ceil((d + 1) * F.lit(frame).cast("long") / e["share"]).alias("deadline"), i.alias("i"))),
            ),
        )
        return once(
            F.array_min(ready)["i"],
            lambda pick: F.struct(F.transform(acc["done"], lambda d, i: d + (i == pick).cast("int")).alias("done"), F.concat(acc["picks"], pick.cast("string"), F.lit(",")).alias("picks")),
        )

    def stretch(acc: Column, c: Column) -> Column:
        slots = F.sequence(c * STRETCH, F.least((c + 1) * STRETCH, F.lit(frame)) - 1)
        own = F.aggregate(slots, F.struct(acc["done"].alias("done"), F.lit("").alias("picks")), step)
        return once(own, lambda x: F.struct(x["done"].alias("done"), F.concat(acc["picks"], x["picks"]).alias("picks")))

    start = F.struct(F.transform("entries", lambda e: F.lit(0)).alias("done"), F.lit("").alias("picks"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit((frame - 1) // STRETCH)), start, stretch, lambda acc: F.split(F.rtrim(acc["picks"], F.lit(",")), ","))
    picks = entries.select("grp", "entries", F.posexplode(folded).alias("frame_slot", "pick")).withColumn("e", F.get("entries", F.col("pick").cast("int")))
    nth = F.row_number().over(Window.partitionBy("grp", "source").orderBy("frame_slot")) - 1
    return picks.select("grp", "e.source", "e.share", "frame_slot").withColumn("nth", nth)


def _by_source(weights: DataFrame, frame: int) -> DataFrame:
    """``grp, source, share, slots``: a source's share and the frame slots of its blocks, in order."""
    schedule = frame_schedule(shares(weights, frame), frame)
    slots = F.transform(F.array_sort(F.collect_list(F.struct("nth", "frame_slot"))), lambda x: x["frame_slot"])
    return schedule.groupBy("grp", "source").agg(F.first("share").alias("share"), slots.alias("slots"))


def _windows(block: Column, share: Column, slots: Column, frame: int) -> tuple[Column, Column, Column]:
    """(release, deadline, slot) of a source's ``block``."""
    frame_no, nth = F.floor(block / share), F.pmod(block, share)
    first = frame_no * frame
    return first + F.floor(nth * frame / share), first + F.ceil((nth + 1) * frame / share), first + F.get(slots, nth.cast("int"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_chars: int = 1 << 16,
    frame: int = 1000,
    weights: Mapping[str, float] | None = None,
    other: float = 1.0,
    alpha: float = 0.5,
    least_slots: int = 20,
    max_sources: int = 200,
    keep: tuple[str, ...] = (),
    as_struct: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, source, its block, the block's window and slot, its place there.

    Columns: ``doc_id, source, n_chars, block, block_offset, release, deadline, slot`` and the columns
    named in ``keep`` (in a struct ``kept_columns`` if ``as_struct``); ``(slot, block_offset, doc_id)`` is the mixed order.
    ``weights``: the target weight of each source, in any unit; one that is not named has the weight
    ``other``. ``frame``: the least length of a frame. Without it a source's weight is its characters to the power ``alpha``. A block is
    ``block_chars`` characters of a source; a document is in the block in which it starts, so what
    slots up to any one hold of a source is away from its target by less than a block and its
    longest document. Defined cases: a weight that is not above 0 counts as the smallest that is
    (1 if none is); a null source is the source "" and a null text has no characters; a null id
    is placed as the id ""; repeated rows each get a row (rows alike in all but ``keep`` share
    nothing, their order is that of their sizes); an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        digest.alias("digest"),
        F.substring(digest, 1, 3).alias("bucket"),
        *([F.struct(*[F.col(c) for c in keep]).alias("kept_columns")] if keep else []),
    )
    sizes = rows.groupBy("source", "bucket").agg(F.sum("n_chars").alias("chars"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "bucket", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("bucket_start"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("bucket_start") + F.coalesce(F.sum("n_chars").over(in_bucket), F.lit(0))
    placed = rows.join(starts, ["source", "bucket"]).withColumn("at", at)

    by_size = F.pow(F.greatest(F.col("size"), F.lit(1)).cast("double"), F.lit(alpha))
    target = by_size if weights is None else _target(weights, other)
    targets = cut_table(sizes.groupBy("source").agg(F.sum("chars").alias("size")).select("source", target.alias("w")))
    n_sources = targets.count()
    groups = 1 if n_sources <= max_sources else -(-2 * n_sources // max_sources)
    grouped = targets.withColumn("grp", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int") if groups > 1 else F.lit(0))
    inner = frame_for(grouped, max(frame, n_sources) if groups == 1 else frame, least_slots)
    by_source = _by_source(grouped, inner)
    # One group has at most max_sources rows with frame slots in all, whatever the data: the bound for the broadcast.
    mixed = placed.join(F.broadcast(by_source) if groups == 1 else by_source, "source")
    block = F.floor(F.col("at") / F.lit(block_chars))
    release, deadline, slot = _windows(block, F.col("share"), F.col("slots"), inner)
    if groups > 1:
        sums = grouped.groupBy(F.col("grp").alias("source")).agg(F.sum("w").alias("w")).withColumn("grp", F.lit(0))
        outer = frame_for(sums, max(frame, groups), least_slots)
        of_groups = _by_source(sums, outer)
        mixed = mixed.join(of_groups.select(F.col("source").alias("grp"), F.col("share").alias("g_share"), F.col("slots").alias("g_slots")), "grp")
        through = lambda b: _windows(b, F.col("g_share"), F.col("g_slots"), outer)
        release, deadline, slot = through(release)[0], through(deadline - 1)[1], through(slot)[2]
    out = mixed.select(
        "doc_id",
        "source",
        "n_chars",
        block.alias("block"),
        (F.col("at") - block * block_chars).alias("block_offset"),
        release.alias("release"),
        deadline.alias("deadline"),
        slot.alias("slot"),
        *(["kept_columns"] if keep else []),
    )
    return out.select("doc_id", "source", "n_chars", "block", "block_offset", "release", "deadline", "slot", "kept_columns.*") if keep and not as_struct else out


def _target(weights: Mapping[str, float], other: float) -> Column:
    """The weight of ``source``; the map is the caller's own list, one literal for all."""
    named = {s: float(w) for s, w in weights.items()}
    least = min([w for w in (*named.values(), float(other)) if w > 0], default=1.0)
    table = F.create_map(*[F.lit(x) for s, w in named.items() for x in (s, w if w > 0 else least)]) if named else None
    rest = F.lit(float(other) if other > 0 else least)
    return rest if table is None else F.coalesce(F.try_element_at(table, F.col("source")), rest)
