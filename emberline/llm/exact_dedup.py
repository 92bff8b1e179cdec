"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined three times, and every time rows are grouped by their full content, not by
a digest alone:

1. locally: the salt belongs to the task that reads a row, so Spark's partial aggregation leaves
   one row for each text and task, whatever the number of copies;
2. per salt: ``(salt, content)`` groups meet in one shuffle, so the rows of one text are dealt
   over ``salts`` tasks instead of one (by default as many as a shuffle has tasks);
3. globally: at most ``salts`` winners of a text meet and give the class its winner and size.

Rows then look their class up by SHA-256 and a second digest. Classes that hold more than one row
in ``HOT`` are fewer than ``HOT`` by count, so these are broadcast, and no key of the remaining
lookup has more rows than that. The lookup is the one step without the content: it would be
shuffled a third time to tell apart texts that all merges have compared in full and that agree in
320 bits of digests. It does not depend on the salt, which another run of a task may choose anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut_table

#: A class with more than one in so many of all rows is hot.
HOT = 1000
#: Java regex for a run of the six ASCII white-space characters.
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id of the rows with an equal normalised text, ``group_size`` their
    number. Defined cases: a null or empty text is the empty text (all of them are one group);
    a null id never wins over another id and is kept only if all ids of its group are null;
    rows that repeat an id are rows of their own, all with the smallest id are kept; an empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    salts = salts or max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content")).select("doc_id", *digests(F.col("content")), "content")
    classes = cut_table(salt_winners(rows, salts).groupBy("sha", "second", "content").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("content"))
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > total // HOT
    # Fewer than HOT rows, as their sizes add up to the number of all rows at most.
    broad = F.broadcast(classes.where(hot).select("sha", "second", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    looked = rows.drop("content").join(broad, ["sha", "second"], "left")
    # Rows that have their class already go anywhere; no class has their key.
    key = F.when(F.col("hot_size").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    rest = classes.where(~hot).select(F.col("sha").alias("key"), "second", "keep_id", "group_size")
    found = looked.withColumn("key", key).join(rest, ["key", "second"], "left")
    keep = F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("hot_size", "group_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def digests(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias("sha"), F.xxhash64(content).alias("second")]


def salt_winners(rows: DataFrame, salts: int) -> DataFrame:
    """``salt, sha, second, content, first_id, n``: the copies of each text among the tasks of a salt.

    A task has one salt, so what it sends are the distinct texts that it has read.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.groupBy("salt", "sha", "second", "content").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
