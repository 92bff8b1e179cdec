"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.langid import UNKNOWN, fit_languages, predict_languages
from emberline.llm.line_dedup import dedup_lines
from emberline.llm.mixing import mix_sources
from emberline.llm.near_dedup import near_duplicates
from emberline.llm.packing import pack_documents
from emberline.llm.queries import tokenizer_path
from emberline.llm.runtime import cut_table, drop_tables, table, tables_written

#: A text whose main language has a smaller share of its letters is rejected.
LEAST_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or with a mere mixture go.

    Null, empty and letterless texts go; a null ``lang`` teaches nothing; without any language to
    learn every text with a letter stays; repeated rows are judged each on its own; a null id is
    an id like others; an empty table stays empty; further columns pass through.
    """
    model = fit_languages(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    judged = predict_languages(docs, model, carry=tuple(docs.columns))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("carried.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them share.

    A null text becomes the empty one; repeated rows count one by one and all of those with the
    largest id keep a line; a null id never keeps it; an empty table stays empty; further
    columns pass through, ``n_chars`` is counted anew.
    """
    cleaned = dedup_lines(docs, with_text=True, carry=tuple(c for c in docs.columns if c != "text"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cleaned.select(*[(new[c] if c in new else F.col("carried")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    Of rows that repeat the id that stands for a group one stays: the one whose text has the
    smallest digest, and of rows alike in text any. Null, empty and wordless texts are in no group
    and stay; a null id stands for no group, so its row goes if its text has the shingles of a row
    with an id, and stays otherwise; an empty table stays empty; further columns pass through.
    """
    kept = near_duplicates(docs, with_hash=True).where("kept")
    alone = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("text_hash"))
    chosen = kept.groupBy("doc_id", alone.alias("alone")).agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("rows"), F.min(F.col("n_shingles") > 0).alias("grouped"))
    digest = F.xxhash64("doc_id", "text_hash").alias("digest")
    single = F.col("grouped") & F.col("doc_id").isNotNull() & (F.col("rows") > 1)
    chosen = cut_table(chosen.select(F.col("doc_id").alias("kept_id"), single.alias("single"), digest))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).select("row", "doc_id", digest.alias("of"))
    own = (F.col("of") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    if chosen.where("single").isEmpty():
        return rows.join(chosen, own, "left_semi").select("row.*")
    turn = F.row_number().over(Window.partitionBy("of", "doc_id").orderBy("of"))
    return rows.join(chosen, own).withColumn("turn", turn).where("turn = 1 OR NOT single").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: each file holds a stretch of the schedule.

    A null source is a source of its own (""), a null text has no characters, a null id is placed
    like the id ""; repeated rows all stay; an empty table stays empty; further columns pass through.
    """
    mixed = mix_sources(docs, keep=tuple(docs.columns), as_struct=True)
    ordered = mixed.select("slot", "block_offset", F.col("doc_id").alias("order_id"), "kept_columns").repartitionByRange("slot", "block_offset", "order_id")
    return ordered.sortWithinPartitions("slot", "block_offset", "order_id").select("kept_columns.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in the training sequences, in the order of the mixture.

    Files are numbered in the order in which they were written, which is the schedule's, and are
    read from start to end: ``stretch`` is that number, and sequences ordered by (stretch,
    sequence_id) keep the target weights all along. Sequences of different stretches are packed
    apart but for what their last bins leave open. Rows that come from no numbered file have the
    stretch -1. Null and empty texts are the end id alone; a null id stays null; repeated rows
    are packed one by one; an empty table gives no rows; further columns are not carried.
    """
    stretch = F.try_to_number(F.nullif(F.regexp_extract(F.input_file_name(), "part-(\\d+)[^/]*$", 1), F.lit("")), F.lit("999999999")).cast("long")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), stretch=stretch)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: The first stage is learned, so SQL cannot give the rows of ``run``.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between two stages a table in the shared folder is written and read."""
    docs, begun = table(spark, sf_dir, "documents"), tables_written()
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
        drop_tables(begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
