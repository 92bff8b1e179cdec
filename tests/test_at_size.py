"""Operators whose faults show only on large or long input."""

import time

from pyspark.sql import functions as F

from emberline.operators import chunking, views


def test_response_ids_of_wide_rows(spark):
    n = 2_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("event"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.sha2(F.concat(F.lit("x"), "id"), 512).alias("more"))
    out = views.response_ids(rows, ["event"]).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") != F.col("event")).cast("int")).alias("wrong"), F.countDistinct("id").alias("ids")).first()
    assert (out["n"], out["wrong"], out["ids"]) == (n, 0, n)


def test_chunks_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(text,)], "t string")
    began = time.perf_counter()
    chunks = df.select(chunking.word_chunks(F.col("t"))).first()[0]
    assert time.perf_counter() - began < 10 and len(chunks) == -(-200_000 // 448) and chunks[1].startswith("w448 ")
