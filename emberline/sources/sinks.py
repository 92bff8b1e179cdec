"""Sinks of results: JSON logs by hour, console, tables with upsert and delete, small state tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_log(records: DataFrame, path: str, ts: str) -> None:
    """JSON lines in one folder per hour."""
    records.withColumn("hour", F.date_format(ts, "yyyy-MM-dd-HH")).write.mode("append").partitionBy("hour").json(path)


def stream_log(records: DataFrame, path: str, checkpoint: str, ts: str) -> StreamingQuery:
    hourly = records.withColumn("hour", F.date_format(ts, "yyyy-MM-dd-HH"))
    return hourly.writeStream.format("json").partitionBy("hour").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def console(records: DataFrame, seconds: float | None = None) -> StreamingQuery:
    """Prints a stream, for a limited time if asked."""
    query = records.writeStream.format("console").option("truncate", "false").start()
    if seconds is not None:
        query.awaitTermination(seconds)
        query.stop()
    return query


def upsert(current: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """``current`` with the rows of ``changed`` put in place of those with the same key."""
    return current.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def delete_file(points: DataFrame, file: str) -> DataFrame:
    """Points without the code chunks of a file; other kinds of points of that file stay."""
    gone = (F.col("file") == file) & (F.col("type") == "code_chunk")
    return points.where(~F.coalesce(gone, F.lit(False)))


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def save_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str = "path string, hash string") -> DataFrame:
    """The saved state; empty if there is none or its files are not Parquet. Other errors are raised."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).count()
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    except Exception as e:
        if "is not a Parquet file" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e):
            raise
    return spark.createDataFrame([], schema)


def note_rows(texts: DataFrame, text_col: str = "text", metadata_col: str | None = None) -> DataFrame:
    """Rows of a notes collection, each with a random id: the same text twice is two notes."""
    metadata = F.col(metadata_col) if metadata_col else F.lit(None).cast("string")
    return texts.select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"), F.lit("mcp_stored").alias("type"), F.col(text_col).alias("document"), metadata.alias("metadata"))


def insert_notes(notes: DataFrame, path: str) -> None:
    """Appends notes; their ids are drawn once, when they are written."""
    notes.write.mode("append").parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: str, recreate: bool = False) -> None:
    """A collection of points as a table; ``recreate`` empties it."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
