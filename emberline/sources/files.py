"""Files of a repository as rows: scan, allow-lists, scoped globs; rows as files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """``path`` (relative to ``base``) and ``text`` of all files below ``base``; bad bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    # Paths of files come with a scheme, whether or not ``base`` has one.
    root = re.sub("\\A[a-z]+:/*", "/", base).rstrip("/") + "/"
    inner = F.regexp_replace("path", "\\A[a-z]+:/*", "/")
    return files.select(F.substr(inner, F.position(F.lit(root), inner) + F.lit(len(root))).alias("path"), F.decode("content", "UTF-8").alias("text"))


def write_files(rows: DataFrame, base: str, path: str = "path", text: str = "text") -> int:
    """Each row's text as a file of its own at ``path`` below ``base``; how many there are. Null texts have none.

    A line break follows each text, so that no file is empty: Spark leaves empty files out when it reads a folder.
    Tasks write what they read, without a shuffle. A task that runs again writes the same files.
    ``base`` is a folder that Arrow's file systems reach (local or mounted, HDFS, object stores).
    A file is one entry of its folder: Spark's writer makes a folder, a file and a checksum of it.
    """
    uri = re.sub("\\Afile:/*", "file:///", base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(uri)
        made, n = set(), 0
        for batch in batches:
            for inner, content in zip(batch.column(0), batch.column(1)):
                full = f"{root.rstrip('/')}/{inner.as_py()}"
                folder = full.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(full) as out:
                    out.write(content.as_py() + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    contents = rows.where(F.col(text).isNotNull()).select(F.col(path), F.encode(text, "UTF-8"))
    return contents.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def has_part(path: Column, names: Sequence[str]) -> Column:
    """Whether a directory or file of the path has one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def in_scope(path: Column, scopes: Sequence[str]) -> Column:
    out = F.lit(False)
    for scope in scopes:
        out = out | F.startswith(path, F.lit(scope))
    return out


def should_index(path: Column, extensions: Sequence[str], names: Sequence[str], exclude_dirs: Sequence[str], exclude_paths: Sequence[str], include_paths: Sequence[str]) -> Column:
    """Excluded parts, then excluded prefixes, then allowed kinds of files; root files always, others by prefix."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, "(?<=.)(\\.[^.]*)\\z", 1)
    allowed = suffix.isin(*extensions) | name.isin(*names)
    return ~has_part(path, exclude_dirs) & ~in_scope(path, exclude_paths) & allowed & (~F.contains(path, F.lit("/")) | in_scope(path, include_paths))


def find_files(files: DataFrame, extension: str, scopes: Sequence[str], exclude_dirs: Sequence[str]) -> DataFrame:
    return files.where(F.endswith("path", F.lit(extension)) & ~has_part(F.col("path"), exclude_dirs) & in_scope(F.col("path"), scopes))
