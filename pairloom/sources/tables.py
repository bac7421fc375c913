"""Readers and writers with the reference formats' guarantees."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ranked

# Fixed value: shard names end in the index and the number of shards.
SHARD_NAME = r"-(\d{5})-of-(\d{5})"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted by ``order`` through a range sort; refuses an existing path."""
    df.orderBy(*order).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Exactly ``fields``, in that order; missing or extra columns are an error."""
    if set(df.columns) != set(fields):
        raise ValueError(f"fields differ: {sorted(set(df.columns) ^ set(fields))}")
    df.select(*fields).write.mode("errorifexists").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition: str | None = "split") -> None:
    """Typed Parquet; refuses an existing path so that a finished stage stays as it is."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def shard_counts(files: DataFrame, name: Column) -> DataFrame:
    """Shards present, shards promised by their names, and completeness."""
    seen = files.select(
        F.regexp_extract(name, SHARD_NAME, 1).cast("int").alias("index"), F.regexp_extract(name, SHARD_NAME, 2).cast("int").alias("total")
    ).distinct()
    return seen.agg(
        F.count_distinct("index").alias("present"), F.max("total").alias("total"), F.count_distinct("total").alias("totals")
    ).withColumn("complete", (F.col("present") == F.col("total")) & (F.col("totals") == 1))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below ``path``, from a listing; no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def shard_report(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness of a folder of shards, by their names; a shard without rows counts as present."""
    return shard_counts(file_listing(spark, folder), F.col("path"))


def read_shards(spark: SparkSession, folder: str, require_complete: bool = True) -> DataFrame:
    report = shard_report(spark, folder).first()
    if require_complete and not report["complete"]:
        raise ValueError(f"{report['present']} of {report['total']} shards in {folder}")
    return spark.read.parquet(folder)


def with_provenance(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Add the full path of the source file and the position of the row in it.

    Without ``order`` the position is the place in the file as Parquet stores it, known
    to the scan, so nothing is shuffled. With it, rows are ranked inside their file by
    slices, so a large file is not one task.
    """
    placed = df.withColumn("source_file", F.col("_metadata.file_path"))
    if not order:
        return placed.withColumn("source_index", F.col("_metadata.row_index"))
    return ranked(placed, ["source_file"], list(order)).withColumnRenamed("rank", "source_index").drop("size")


# Bytes of a file that a task holds at a time.
CHUNK = 4 << 20


def _open(path: str):
    """A stream over a file that Spark listed, in whatever file system it lies."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[len("file:"):].lstrip("/"), compression=None)
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inner, compression=None)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, length in zip(files["path"], files["length"]):
            sha256, md5 = hashlib.sha256(), hashlib.md5()
            with _open(path) as stream:
                while chunk := stream.read(CHUNK):
                    sha256.update(chunk)
                    md5.update(chunk)
            yield pd.DataFrame({
                "file": [path.rsplit("/", 1)[-1]], "path": [path], "length": [length],
                "sha256": [sha256.hexdigest()], "md5_base64": [base64.b64encode(md5.digest()).decode()],
            })


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 (hex) and MD5 (base64) of whole files, read chunk by chunk, so a file may be of any size."""
    files = file_listing(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A listing is a few rows that would share a task; the work is in what they name.
    return files.repartition(parts, "path").mapInPandas(_digests, "file string, path string, length bigint, sha256 string, md5_base64 string")
