"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: Bytes of text that a worker holds as Python objects at a time, and what it makes of them.
SLICE_BYTES = 1 << 20
#: Bytes that are no word character, for words of ASCII digits and letters and anything beyond ASCII.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
#: The same words as a Java or DuckDB pattern, on lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words cut at ASCII white space only.
TOKEN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def tokens(raw: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return raw.lower().split()


def words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return raw.lower().translate(_TO_SPACE).split()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same on pure ASCII, faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`written` made, once nothing that is still to run reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def raw_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, in slices of about ``SLICE_BYTES`` of ``text``.
    A batch of Spark's is 10,000 rows, of any length; a text is never cut."""
    for batch in batches:
        size = pc.binary_length(batch.column(text).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        number = (np.cumsum(size, dtype=np.int64) - size) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def map_texts(docs: DataFrame, function: Callable[[list[bytes]], dict[str, tuple[pa.DataType, list]]], added: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One output row per input row: the key and the columns that ``function`` makes of the
    raw texts of a slice. ``added`` is their schema, parts apart by ", "; only the two columns are read.
    """
    source = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    names = [part.split()[0] for part in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = function(raw_column(batch, text))
            arrays = [batch.column(key), *[pa.array(made[n][1], made[n][0]) for n in names]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *names])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {added}")
