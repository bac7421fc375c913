"""Incremental line deduplication that can be undone.

State in the shared folder, written anew by each change (an earlier version stays valid
until the change is complete):

* ``postings``: one row per (line key, document) with the line numbers;
* ``counts``: the exact reference counts, one row per line key: documents holding it and
  the largest of their ids;
* ``filters``: cuckoo filters of the repeated keys, sharded by the key. Keys that a change
  makes repeated are inserted, keys that it makes rare again are deleted.

A key is the first 128 bits of SHA-256 of the stripped, A-Z lower-cased line. Lines probe
the filter shards first; only those that may be repeated are joined with the exact
counts, so the filters never decide alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from .common import raw_column, slices, unused
from .cuckoo import CuckooFilter, build

MIN_CHARS = 20
MIN_DOCS = 3
#: Repeated keys per filter shard and postings per probing task, on average.
KEYS_PER_SHARD = 4_000
PROBED_TOGETHER = 20_000
_STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """16 bytes, or None for a line of under ``MIN_CHARS`` code points."""
    key = line.strip(_STRIPPED).lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return hashlib.sha256(key).digest()[:16]


def line_postings(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, lines array<int>)`` for every long enough line; null ids are left out."""

    source = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, keys, numbers, ends = [], [], [], [0]
            for row, text in enumerate(raw_column(batch, "text")):
                found: dict[bytes, list[int]] = {}
                for number, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if key is not None:
                        found.setdefault(key, []).append(number)
                rows += [row] * len(found)
                for key, at in found.items():
                    keys.append(key)
                    numbers += at
                    ends.append(len(numbers))
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), lines], names=["doc_id", "key", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key binary, lines array<int>")


@dataclass(frozen=True)
class LineState:
    """Where one version of the state lies, and the rules it was made with."""

    spark: SparkSession
    postings: str
    counts: str
    filters: str
    shards: int
    min_docs: int = MIN_DOCS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(getattr(self, name))


def _write(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, f"lines-{name}")
    df.write.parquet(path)
    return path


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if len(keys) else np.zeros(0, np.uint64)


def _build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    def make(group: pd.DataFrame) -> pd.DataFrame:
        data = build(_hashes(group["key"])).to_bytes()
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "n_keys": [len(group)], "data": [data]})

    return repeated.select("key", _shard(shards)).groupBy("shard").applyInPandas(make, "shard int, n_keys long, data binary")


def _changed_filters(state: LineState, changes: DataFrame) -> DataFrame:
    """The filters after inserting and deleting the keys of ``changes(key, insert boolean)``."""

    def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else new)["shard"].iloc[0]
        kept = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter.for_keys(len(new))
        count = int(old["n_keys"].sum())
        put, drop = (_hashes(new.loc[new["insert"] == flag, "key"]) for flag in (True, False))
        kept.delete(drop)
        full = not kept.insert(put)
        return pd.DataFrame({"shard": [shard], "n_keys": [count + len(put) - len(drop)], "data": [None if full else kept.to_bytes()]})

    return (
        state.table("filters").groupBy("shard")
        .cogroup(changes.select("key", "insert", _shard(state.shards)).groupBy("shard"))
        .applyInPandas(change, "shard int, n_keys long, data binary")
    )


def create(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineState:
    """The state of these documents. Rows that repeat a ``doc_id`` count as one document."""
    spark = docs.sparkSession
    postings = _write(line_postings(docs), "postings")
    counts = _write(_counted(spark.read.parquet(postings)), "counts")
    repeated = spark.read.parquet(counts).where(F.col("n_docs") >= min_docs)
    shards = max(1, repeated.count() // KEYS_PER_SHARD + 1)
    return LineState(spark, postings, counts, _write(_build_filters(repeated, shards), "filters"), shards, min_docs)


def _moved(state: LineState, postings: str, touched: DataFrame) -> LineState:
    """The state over ``postings``, counts taken anew for the ``touched`` keys only."""
    spark = state.spark
    old = state.table("counts")
    fresh = _counted(spark.read.parquet(postings).join(touched, "key", "left_semi"))
    counts = _write(old.join(touched, "key", "left_anti").unionByName(fresh), "counts")
    many = F.col("n_docs") >= state.min_docs
    before, after = (t.where(many).select("key") for t in (old, spark.read.parquet(counts)))
    changes = after.join(before, "key", "left_anti").withColumn("insert", F.lit(True)).unionByName(
        before.join(after, "key", "left_anti").withColumn("insert", F.lit(False))
    )
    filters = _write(_changed_filters(state, changes), "filters")
    if not spark.read.parquet(filters).where("data IS NULL").isEmpty():
        # a shard is full: all are built anew, with as many shards as the keys now need
        repeated = spark.read.parquet(counts).where(many)
        shards = max(1, repeated.count() // KEYS_PER_SHARD + 1)
        return replace(state, postings=postings, counts=counts, shards=shards, filters=_write(_build_filters(repeated, shards), "filters"))
    return replace(state, postings=postings, counts=counts, filters=filters)


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state with these documents added; a document that it holds already is left out."""
    held = state.table("postings")
    added = state.spark.read.parquet(_write(line_postings(docs).join(held.select("doc_id"), "doc_id", "left_anti"), "batch"))
    postings = _write(held.unionByName(added), "postings")
    return _moved(state, postings, added.select("key").distinct())


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents of ``doc_ids(doc_id)``; unknown ids change nothing."""
    held = state.table("postings")
    touched = held.join(doc_ids, "doc_id", "left_semi").select("key").distinct()
    postings = _write(held.join(doc_ids, "doc_id", "left_anti"), "postings")
    return _moved(state, postings, touched)


def _maybe_repeated(state: LineState, postings: DataFrame) -> DataFrame:
    """The postings whose key the filter shards hold (and few others). A shard's postings
    are dealt by document into as many parts as keep a probing group small, so a line that
    very many documents share does not meet in one task.
    """
    keyed = postings.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(state.shards)).cast("int"))
    most = keyed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = most // PROBED_TOGETHER + 1
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int"))
    filters = state.table("filters").select("shard", "data", F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1))).alias("part"))
    schema = postings.schema
    names = schema.names

    def probe(lines: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(shard):
            return lines.iloc[:0][names]
        return lines.loc[CuckooFilter.from_bytes(shard["data"].iloc[0]).contains(_hashes(lines["key"])), names]

    return dealt.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(probe, schema)


def dropped_lines(state: LineState) -> DataFrame:
    """``(doc_id, dropped array<int>)``: the numbers of the lines that go, for the documents
    of the state that lose any: repeated keys, except in the largest id holding them.
    """
    repeated = state.table("counts").where(F.col("n_docs") >= state.min_docs).select("key", "max_doc")
    hits = _maybe_repeated(state, state.table("postings")).join(repeated, "key").where("doc_id < max_doc")
    return hits.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("dropped"))


ADDED = ("kept", "n_lines", "n_dropped")


def keep_lines(docs: DataFrame, state: LineState, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with all columns and ``kept string, n_lines long, n_dropped long`` added, one
    row per row, under the names ``added``; columns that have these names already go.

    A null text is one empty line; a row without an id keeps all its lines. Equal ids stand
    for one document, whose rows should be equal. An empty table gives none.
    """
    gone_name = unused(docs, "_dropped")
    own = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    joined = docs.join(dropped_lines(state).withColumnRenamed("dropped", gone_name), "doc_id", "left").select(*own, gone_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(raw_column(batch, "text"), batch.column(gone_name).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    out = set(gone)
                    rest = [x for i, x in enumerate(lines) if i not in out]
                    n_dropped.append(len(lines) - len(rest))
                    text = b"\n".join(rest)
                else:
                    n_dropped.append(0)
                kept.append(text)
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], *made], names=[*own, *added])

    kinds = T.StructType([docs.schema[c] for c in own])
    for name, kind in zip(added, ("string", "long", "long")):
        kinds = kinds.add(name, kind)
    return joined.mapInArrow(run, kinds)


def deduplicate(docs: DataFrame, state: LineState) -> DataFrame:
    """``(doc_id, kept, n_lines, n_dropped)`` of :func:`keep_lines`."""
    return keep_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), state).drop("text")
