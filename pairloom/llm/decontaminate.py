"""Benchmark passages in training texts, found with one FM-index per shard of texts.

A shard is what one task holds at a time, ``SHARD_WORDS`` words of whole texts. Only runs
of words that the benchmark has, as long as its shortest window, can hold a window; the
index is built over those runs, the rest stands for one separator. All windows are
searched backwards at once, occurrences located and their spans merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..session import stage
from .common import raw_column, unused, words
from .fm_index import FMIndex

WINDOW_WORDS = 10
#: A text longer than this makes a shard of its own.
SHARD_WORDS = 1_000_000
#: Benchmark text that is searched, and sent to the tasks, at a time.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Passages:
    """The windows of a block of benchmark items, coded over the words they use."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.codes: dict[bytes, int] = {}
        of_items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            length = min(window, len(coded))
            for start in range(len(coded) - length + 1 if length else 0):
                of_items.setdefault(tuple(coded[start : start + length]), set()).add(item)
        self.groups: list[tuple[np.ndarray, list[list[str]]]] = []
        for length in sorted({len(w) for w in of_items}):
            chosen = [w for w in of_items if len(w) == length]
            self.groups.append((np.array(chosen, np.int64), [sorted(of_items[w]) for w in chosen]))
        self.shortest = self.groups[0][0].shape[1] if self.groups else 0

    def _shard(self, coded: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        starts = np.cumsum([0, *[len(c) + 1 for c in coded]])
        whole = np.zeros(starts[-1], np.int64)
        for begin, codes in zip(starts, coded):
            whole[begin : begin + len(codes)] = codes
        spans: list[list[tuple[int, int]]] = [[] for _ in coded]
        items: list[set[str]] = [set() for _ in coded]
        edge = np.diff(np.r_[0, (whole != 0).view(np.int8), 0])
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - first >= self.shortest
        first, end = first[long], end[long]
        if not self.shortest or not len(first):
            return spans, items
        size = end - first + 1  # each run and a separator; whole[end] is a separator or another word
        origin = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        text = whole[origin]
        text[np.cumsum(size) - 1] = 0
        index = FMIndex(text, len(self.codes) + 1)
        change = np.zeros(len(whole) + 1, np.int64)
        for patterns, names in self.groups:
            row, place = index.find(patterns)
            at = origin[place]
            np.add.at(change, at, 1)
            np.add.at(change, at + patterns.shape[1], -1)
            pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * len(patterns) + row)
            for text_number, window in zip(*divmod(pairs, len(patterns))):
                items[text_number].update(names[window])
        edge = np.diff(np.r_[0, (np.cumsum(change) > 0).view(np.int8), 0])
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for text_number, a, b in zip(np.searchsorted(starts, first, "right") - 1, first, end):
            spans[text_number].append((int(a - starts[text_number]), int(b - starts[text_number])))
        return spans, items

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its words, the merged spans of words in windows, and the items found."""
        held: list[np.ndarray] = []
        total = 0
        for number, text in enumerate(texts):
            found = words(text)
            held.append(np.fromiter(map(self.codes.get, found, repeat(0)), np.int64, len(found)))
            total += len(found)
            if total >= SHARD_WORDS or number == len(texts) - 1:
                for codes, span, item in zip(held, *self._shard(held)):
                    yield len(codes), span, item
                held, total = [], 0

    def without(self, text: bytes, spans: list[tuple[int, int]]) -> bytes:
        """The text without these spans of words; what the cut brings together is searched again."""
        while spans:
            at = [m.span() for m in _WORD.finditer(text)]
            kept, last = [], 0
            for first, end in spans:
                kept.append(text[last : at[first][0]])
                last = at[end - 1][1]
            text = b"".join([*kept, text[last:]])
            spans = next(self.search([text]))[1]
        return text


def blocks(benchmark: DataFrame, window: int = WINDOW_WORDS) -> Iterator[Passages]:
    """The items, read through an iterator, in blocks of ``BLOCK_BYTES`` of text."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        text = bytes(row[1] or b"")
        if held and size + len(text) > BLOCK_BYTES:
            yield Passages(held, window)
            held, size = [], 0
        held.append((row[0] or "", text))
        size += len(text)
    if held:
        yield Passages(held, window)


_FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"
_SPANS_TYPE = ArrayType(StructType([StructField("first", IntegerType()), StructField("end", IntegerType())]))
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _merged(old: list, new: list) -> list[dict]:
    out: list[dict] = []
    for first, end in sorted([(s["first"], s["end"]) for s in old] + new):
        if out and first <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"first": first, "end": end})
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, n_words, spans, items)``, one row per row of ``docs``: merged spans of words
    (from 0, end excluded) inside an occurrence of a window, and the ids of the items whose
    windows occur. Null texts have no words, null item ids are named by an empty text, items
    without words have no window. An empty benchmark finds nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = "CAST(0 AS BIGINT) AS n_words", "CAST(array() AS array<struct<first:int,end:int>>) AS spans", "CAST(array() AS array<string>) AS items"
    current = docs.select("doc_id", F.col("text").cast("string").alias("text")).selectExpr("doc_id", "text", *empty)
    passages = None
    for number, passages in enumerate(blocks(benchmark, window)):
        if number:
            current = stage(current, "passages")

        def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = [], [], []
                old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                for (count, found, names), (s, i) in zip(passages.search(raw_column(batch, "text")), old):
                    n_words.append(count)
                    spans.append(_merged(s, found))
                    items.append(sorted(names.union(i)))
                columns = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], names=batch.schema.names)

        current = current.mapInArrow(run, f"doc_id {kind}, text string, {_FOUND}")
    if passages is None:
        current = current.withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z[^\x00-\x7F]]+")).cast("long"))
    return current.drop("text")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _cut(text: bytes, spans: list[dict]) -> bytes:
    at = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for span in spans:
        kept.append(text[last : at[span["first"]][0]])
        last = at[span["end"] - 1][1]
    return b"".join([*kept, text[last:]])


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with all columns, texts without the merged spans. No window is left in a
    text, also none that a cut brings together. Texts without a hit, nulls among them, stay
    as they are. The spans of all blocks are merged before a cut, and what was cut is
    searched for all blocks again, so blocks do not show in the result.
    """
    current, made = docs, []
    names, marks = docs.columns, unused(docs, "_spans")
    place = names.index("text")
    marked = StructType([*docs.schema.fields, StructField(marks, _SPANS_TYPE)])
    first = list(islice(blocks(benchmark, window), 2))
    if len(first) < 2:
        for passages in first:

            def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts = raw_column(batch, "text")
                    null = batch.column("text").is_null().to_pylist()
                    cut = [None if gone else passages.without(text, spans) for text, gone, (_, spans, _) in zip(texts, null, passages.search(texts))]
                    yield batch.set_column(place, batch.schema.field(place), pa.array(cut, pa.binary()).cast(batch.schema.field(place).type))

            current = current.mapInArrow(run, docs.schema)
        return current

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_cut(text, spans) for text, spans in zip(raw_column(batch, "text"), batch.column(marks).to_pylist())]
            out = batch.set_column(place, batch.schema.field(place), pa.array(left, pa.binary()).cast(batch.schema.field(place).type))
            yield out.select(names)

    del first
    while True:
        found = current.withColumn(marks, F.array().cast(_SPANS_TYPE))
        for passages in blocks(benchmark, window):

            def search(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    old = batch.column(marks).to_pylist()
                    spans = [_merged(s, new) for s, (_, new, _) in zip(old, passages.search(raw_column(batch, "text")))]
                    yield batch.set_column(batch.num_columns - 1, marks, pa.array(spans, _SPANS))

            found = stage(found.mapInArrow(search, marked), "passages")
        made.append(found.where(F.size(marks) == 0).drop(marks))
        hit = found.where(F.size(marks) > 0)
        if hit.isEmpty():
            return reduce(DataFrame.unionByName, made)
        current = stage(hit.mapInArrow(cut, docs.schema), "cut")
