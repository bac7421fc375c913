"""A hierarchical Pitman-Yor language model (Teh, 2006), seated by Gibbs sampling.

Each context has a restaurant, and all share the parent restaurant of single words, over a
uniform base of the vocabulary and one unknown word. A context is the previous word itself,
or the begin of a text, and each has a restaurant of its own. Up to ``CONTEXTS`` frequent
ones are named by their place in a list that every task has, and their totals are sent with
it; all others are named by their hash, and their totals are summed and dealt out by joins.

Texts are coded once, in blocks. A block sends each word shard (a range of word hashes) its
words and their contexts, counted; a shard thus has all of a word's contexts. It samples
its seatings against the totals of all shards, with its own part kept up to date, and
answers the blocks with the terms of the predictive probability, averaged over samples. A
block puts them together for its texts. What is sent grows with the text, never the model
as a whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, stage
from .common import raw_column, remove, tokens

#: Contexts that are named by their place in a list, and how often a block must have a word for that.
CONTEXTS = 1 << 18
LISTED_COUNT = 4
BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 500_000
SWEEPS, KEPT_SWEEPS = 6, 4
#: Strengths of the context restaurants and of their parent.
STRENGTH, PARENT_STRENGTH = 5.0, 20.0
#: Customers of a party that are seated one by one; later ones in groups that double.
ONE_BY_ONE = 8
_END, _BEGIN = 0, 1
#: What a block sends a shard: its words, how many contexts each has, these as places in the list,
#: the hashes of those that are not listed, and the counts of the pairs.
REQUESTED = ("words", "sizes", "contexts", "rare", "counts")


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_places(values: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, of which the high ones hold little."""
    return _pack(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _word_hash(word: bytes) -> int:
    """64 bits; 0 and 1 stand for the end and the begin of a text."""
    value = xxhash.xxh64_intdigest(word)
    return value if value > 1 else value + 2


def _coded(docs: DataFrame, trains: Column) -> DataFrame:
    """Blocks of whole texts: ids, tokens per text, the hashes of the block's words in rising
    order, and the texts as places in them, one after the other with an end for each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), trains.alias("trains"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = count(task << 32)
        schema = None

        def block(ids, flags, sizes, streams, seen) -> pa.RecordBatch:
            hashes = np.fromiter((_END if w is None else _word_hash(w) for w in seen), np.uint64, len(seen))
            words, place = np.unique(hashes, return_inverse=True)
            stream = place[np.concatenate(streams)]
            arrays = [
                pa.array([next(number)], pa.int64()), pa.array([pa.array(ids, schema).to_pylist()], pa.list_(schema)),
                pa.array([flags], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(stream)], pa.int64()),
                pa.array([_pack(words)], pa.binary()), pa.array([_pack_places(stream)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "trains", "sizes", "n_tokens", "words", "stream"])

        def fresh():
            seen: defaultdict = defaultdict(count().__next__)
            return [], [], [], [], seen

        ids, flags, sizes, streams, seen = fresh()
        held = 0
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for doc_id, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("trains").to_pylist(), raw_column(batch, "text")):
                found = [*tokens(text), None]
                ids.append(doc_id)
                flags.append(flag)
                sizes.append(len(found))
                streams.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield block(ids, flags, sizes, streams, seen)
                    ids, flags, sizes, streams, seen = fresh()
                    held = 0
        if ids:
            yield block(ids, flags, sizes, streams, seen)

    return source.mapInArrow(run, f"block long, ids array<{kind}>, trains array<boolean>, sizes array<int>, n_tokens long, words binary, stream binary")


@dataclass
class _Pairs:
    """A block's distinct (word, previous word) pairs in order, and which one each token is.
    Words are places in the block's words; the begin of a text is the place after them."""

    word: np.ndarray
    before: np.ndarray
    of_token: np.ndarray
    counts: np.ndarray


def _pairs(words: int, stream: bytes, sizes: np.ndarray, trains: np.ndarray) -> _Pairs:
    place = _unpack_places(stream)
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = words
    key, of_token = np.unique(place * (words + 1) + before, return_inverse=True)
    learned = np.repeat(np.asarray(trains, bool), sizes)
    counts = np.bincount(of_token[learned], minlength=len(key))
    return _Pairs(key // (words + 1), key % (words + 1), of_token, counts)


@dataclass
class _Book:
    """Listed contexts: their hashes in rising order, and each one's number."""

    hashes: np.ndarray
    number: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers; ``CONTEXTS`` for what is not listed."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], CONTEXTS)


def _listed(blocks: DataFrame) -> _Book:
    """The begin and the most frequent words, ``CONTEXTS`` at most, numbered by frequency, as small
    numbers take little space. What is listed changes how a context is sent, not what is learnt of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack(row["words"], np.uint64)
                counts = np.bincount(_unpack_places(row["stream"]), minlength=len(words))
                often = np.flatnonzero((counts >= LISTED_COUNT) & (words > _BEGIN))
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], names=["word", "n"])

    counted = blocks.select("words", "stream").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "word").limit(CONTEXTS - 1).select("word").toPandas()["word"].to_numpy(np.int64)
    hashes = np.r_[np.array([_BEGIN], np.uint64), found.view(np.uint64)]
    order = np.argsort(hashes)
    return _Book(hashes[order], order)


def _borders(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins and ends in the sorted words."""
    limits = [(s << 64) // shards for s in range(1, shards)]
    return np.r_[0, np.searchsorted(words, np.array(limits, np.uint64)), len(words)]


def _requests(blocks: DataFrame, shards: int, book: _Book) -> DataFrame:
    """One row per block and shard that the block has words of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack(row["words"], np.uint64)
                p = _pairs(len(words), row["stream"], np.array(row["sizes"]), np.array(row["trains"]))
                context = np.r_[words, np.array([_BEGIN], np.uint64)]
                listed = book.of(context)
                edge = _borders(words, shards)
                pair_edge = np.searchsorted(p.word, edge)
                size = np.bincount(p.word, minlength=len(words))
                used = np.flatnonzero(np.diff(edge))
                columns: dict[str, list] = {n: [] for n in REQUESTED}
                for s in used:
                    a, b, c, d = edge[s], edge[s + 1], pair_edge[s], pair_edge[s + 1]
                    columns["words"].append(words[a:b].tobytes())
                    columns["sizes"].append(_pack_places(size[a:b]))
                    at = listed[p.before[c:d]]
                    columns["contexts"].append(_pack_places(at))
                    columns["rare"].append(_pack(context[p.before[c:d][at == CONTEXTS]]))
                    columns["counts"].append(_pack(p.counts[c:d].astype(np.uint32)))
                arrays = [pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.int64()), *[pa.array(v, pa.binary()) for v in columns.values()]]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", *columns])

    return blocks.select("block", "words", "stream", "sizes", "trains").mapInArrow(run, "shard int, block long, " + ", ".join(f"{n} binary" for n in REQUESTED))


@dataclass
class Shard:
    """All requests of one shard, and their words and pairs put together."""

    blocks: list[int]
    requested: list[np.ndarray]
    pair_places: list[np.ndarray]
    words: np.ndarray
    counts: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pair_counts: np.ndarray
    #: Hashes of the contexts that are not listed; the first has the number ``CONTEXTS``.
    rare: np.ndarray

    @classmethod
    def of(cls, rows: list[dict]) -> Shard:
        rows = sorted(rows, key=lambda r: r["block"])
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        every = np.unique(np.concatenate(words))
        requested = [np.searchsorted(every, w) for w in words]
        unlisted = [_unpack(r["rare"], np.uint64) if "rare" in r else np.array([], np.uint64) for r in rows]
        rare = np.unique(np.concatenate(unlisted))
        width = CONTEXTS + len(rare)
        keys = []
        for at, r, names in zip(requested, rows, unlisted):
            if "rare" in r:
                sizes, contexts = _unpack_places(r["sizes"]), _unpack_places(r["contexts"])
                contexts[contexts == CONTEXTS] = CONTEXTS + np.searchsorted(rare, names)
            else:  # listed contexts only
                sizes, contexts = _unpack(r["sizes"], np.uint16), _unpack(r["contexts"], np.uint16)
            keys.append(np.repeat(at, sizes) * width + contexts)
        pairs, places = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(places, np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]), minlength=len(pairs)).astype(np.int64)
        word = pairs // width
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return cls([r["block"] for r in rows], requested, np.split(places, cuts), every, np.bincount(word, counts, minlength=len(every)).astype(np.int64), word, pairs % width, counts, rare)


@dataclass
class Totals:
    """What is known of all shards together; arrays have one place per context."""

    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    parent_discount: float = 0.5
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    #: Customers and tables of the parent.
    parent_customers: float = 0.0
    parent_tables: float = 0.0


def seat(parties: np.ndarray, newcomer: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables that parties of these sizes take, each for one dish. After i customers at t
    tables the next opens a table with odds ``newcomer`` to i - discount t.
    """
    tables = np.minimum(parties, 1).astype(np.float64)
    at = np.flatnonzero(parties > 1)
    done = 1
    while len(at):
        group = 1 if done < ONE_BY_ONE else done
        size = np.minimum(parties[at] - done, group)
        middle = done + (size - 1) / 2
        weight = newcomer[at]
        chance = weight / (weight + np.maximum(middle - discount * tables[at], 1e-9))
        tables[at] += draw.binomial(size, np.clip(chance, 0, 1))
        done += group
        at = at[parties[at] > done]
    return tables


def sample(shard: Shard, totals: Totals, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Averages over the kept sweeps: per pair its count less its discounted tables, per word
    the same in the parent, tables per context, and customers and tables of the parent.
    """
    draw = np.random.default_rng(seed)
    held = np.flatnonzero(shard.pair_counts)
    n, word, context = shard.pair_counts[held], shard.word[held], shard.context[held]
    d, e = totals.discount, totals.parent_discount
    tables = np.ones(len(held))
    size = len(shard.words)
    known = np.bincount(word, tables, minlength=size)
    parent_tables = np.minimum(known, 1)
    # totals were taken with one table per pair and word, as here at the start
    contexts = len(totals.tables)
    others = totals.tables - np.bincount(context, tables, minlength=contexts)
    other_customers, other_tables = totals.parent_customers - tables.sum(), totals.parent_tables - parent_tables.sum()
    sums = [np.zeros(len(shard.word)), np.zeros(size), np.zeros(contexts), 0.0, 0.0]
    for sweep in range(SWEEPS):
        customers, opened = other_customers + known.sum(), other_tables + parent_tables.sum()
        base = (PARENT_STRENGTH + e * opened) / (totals.words + 1)
        parent = (known - e * parent_tables + base) / (PARENT_STRENGTH + customers)
        at_context = others + np.bincount(context, tables, minlength=contexts)
        tables = seat(n, (STRENGTH + d * at_context[context]) * parent[word], d, draw)
        known = np.bincount(word, tables, minlength=size)
        parent_tables = seat(known.astype(np.int64), np.full(size, base), e, draw)
        if sweep >= SWEEPS - KEPT_SWEEPS:
            sums[0][held] += n - d * tables
            sums[1] += known - e * parent_tables
            sums[2] += np.bincount(context, tables, minlength=contexts)
            sums[3] += known.sum()
            sums[4] += parent_tables.sum()
    return tuple(x / KEPT_SWEEPS for x in sums)


def parent_probability(weight: np.ndarray, totals: Totals) -> np.ndarray:
    """Of words with these discounted customers in the parent; 0 is the unknown word's."""
    base = (PARENT_STRENGTH + totals.parent_discount * totals.parent_tables) / (totals.words + 1)
    return (weight + base) / (PARENT_STRENGTH + totals.parent_customers)


def probability(weight: np.ndarray, context: np.ndarray, parent: np.ndarray, totals: Totals) -> np.ndarray:
    """Of words with these discounted counts in these contexts and probabilities in the parent."""
    back = STRENGTH + totals.discount * totals.tables[context]
    return (weight + back * parent) / (STRENGTH + totals.customers[context])


def _merged(requests: DataFrame) -> DataFrame:
    """One row per shard: its requests, and the counts that the totals are made of."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("block").to_dict("records")
        s = Shard.of(rows)
        learned = s.pair_counts > 0
        contexts = np.bincount(s.word[learned], minlength=len(s.words))
        width = CONTEXTS + len(s.rare)
        tables = np.bincount(s.context[learned], minlength=width)
        # only parties of two or more open tables by chance, so only their contexts need the other shards' tables
        asks = np.bincount(s.context[s.pair_counts > 1], minlength=width)[CONTEXTS:] > 0
        made = {name: [[r[name] for r in rows]] for name in ("block", *REQUESTED)}
        made |= {
            "shard": [int(group["shard"].iloc[0])], "tokens": [int(s.counts.sum())], "known": [int((s.counts > 0).sum())],
            "once": [int((s.pair_counts == 1).sum())], "twice": [int((s.pair_counts == 2).sum())],
            "word_once": [int((contexts == 1).sum())], "word_twice": [int((contexts == 2).sum())], "pairs": [int(learned.sum())],
            **_sparse(tables[:CONTEXTS]), "unlisted": [s.rare.view(np.int64).tolist()], "unlisted_tables": [tables[CONTEXTS:].tolist()], "asks": [asks.tolist()],
        }
        return pd.DataFrame(made)

    schema = (
        "shard int, block array<long>, " + ", ".join(f"{n} array<binary>" for n in REQUESTED) + ", tokens long, known long, once long, twice long, "
        "word_once long, word_twice long, pairs long, listed array<int>, tables array<double>, unlisted array<long>, unlisted_tables array<double>, asks array<boolean>"
    )
    # as many partitions as buckets, so that each bucket is one file
    dealt = requests.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return dealt.groupBy("shard").applyInPandas(run, schema)


def _by_shard(merged: DataFrame) -> tuple[DataFrame, str, str]:
    """A stored table in buckets of shards, which is joined by shard without moving it; its name and path."""
    spark = merged.sparkSession
    path = fresh_path(spark, "shards")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    merged.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def _sparse(tables: np.ndarray) -> dict[str, list]:
    """The listed contexts that have tables, and those."""
    at = np.flatnonzero(tables)
    return {"listed": [at.tolist()], "tables": [tables[at].astype(float).tolist()]}


def _of_listed(rows: DataFrame) -> np.ndarray:
    """Tables of the listed contexts, summed over the rows: ``CONTEXTS`` numbers. A task adds up
    its rows and sends the sums in ranges."""
    schema, size = "range int, sums binary", 4_096

    def batch_of(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(v) for v in sums.values()], pa.binary())], names=["range", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS)
        for batch in batches:
            for at, tables in zip(batch.column("listed"), batch.column("tables")):
                total[np.asarray(at.values)] += np.asarray(tables.values)
        parts = total.reshape(-1, size)
        yield batch_of({int(i): parts[i] for i in np.flatnonzero(parts.any(axis=1))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sums[row["range"]] = sums.get(row["range"], 0.0) + _unpack(row["sums"], np.float64)
        yield batch_of(sums)

    out = np.zeros((CONTEXTS // size, size))
    summed = rows.select("listed", "tables").mapInArrow(partial, schema).repartition("range").mapInArrow(added, schema)
    for row in summed.collect():  # a row per range
        out[row["range"]] = _unpack(bytes(row["sums"]), np.float64)
    return out.ravel()


def _of_unlisted(rows: DataFrame, *more: str) -> DataFrame:
    """(context, tables, more): a row per row and context that is not listed."""
    zipped = F.explode(F.arrays_zip("unlisted", "unlisted_tables", *[m for m in more if m != "shard"])).alias("v")
    return rows.select(*[m for m in more if m == "shard"], zipped).select(
        F.col("v.unlisted").alias("context"), F.col("v.unlisted_tables").alias("tables"), *[m if m == "shard" else f"v.{m}" for m in more]
    )


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, context, tables) as two arrays per key."""
    return rows.groupBy(key).agg(F.collect_list(F.struct("context", "tables")).alias("_l")).select(
        key, F.col("_l.context").alias("unlisted"), F.col("_l.tables").alias("unlisted_tables")
    )


def _asked_tables(merged: DataFrame) -> DataFrame:
    """Per shard the tables of all shards at the contexts that it asks for."""
    here = _of_unlisted(merged, "shard", "asks").withColumn("tables", F.sum("tables").over(Window.partitionBy("context")))
    return _gathered(here.where("asks"), "shard")


def _block_tables(blocks: DataFrame, ends: DataFrame, book: _Book) -> DataFrame:
    """Per block the places and averaged tables of its words that are not listed, where they are more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack(row["words"], np.uint64)
                place = np.flatnonzero((book.of(words) == CONTEXTS) & (words != _END))
                arrays = [pa.array(np.full(len(place), row["block"], np.int64)), pa.array(words[place].view(np.int64)), pa.array(place.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "context", "place"])

    asked = blocks.select("block", "words").mapInArrow(run, "block long, context long, place long")
    summed = _of_unlisted(ends).groupBy("context").agg(F.sum("tables").alias("tables")).where("tables > 1")
    return _gathered(asked.join(summed, "context").select("block", F.col("place").alias("context"), "tables"), "block")


def _texts(blocks: DataFrame, book: _Book) -> DataFrame:
    """The blocks' texts, with what their words and the begin are in the list instead of the words."""
    kept = blocks.select("block", "ids", "trains", "sizes", "stream")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [_pack_places(book.of(np.r_[_unpack(w.as_py(), np.uint64), np.array([_BEGIN], np.uint64)])) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(listed, pa.binary())], names=[*names, "listed"])

    return blocks.select(*names, "words").mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("listed", T.BinaryType())]))


def _first_totals(merged: DataFrame) -> Totals:
    names = ("tokens", "known", "once", "twice", "word_once", "word_twice", "pairs")
    row = {k: v or 0 for k, v in merged.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}

    def discount(once: int, twice: int) -> float:
        return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5

    return Totals(
        row["tokens"], row["known"], discount(row["once"], row["twice"]), discount(row["word_once"], row["word_twice"]),
        np.zeros(CONTEXTS), _of_listed(merged), float(row["pairs"]), float(row["known"]),
    )


def _replies(merged: DataFrame, begun: DataFrame, totals: Totals) -> DataFrame:
    """Per block and shard the terms for what the block asked; in one more row per shard
    (without a block) its averaged tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = zip(row["block"], *(row[n] for n in REQUESTED))
                s = Shard.of([dict(zip(("block", *REQUESTED), r)) for r in asked])
                unlisted = np.bincount(s.context[s.pair_counts > 0], minlength=CONTEXTS + len(s.rare))[CONTEXTS:].astype(float)
                unlisted[np.searchsorted(s.rare, np.array(row["unlisted"] or [], np.int64).view(np.uint64))] = row["unlisted_tables"] or []
                pairs, parent, tables, customers, opened = sample(s, replace(totals, tables=np.r_[totals.tables, unlisted]), row["shard"])
                pairs, parent = pairs.astype(np.float32), parent.astype(np.float32)
                n = len(s.blocks)
                arrays = [
                    pa.array([*s.blocks, None], pa.int64()), pa.array([row["shard"]] * (n + 1), pa.int32()),
                    pa.array([*[_pack(s.counts[at]) for at in s.requested], None], pa.binary()),
                    pa.array([*[_pack(parent[at]) for at in s.requested], None], pa.binary()),
                    pa.array([*[_pack(pairs[at]) for at in s.pair_places], None], pa.binary()),
                    *[pa.array([None] * n + v, pa.list_(t)) for v, t in zip(_sparse(tables[:CONTEXTS]).values(), (pa.int32(), pa.float64()))],
                    pa.array([None] * n + [s.rare.view(np.int64)], pa.list_(pa.int64())), pa.array([None] * n + [tables[CONTEXTS:]], pa.list_(pa.float64())),
                    pa.array([None] * n + [customers], pa.float64()), pa.array([None] * n + [opened], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "shard", "counts", "parent", "pairs", "listed", "tables", "unlisted", "unlisted_tables", "customers", "opened"])

    asked = merged.select("shard", "block", *REQUESTED).join(begun, "shard", "left")
    return asked.mapInArrow(
        run, "block long, shard int, counts binary, parent binary, pairs binary, listed array<int>, tables array<double>, unlisted array<long>, unlisted_tables array<double>, customers double, opened double"
    )


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    Learns from the rows where ``trains`` holds and scores all. A null text is one end. With
    nothing to learn from every word is the unknown one, of probability 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = stage(_coded(docs, F.coalesce(trains, F.lit(False))), "blocks")
    shards = int((blocks.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS + 1)
    book = _listed(blocks)
    merged, name, merged_path = _by_shard(_merged(_requests(blocks, shards, book)))
    totals = _first_totals(merged)
    begun = stage(_asked_tables(merged), "tables")
    replies = stage(_replies(merged, begun, totals), "replies")
    docs.sparkSession.sql(f"DROP TABLE {name}")  # nothing reads the requests any more
    remove(docs.sparkSession, merged_path)
    ends = replies.where("block IS NULL")
    row = ends.agg(F.sum("customers"), F.sum("opened")).first()
    totals.tables, totals.parent_customers, totals.parent_tables = _of_listed(ends), row[0] or 0.0, row[1] or 0.0

    def put_together(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        sizes = np.array(b["sizes"], np.int64)
        listed = _unpack_places(b["listed"])
        p = _pairs(len(listed) - 1, b["stream"], sizes, np.array(b["trains"]))
        tables = np.r_[totals.tables, 0.0][listed]
        for _, r in answers[answers["shard"].isna()].iterrows():
            tables[np.asarray(r["unlisted"], np.int64)] = r["unlisted_tables"]
        answers = answers[answers["shard"].notna()].sort_values("shard")
        counts, parent, pairs = (np.concatenate([_unpack(x, k) for x in answers[name]]) for name, k in (("counts", np.int64), ("parent", np.float32), ("pairs", np.float32)))
        lone = np.flatnonzero((listed[:-1] == CONTEXTS) & (tables[:-1] == 0))
        tables[lone] = np.minimum(counts[lone], 1)  # one table, if the context was learnt
        in_parent = parent_probability(parent.astype(np.float64), totals)
        # a word is followed as often as it occurs, and a text begins as often as one ends
        at_context = replace(totals, customers=np.r_[counts, counts[0]].astype(float), tables=tables)
        logs = np.log10(probability(pairs.astype(np.float64), p.before, in_parent[p.word], at_context))
        plain = np.log10((counts + 1) / (totals.tokens + totals.words + 1))
        starts = np.cumsum(sizes) - sizes
        word = p.word[p.of_token]
        return pd.DataFrame({
            "doc_id": pd.Series(list(b["ids"]), dtype=object), "n_tokens": sizes, "n_known": np.add.reduceat((counts[word] > 0).astype(np.int64), starts),
            "train_tokens": totals.tokens, "base_score": np.add.reduceat(plain[word], starts), "score": np.add.reduceat(logs[p.of_token], starts),
        })

    made = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = replies.where("block IS NOT NULL").select("block", "shard", "counts", "parent", "pairs").unionByName(_block_tables(blocks, ends, book), allowMissingColumns=True)
    return _texts(blocks, book).groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(put_together, made)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity``: ten to the negative mean log probability of the tokens."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
