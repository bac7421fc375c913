"""SimHash fingerprints and near-duplicate classes.

Fingerprints that differ in at most two bits are linked. Cut into two halves of 32
bits, such a pair differs by at most one bit in one half. So each half is indexed under
its 32 one-wildcard variants (one bit cleared), variants meet in an equality join, and
the candidates are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import map_texts, tokens
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
#: Two bits at most: the halves and their one-wildcard variants are made for this distance.
DISTANCE = 2
#: A bucket of more fingerprints is linked through stars instead of pairs; both are exact.
PAIRED_BUCKET = 64
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the 64-bit hashes have it; of none 0."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half the shingle hashes have it."""
    parts = tokens(raw)
    if not parts:
        return 0
    if len(parts) < SHINGLE_WORDS:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(parts, parts[1:], parts[2:])))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp long)``, one row per input row; a null or empty text has 0."""

    def run(texts: list[bytes]) -> dict:
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {"fp": (pa.int64(), values)}

    return map_texts(docs, run, "fp long")


def _variants(classes: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 keys: half, cleared bit, and the half without that bit."""
    return (
        classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        .withColumn("half", F.expr("shiftrightunsigned(fp, 32 * shiftright(i, 5)) & 4294967295L"))
        .select("fp", F.expr("(half & ~shiftleft(1L, i & 31)) | shiftleft(CAST(i AS BIGINT), 32)").alias("key"))
    )


def _star_links(members: DataFrame) -> DataFrame:
    """Exact links of fingerprints in crowded buckets, without pairs: any two that agree
    after the same two bits are cleared differ in two bits at most, so each is tied to the
    smallest of them. 2,016 keys per fingerprint, whatever the size of the group.
    """
    cleared = np.array([(1 << a) | (1 << b) for a in range(64) for b in range(a)], np.uint64)
    masks = F.array(*[F.lit(int(m)) for m in (~cleared).view(np.int64)])
    keyed = members.select("fp", F.posexplode(masks).alias("n", "mask")).select("fp", "n", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    centre = keyed.groupBy("n", "key").agg(F.min("fp").alias("c"), F.max("fp").alias("top")).where("c != top")
    return keyed.join(centre, ["n", "key"]).where("fp != c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct()


def links(classes: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints ``fp`` at distance 1 or 2, enough of them
    to connect every linked pair; buckets of at most ``PAIRED_BUCKET`` give all theirs.
    """
    same = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = stage(_variants(classes).withColumn("size", same).where("size > 1"), "buckets")
    small = shared.where(F.col("size") <= PAIRED_BUCKET)
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    hot = shared.where(F.col("size") > PAIRED_BUCKET).select("fp").distinct()
    if hot.isEmpty():
        return pairs.distinct()
    return pairs.unionByName(_star_links(hot)).distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the row's own
    included. Copies share a fingerprint and meet as one class, so their pairs are never
    formed. Rows whose class holds only null ids get null; an empty table gives none.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(links(classes).select(F.col("a").alias("u"), F.col("b").alias("v")))
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose class has no smaller id; of rows with the same id one
    stays, rows without an id all stay."""
    classed = near_duplicate_classes(docs.where("doc_id IS NOT NULL"))
    kept = classed.where("doc_id = component_id").select("doc_id").distinct()
    unique = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return unique.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
