"""Near copies by the Jaccard similarity of their five-word shingles, all of them.

SimHash comes first: sets whose fingerprints differ in two bits at most, found by the
one-wildcard variants of ``simhash``, are verified on the whole sets and linked. At a
similarity of 4/5 about 10 of 64 bits differ, more than any selective segment of them
allows, so what the fingerprints leave open goes through an exact index. Two sets of n and m shingles with a similarity of 4/5 or more share one among the first
n - ceil(4n/5) + 1 of the one and the first m - ceil(4m/5) + 1 of the other, in any order
that holds for all shingles. So these few are indexed, sets meet in an equality join and
each candidate that the fingerprints have not linked yet is verified as well. The order puts shingles that are frequent in
a sample last, by their frequency; what it is changes the work, not the result. Hashes of 64 bits stand for
shingles and for sets.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import simhash
from .common import map_texts, remove, tokens, written
from .components import connected_components

SHINGLE_WORDS = 5
#: Least similarity of a near copy, as a fraction.
SHARE, OF = 4, 5
#: What the sizes of a pair must meet, and the places of a shingle that both have. A pair
#: shares ``o`` shingles or more; the first of these has ``o`` - 1 behind it on either side.
NEAR = f"{OF} * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)"
_LEAST = f"(({SHARE} * (n_a + n_b) + {SHARE + OF - 1}) div {SHARE + OF})"
FITS = f"place_a <= n_a - {_LEAST} AND place_b <= n_b - {_LEAST}"
MEETS = f"{NEAR} AND {FITS}"
#: Members of a bucket that are all compared with each other; larger buckets go by centres.
PAIRED_BUCKET = 64
#: One in so many documents, or this many of a smaller table, tell which shingles are
#: frequent; so many of these are put last, 1.6 MB.
EVERY, SAMPLE, FREQUENT = 16, 4000, 200_000


def shingle_set(raw: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words, in rising order; a shorter text is one run."""
    parts = tokens(raw)
    if not parts:
        return np.empty(0, np.uint64)
    runs = list(map(b" ".join, zip(*[parts[i:] for i in range(SHINGLE_WORDS)]))) or [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(0)), np.uint64, len(runs)))


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


class Frequent:
    """Shingles that are frequent in a sample; the more frequent stand further back."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        self.rank = np.empty(len(keys), np.int64)
        self.rank[np.lexsort((self.keys, counts[by_key]))] = np.arange(len(keys))

    def in_order(self, shingles: np.ndarray) -> np.ndarray:
        """The order that holds for all sets: what is not frequent, by its hash, then the frequent."""
        if not len(self.keys):
            return shingles
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        last = self.keys[at] == shingles
        return np.concatenate([shingles[~last], shingles[last][np.argsort(self.rank[at[last]])]])


def prefix(shingles: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The first shingles, of which near copies share one."""
    size = len(shingles) - (SHARE * len(shingles) + OF - 1) // OF + 1 if len(shingles) else 0
    return frequent.in_order(shingles)[:size]


def _longs(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, shingles)``, one row per input row."""

    def run(texts: list[bytes]) -> dict:
        made = [shingle_set(t) for t in texts]
        return {"name": (pa.int64(), _names(made)), "shingles": (pa.list_(pa.int64()), _longs(made))}

    return map_texts(docs, run, "name long, shingles array<bigint>")


def _frequent(docs: DataFrame) -> Frequent:
    step = min(EVERY, docs.count() // SAMPLE + 1)
    counted = _sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)).select(F.explode("shingles").alias("s")).groupBy("s").count()
    rows = counted.where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    return Frequent(rows.column("s").to_numpy().view(np.uint64), rows.column("count").to_numpy())


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, name)`` of all rows, and of each distinct set its size, smallest id, fingerprint and prefix."""
    frequent = _frequent(docs)

    def run(texts: list[bytes]) -> dict:
        made = [shingle_set(t) for t in texts]
        return {
            "name": (pa.int64(), _names(made)), "n": (pa.int32(), [len(s) for s in made]),
            "fp": (pa.int64(), np.array([simhash.majority(s) for s in made], np.uint64).view(np.int64)),
            "prefix": (pa.list_(pa.int64()), _longs([prefix(s, frequent) for s in made])),
        }

    prints = stage(map_texts(docs, run, "name long, n int, fp long, prefix array<bigint>"), "prints")
    classes = prints.groupBy("name").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix")])
    return prints.select("doc_id", "name"), stage(classes, "classes")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` of names, the lesser first."""
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(members: DataFrame, side: str, *more: str) -> DataFrame:
    return members.select("key", F.col("name").alias(side), F.col("n").alias(f"n_{side}"), F.col("place").alias(f"place_{side}"), *more)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""
    pairs, at_pairs = written(pairs, "candidates")
    names = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct()
    wanted, at_wanted = written(classes.select("name", "least").join(names, "name", "left_semi"), "wanted")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # an id may have several texts, so the names decide
    sets = _sets(texts).join(wanted.select("name"), "name", "left_semi").select("name", "shingles").dropDuplicates(["name"])
    sets, at_sets = written(sets, "sets")
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    found = stage(both.where((SHARE + OF) * shared >= SHARE * (F.size("s_a") + F.size("s_b"))).select("a", "b"), "links")
    for path in (at_pairs, at_wanted, at_sets):
        remove(docs.sparkSession, path)
    return found


def fingerprint_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)``: sets with the similarity whose fingerprints differ in two bits at most. Each
    set is tried with the least set of its fingerprint, and the least sets of linked ones
    with each other, so sets that share a fingerprint give no pairs."""
    centres = stage(classes.groupBy("fp").agg(F.min("name").alias("centre")), "centres")
    same = classes.join(centres, "fp").select(F.col("name").alias("a"), F.col("centre").alias("b"))
    near = simhash.links(centres.select("fp"))
    for side in "ab":
        near = near.join(centres.select(F.col("fp").alias(side), F.col("centre").alias(f"centre_{side}")), side)
    return _verified(docs, classes, _ordered(same.unionByName(near.select(F.col("centre_a").alias("a"), F.col("centre_b").alias("b")))))


def _with_roots(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """``classes`` with ``root``, the least of a set and those linked to it. Sets with the
    same root are connected."""
    around = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("root"))
    return classes.join(least, "name", "left").withColumn("root", F.least("name", "root"))


def _crowded_pairs(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """What the centres left: pairs of a bucket that are not connected yet. All but the
    members of its largest component meet those members of other components whose places
    allow it; texts that only share a passage have it at the end and do not meet."""
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("name"), F.col("component").alias("root"))
    members = stage(crowded.drop("root").join(found, "name", "left").select("key", "name", "n", "place", F.coalesce("root", "name").alias("root")), "members")
    largest = members.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = members.join(largest, "key")
    outside = _side(open_.where("root != most").withColumn("root_a", F.col("root")), "a", "root_a", "most")
    return _ordered(outside.join(_side(open_.withColumn("root_b", F.col("root")), "b", "root_b"), "key").where(f"root_a != root_b AND (root_b = most OR a < b) AND {MEETS}"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of sets with the similarity, enough to connect all such pairs."""
    linked = fingerprint_links(docs, classes)
    same = F.count(F.lit(1)).over(Window.partitionBy("key"))
    placed = _with_roots(classes, linked).select("name", "n", "root", F.posexplode("prefix").alias("place", "key"))
    shared, at_shared = written(placed.withColumn("size", same).where("size > 1"), "buckets")
    small, crowded = (shared.where(F.col("size") <= PAIRED_BUCKET), shared.where(F.col("size") > PAIRED_BUCKET))
    left, right = (F.col("root").alias(f"root_{side}") for side in "ab")
    met = _side(small, "a", left).join(_side(small, "b", right), "key").where(f"a < b AND root_a != root_b AND {NEAR}")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.bool_or(F.expr(FITS)).alias("fits"))
    # Two centres for each crowded bucket, mostly the same ones in all buckets of a group. A
    # copy's own changes are rare and come first in its prefix; the text that the others were
    # made from has none, so it is the one in most crowded buckets.
    most = crowded.groupBy("name").agg(F.count(F.lit(1)).alias("m"))
    # what a pair may share besides: in crowded buckets, which are not paired, and beyond both
    # prefixes the rest of the one that ends first
    for side in "ab":
        pairs = pairs.join(most.select(F.col("name").alias(side), F.col("m").alias(f"m_{side}")), side, "left")
    rest = f"greatest(({SHARE} * n_a + {OF - 1}) div {OF}, ({SHARE} * n_b + {OF - 1}) div {OF}) - 1"
    reach = f"{SHARE + OF} * (c + least(coalesce(m_a, 0L), coalesce(m_b, 0L)) + {rest}) >= {SHARE} * (n_a + n_b)"
    # in crowded buckets alone the pair may fit too, so only pairs without any must fit here
    pairs = pairs.where(f"{reach} AND (fits OR (m_a > 0 AND m_b > 0))").select("a", "b")
    centre = F.array(F.max(F.struct("m", "name", "n", "place", "root")).dropFields("m"), F.min(F.struct(F.xxhash64("name"), "name", "n", "place", "root")).dropFields("col1"))
    centres = crowded.join(most, "name").groupBy("key").agg(F.explode(F.array_distinct(centre)).alias("c")).select("key", "c.*")
    stars = _side(crowded, "a", left).join(_side(centres, "b", right), "key").where(f"root_a != root_b AND {MEETS}")
    found = linked.unionByName(_verified(docs, classes, _ordered(pairs.unionByName(stars.select("a", "b")))))
    if not crowded.isEmpty():
        found = found.unionByName(_verified(docs, classes, _crowded_pairs(crowded, found)))
    remove(docs.sparkSession, at_shared)
    return found


def near_copy_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``, one row per input row: the smallest ``doc_id`` reachable
    over pairs of texts with the similarity, the row's own included."""
    prints, classes = _classes(docs)
    found = connected_components(links(docs, classes).select(F.col("a").alias("u"), F.col("b").alias("v")))
    member = classes.select("name", "least").join(found.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("component", "name").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("name", "component_id")
    return prints.join(named, "name").select("doc_id", "component_id")


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose class has no smaller id; of rows with the same id one
    stays, rows without an id all stay."""
    classed = near_copy_classes(docs.where("doc_id IS NOT NULL"))
    kept = classed.where("doc_id = component_id").select("doc_id").distinct()
    unique = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return unique.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
