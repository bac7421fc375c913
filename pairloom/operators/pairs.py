"""Pairs of observations inside a cluster: enumeration, kinds, capacity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import gap_bin
from ..functions.ids import unordered_pair_id
from ..functions.numbers import rounded_to
from .ordering import exact_quantiles

# Floor of the log ratio, and what counts as no camera motion.
RATIO_FLOOR = 1e-8
STILL_DISPLACEMENT = 1e-12
STILL_ROTATION = 1e-5


def log_ratio(a: Column, b: Column) -> Column:
    floor = F.lit(RATIO_FLOOR)
    return F.abs(F.ln(F.greatest(a.cast("double"), floor) / F.greatest(b.cast("double"), floor)))


def band_pairs(
    observations: DataFrame,
    low: int,
    high: int,
    carry: Sequence[str],
    cluster: str = "cluster_id",
    frame: str = "frame",
    key: str = "observation_id",
    hot_rows: int | None = 20_000,
    equal: Sequence[str] = (),
) -> DataFrame:
    """Pairs of one cluster whose frame gap lies in [low, high], earlier row first.

    ``equal`` names further columns both rows must share; they join the equi key.

    The equi key is (cluster, block of high-low+1 frames), so a long or hot
    cluster spreads over its blocks. A block above ``hot_rows`` rows is salted:
    its later rows are dealt over the salts and its earlier rows copied to each.
    """
    width = high - low + 1
    columns = [c for c in dict.fromkeys([key, frame, *carry]) if c not in equal]

    def side(suffix: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{suffix}") for c in columns]

    later = observations.select(
        cluster, *equal, *side("b"), F.floor(F.col(frame) / width).alias("_block")
    )
    reached = F.array_distinct(
        F.array(
            F.floor((F.col(frame) + low) / width), F.floor((F.col(frame) + high) / width)
        )
    )
    earlier = observations.select(cluster, *equal, *side("a"), F.explode(reached).alias("_block"))
    on = [cluster, *equal, "_block"]
    if hot_rows is not None:
        hot = (
            later.groupBy(*on)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > hot_rows)
            .select(*on, F.ceil(F.col("_rows") / hot_rows).alias("_salts"))
        )
        salts = F.coalesce("_salts", F.lit(1))
        later = (
            later.join(hot, on, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(f"{key}_b"), salts))
            .drop("_salts")
        )
        earlier = (
            earlier.join(hot, on, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
            .drop("_salts")
        )
        on = [*on, "_salt"]
    gap = F.col(f"{frame}_b") - F.col(f"{frame}_a")
    return (
        earlier.join(later.hint("merge"), on)
        .withColumn("gap", gap)
        .where(F.col("gap").between(low, high))
        .drop("_block", "_salt")
    )


def frame_cells(
    observations: DataFrame, attributes: Sequence[str],
    cluster: str = "cluster_id", frame: str = "frame",
) -> DataFrame:
    """Observation counts per (cluster, frame, attributes): what pair counting needs."""
    return observations.groupBy(cluster, frame, *attributes).agg(F.count(F.lit(1)).alias("cell_rows"))


def band_pair_counts(
    observations: DataFrame, low: int, high: int, attributes: Sequence[str],
    cluster: str = "cluster_id", frame: str = "frame",
) -> DataFrame:
    """Cells joined by gap with ``pairs`` = product of their counts.

    Counting needs no pair rows: a cluster with a third of all observations is
    reduced to at most frames x attribute values cells before the shuffle.
    """
    cells = frame_cells(observations, attributes, cluster, frame).withColumn(
        "_cell", F.xxhash64(cluster, frame, *attributes)
    )
    joined = band_pairs(cells, low, high, [*attributes, "cell_rows"], cluster, frame, "_cell")
    return joined.withColumn("pairs", F.col("cell_rows_a") * F.col("cell_rows_b")).drop(
        "_cell_a", "_cell_b", "cell_rows_a", "cell_rows_b"
    )


def cross_frame_capacity(
    observations: DataFrame, identity: str, category: str,
    cluster: str = "cluster_id", frame: str = "frame",
) -> DataFrame:
    """Unordered pairs of different frames per cluster, by relation, in closed form.

    n rows with f_t rows in frame t hold (n^2 - sum f_t^2) / 2 such pairs; the
    same holds inside an identity and inside a category.
    """
    cells = frame_cells(observations, [category, identity], cluster, frame)

    def capacity(keys: list[str], name: str) -> DataFrame:
        per_frame = cells.groupBy(cluster, *keys, frame).agg(F.sum("cell_rows").alias("f"))
        per_key = per_frame.groupBy(cluster, *keys).agg(
            F.sum("f").alias("n"), F.sum(F.col("f") * F.col("f")).alias("squares")
        )
        pairs = F.expr("(n * n - squares) div 2")
        return per_key.groupBy(cluster).agg(F.sum(pairs).alias(name))

    result = (
        capacity([], "all_pairs")
        .join(capacity([category], "category_pairs"), cluster)
        .join(capacity([category, identity], "positive_pairs"), cluster)
    )
    return result.select(
        cluster, "all_pairs", "positive_pairs",
        (F.col("category_pairs") - F.col("positive_pairs")).alias("same_category_pairs"),
        (F.col("all_pairs") - F.col("category_pairs")).alias("easy_pairs"),
    )


def kind_by_attributes(identity: str, attributes: Sequence[str]) -> Column:
    """positive = same identity; hard = all attributes equal; easy = the rest."""
    same = F.lit(True)
    for name in attributes:
        same = same & (F.col(f"{name}_a") == F.col(f"{name}_b"))
    return (
        F.when(F.col(f"{identity}_a") == F.col(f"{identity}_b"), "positive")
        .when(same, "hard")
        .otherwise("easy")
    )


def kind_by_scale(identity: str, category: str, ratio: Column, cutoff) -> Column:
    """Null for a same-category negative whose log ratio is above the cutoff."""
    return (
        F.when(F.col(f"{identity}_a") == F.col(f"{identity}_b"), "positive")
        .when(F.col(f"{category}_a") != F.col(f"{category}_b"), "easy")
        .when(ratio <= cutoff, "hard")
    )


def same_category_ratios(observations: DataFrame, low: int, high: int, identity: str, category: str, area: str,
                         digits: int = 9) -> DataFrame:
    """Log area ratios of same-category negatives: category joins the key, so no other pair is formed."""
    pairs = band_pairs(observations, low, high, [identity, area], equal=[category])
    ratio = rounded_to(log_ratio(F.col(f"{area}_a"), F.col(f"{area}_b")), digits)
    return pairs.where(F.col(f"{identity}_a") != F.col(f"{identity}_b")).select(ratio.alias("ratio"))


def scale_cutoff(ratios: DataFrame, probability: float = 0.25) -> float:
    """The observed train ratio at the "higher" quantile: one number, locked."""
    row = exact_quantiles(ratios, [], "ratio", {"cutoff": probability}, "higher").first()
    if row is None or row["cutoff"] is None:
        raise ValueError("train holds no same-category negative")
    return float(row["cutoff"])


def classified_pairs(pairs: DataFrame, kind: Column, key: str = "observation_id") -> DataFrame:
    """Add kind, label, difficulty (null for positives), gap bin and pair id; drop null kinds."""
    first, second = F.col(f"{key}_a"), F.col(f"{key}_b")
    return (
        pairs.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumns(
            {
                "label": F.when(F.col("kind") == "positive", 1).otherwise(0),
                "difficulty": F.when(F.col("kind") != "positive", F.col("kind")),
                "gap_bin": gap_bin(F.col("gap")),
                "pair_id": unordered_pair_id(first, second, "pair"),
            }
        )
    )


def relation_labels(identity: str, category: str, asset: str, dynamic: str) -> dict[str, Column]:
    """Category relation, asset relation and the sorted dynamic-static status."""
    a = {n: F.col(f"{n}_a") for n in (identity, category, asset, dynamic)}
    b = {n: F.col(f"{n}_b") for n in (identity, category, asset, dynamic)}
    one = a[identity] == b[identity]
    word = lambda side: F.when(side[dynamic], "dynamic").otherwise("static")
    return {
        "category_relation": F.when(one, "same_instance")
        .when(a[category] == b[category], "same_category")
        .otherwise("different_category"),
        "asset_relation": F.when(one, "same_instance")
        .when(a[asset] == b[asset], "same_asset_different_instance")
        .otherwise("different_asset"),
        "motion_status": F.concat_ws("-", F.array_sort(F.array(word(a), word(b)))),
    }


def suppress_still_rotation(displacement: Column, rotation: Column) -> Column:
    still = (displacement < STILL_DISPLACEMENT) & (F.abs(rotation) < STILL_ROTATION)
    return F.when(still, 0.0).otherwise(rotation)


def capacity_report(pairs: DataFrame, by: Sequence[Sequence[str]], weight: Column | None = None) -> DataFrame:
    """Pair counts for several groupings in one pass; absent keys read ``all``."""
    names = list(dict.fromkeys(n for group in by for n in group))
    counted = pairs.groupBy(*names).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    levels = F.explode(
        F.array(
            *[
                F.struct(*[(F.col(n) if n in group else F.lit("all")).alias(n) for n in names])
                for group in by
            ]
        )
    )
    return (
        counted.select(levels.alias("_g"), "_n")
        .select(*[F.col(f"_g.{n}").alias(n) for n in names], "_n")
        .groupBy(*names)
        .agg(F.sum("_n").alias("available"))
    )


def capacity_gate(available: DataFrame, targets: Mapping[tuple, int], keys: Sequence[str]) -> DataFrame:
    """Available against target with ratio and verdict; a missing pool counts as 0."""
    spark = available.sparkSession
    rows = [(*key, int(value)) for key, value in targets.items()]
    wanted = spark.createDataFrame(rows, ", ".join([*[f"{k} string" for k in keys], "target bigint"]))
    return (
        F.broadcast(wanted)
        .join(available, list(keys), "left")
        .select(
            *keys, "target", F.coalesce("available", F.lit(0)).alias("available"),
        )
        .withColumn("ratio", F.col("available") / F.col("target"))
        .withColumn("passed", F.col("available") >= F.col("target"))
    )


def contribution_summary(pairs: DataFrame, keys: Sequence[str], cap: int, cluster: str = "cluster_id") -> DataFrame:
    """Smallest, median and largest contribution of a cluster, and the cap check."""
    per_cluster = pairs.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("rows"))
    middle = exact_quantiles(per_cluster, keys, "rows", {"median_rows": 0.5}).drop("n")
    ends = per_cluster.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
    )
    return ends.join(middle, list(keys)).withColumn("within_cap", F.col("max_rows") <= cap)


def visibility_pair_counts(inventory: DataFrame, cells: str, threshold: int, low: int, high: int,
                           attributes: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """Candidate counts from visibility arrays (array per instance, one value per frame).

    Same-instance pairs are counted in both orders, pairs of two different
    instances once per ordered frame pair.
    """
    seen = (
        inventory.select(cluster, F.posexplode(cells).alias("instance", "_frames"), *attributes)
        .select(
            cluster, "instance",
            F.concat_ws("|", *[F.col(a)[F.col("instance")] for a in attributes]).alias("look"),
            F.posexplode("_frames").alias("frame", "visible"),
        )
        .where(F.col("visible") >= threshold)
    )
    pairs = band_pair_counts(seen, low, high, ["instance", "look"], cluster)
    same = F.col("instance_a") == F.col("instance_b")
    alike = ~same & (F.col("look_a") == F.col("look_b"))
    flat = [F.col("pairs")]
    if low == 0:
        raise ValueError("the smallest gap must be positive")
    counted = pairs.groupBy(cluster).agg(
        F.sum(F.when(same, 2 * flat[0]).otherwise(0)).alias("positive_pairs"),
        F.sum(F.when(alike, flat[0]).otherwise(0)).alias("hard_pairs"),
    )
    usable = seen.groupBy(cluster).agg(F.count(F.lit(1)).alias("usable_observations"))
    zero = F.lit(0).cast("bigint")
    return (
        inventory.select(cluster, F.size(cells).alias("instances"))
        .join(usable, cluster, "left")
        .join(counted, cluster, "left")
        .select(
            cluster, "instances",
            *[F.coalesce(c, zero).alias(c) for c in ("usable_observations", "positive_pairs", "hard_pairs")],
        )
    )


def pair_violations(pairs: DataFrame, cutoff: float) -> DataFrame:
    """``(split, rule, pair_id)``: every pair that breaks its definition, once per rule it breaks."""
    hard = F.col("kind") == "hard"
    same_instance = F.col("instance_a") == F.col("instance_b")
    same_category = F.col("category_a") == F.col("category_b")
    rules = {
        "same_frame": F.col("frame_a") == F.col("frame_b"),
        "positive_identity": (F.col("kind") == "positive") & ~same_instance,
        "hard_definition": hard & (same_instance | ~same_category | (F.col("ratio") > cutoff + 1e-12)),
        "easy_definition": (F.col("kind") == "easy") & same_category,
    }
    copies = pairs.groupBy("split", "pair_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    broken = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))
    return pairs.select("split", broken.alias("rule"), "pair_id").unionByName(copies.select("split", F.lit("duplicate").alias("rule"), "pair_id"))


def pair_definition_audit(pairs: DataFrame, cutoff: float, cap: int, listed: int = 100) -> DataFrame:
    """One row per split: counts, checks and up to ``listed`` named violations.

    The list is a report; the checks count every violation of :func:`pair_violations`.
    """
    broken = pair_violations(pairs, cutoff).select("split", F.concat_ws(":", "rule", "pair_id").alias("violation"))
    # Partial top-n per task keeps the list short before anything is gathered.
    first = Window.partitionBy("split").orderBy("violation")
    named = (
        broken.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= listed)
        .groupBy("split").agg(F.array_sort(F.collect_list("violation")).alias("violations"))
    )
    totals = broken.groupBy("split").agg(F.count(F.lit(1)).alias("violation_count"))
    largest = (
        pairs.groupBy("split", "cluster_id").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("split").agg(F.max("rows").alias("largest_contribution"))
    )
    kinds = pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("positive", "hard", "easy")],
    )
    return (
        kinds.join(largest, "split")
        .join(totals, "split", "left")
        .join(named, "split", "left")
        .withColumn("violation_count", F.coalesce("violation_count", F.lit(0)))
        .withColumn("definitions_hold", F.col("violation_count") == 0)
        .withColumn("cap_respected", F.col("largest_contribution") <= cap)
    )
