"""Cluster audit, allocation, stratified sampling, splits and diverse selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import edge_bin, object_bin
from ..functions.ids import digest, hex_slice
from .ordering import exact_quantiles, ranked
from .quality import failing_reasons

# Tertile names, the split cycle, and when a spread counts as zero.
TERTILES = ("low", "medium", "high")
SPLIT_CYCLE = ("train", "train", "train", "dev", "test")
FLAT = 1e-12


def assess_clusters(counts: DataFrame, min_positive: int, min_hard: int) -> DataFrame:
    """Eligibility with a joined reason, object bin and pair capacity of each cluster."""
    reasons = failing_reasons(
        {
            "insufficient_positive_pairs": F.col("positive_pairs") < min_positive,
            "insufficient_hard_negative_pairs": F.col("hard_pairs") < min_hard,
        }
    )
    return (
        counts.withColumn("_r", reasons)
        .withColumns(
            {
                "eligible": F.size("_r") == 0,
                "reason": F.when(F.size("_r") == 0, "eligible").otherwise(F.concat_ws(";", "_r")),
                "object_bin": object_bin(F.col("instances")),
                "pair_capacity": F.least("positive_pairs", "hard_pairs"),
            }
        )
        .drop("_r")
    )


def repeated_instances(observations: DataFrame, pilot: DataFrame, minimum: int = 2, cluster: str = "cluster_id",
                       instance: str = "instance") -> DataFrame:
    """Clusters with at least ``minimum`` instances seen ``minimum`` times, flagged against the pilot."""
    per_instance = observations.groupBy(cluster, instance).agg(F.count(F.lit(1)).alias("_n"))
    per_cluster = per_instance.groupBy(cluster).agg(F.count_if(F.col("_n") >= minimum).alias("repeated_instances"))
    flagged = per_cluster.join(pilot.select(cluster).distinct().withColumn("pilot", F.lit(True)), cluster, "left")
    return flagged.withColumn("pilot", F.coalesce("pilot", F.lit(False))).withColumn(
        "eligible", (F.col("repeated_instances") >= minimum) & ~F.col("pilot")
    )


def rank_tertiles(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Equal-count tertiles by (value, key)."""
    placed = ranked(df, [], [value, key])
    third = F.least(F.lit(2), F.floor(3 * F.col("rank") / F.col("size"))).cast("int")
    return placed.withColumn(name, F.array(*[F.lit(t) for t in TERTILES])[third]).drop("rank", "size")


def proportional_allocation(capacities: DataFrame, target: int, stratum: str = "stratum") -> DataFrame:
    """Largest-remainder shares of ``target`` within the capacities.

    ``capacities`` has one row per stratum, so it is small. As target does not
    exceed the total, every stratum with a remainder has room for one more and a
    single ranking settles all of them. A target above the total is an error.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("capacity").over(everything)
    total = F.when(total < target, F.raise_error(F.lit(f"fewer than {target} rows to allocate"))).otherwise(total)
    raw = F.lit(target) * F.col("capacity") / F.col("_total")
    shares = (
        capacities.withColumn("_total", total)
        .withColumn("_floor", F.floor(raw))
        .withColumn("_rest", raw - F.col("_floor"))
        .withColumn("_left", F.lit(target) - F.sum("_floor").over(everything))
    )
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), F.desc("capacity"), F.desc(stratum))
    given = F.col("_floor") + F.when(F.row_number().over(best) <= F.col("_left"), 1).otherwise(0)
    return shares.withColumn("allocated", given).select(stratum, "capacity", "allocated")


def stratum_sizes(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("capacity"))


def stratified_sample(df: DataFrame, stratum: str, target: int, seed, key: str = "cluster_id") -> DataFrame:
    """A sample of exactly ``target`` rows, proportional over the strata, in hash order."""
    allocation = proportional_allocation(stratum_sizes(df, stratum), target, stratum)
    drawn = df.withColumn("_draw", digest(seed, "sample", F.col(key)))
    placed = ranked(drawn, [stratum], ["_draw", key], slicer=hex_slice(F.col("_draw")))
    return (
        placed.join(allocation.select(stratum, "allocated"), stratum)
        .where(F.col("rank") < F.col("allocated"))
        .drop("_draw", "rank", "size", "allocated")
    )


def hash_sample(df: DataFrame, count: int, seed, key: str) -> DataFrame:
    """The first ``count`` rows in hash order (a top-k, so nothing is sorted whole)."""
    return df.withColumn("_draw", digest(seed, F.col(key))).orderBy("_draw", key).limit(count).drop("_draw")


def exact_split(df: DataFrame, sizes: Mapping[str, int], stratum: str, seed, key: str = "cluster_id") -> DataFrame:
    """Assign exact split sizes, spread over the strata, each split present in strata of three or more.

    The first rows of such a stratum go one to each split. The rest, in (stratum,
    hash) order, meets a sequence in which the open places of the splits
    alternate in proportion.
    """
    names = list(sizes)
    drawn = df.withColumn("_draw", digest(seed, "split", F.col(key)))
    placed = ranked(drawn, [stratum], ["_draw", key], slicer=hex_slice(F.col("_draw")))
    head = (F.col("size") >= len(names)) & (F.col("rank") < len(names))
    first = placed.where(head).withColumn("split", F.array(*[F.lit(n) for n in names])[F.col("rank").cast("int")])
    covered = stratum_sizes(df, stratum).agg(F.count_if(F.col("capacity") >= len(names)).alias("n")).first()["n"]
    spark = df.sparkSession
    slots = None
    for order, name in enumerate(names):
        left = sizes[name] - covered
        if left < 0:
            raise ValueError(f"split {name} is smaller than the number of strata")
        part = spark.range(left).select(
            ((F.col("id") + 0.5) / left).alias("_key"), F.lit(order).alias("_order"), F.lit(name).alias("split")
        )
        slots = part if slots is None else slots.unionByName(part)
    slots = ranked(slots, [], ["_key", "_order"]).select("split", F.col("rank").alias("_place"))
    rest = placed.where(~head).drop("rank", "size")
    rest = ranked(rest, [], [stratum, "_draw"]).withColumnRenamed("rank", "_place").drop("size")
    # more rows than places, or fewer, is an error: nothing is dropped silently
    missing = F.raise_error(F.lit(f"the split sizes {dict(sizes)} do not add up to the rows"))
    tail = rest.join(slots, "_place", "full").withColumn("split", F.when(F.col("split").isNull() | F.col(key).isNull(), missing).otherwise(F.col("split")))
    tail = tail.drop("_place", "_draw")
    return first.drop("rank", "size", "_draw").unionByName(tail)


def _moments(prefix: str, fields: Sequence[str]) -> list[Column]:
    return [F.struct(F.avg(f).alias("mu"), F.var_samp(f).alias("va"), F.stddev_pop(f).alias("sd")).alias(f"{prefix}{f}") for f in fields]


def _parent_moments(parent: DataFrame, fields: Sequence[str]) -> Column:
    """The moments of every field as one struct, read through a scalar subquery."""
    return parent.agg(F.struct(*_moments("", fields))).scalar()


def subset_differences(parent: DataFrame, subset: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, smd) of subsets against their parent; null where nothing varies."""
    parts = subset.groupBy(*keys).agg(*_moments("_s_", fields)).withColumn("_p", _parent_moments(parent, fields))

    def smd(f: str) -> Column:
        pooled = F.sqrt((F.col(f"_p.{f}.va") + F.col(f"_s_{f}.va")) / 2)
        return F.when(pooled > FLAT, F.abs(F.col(f"_s_{f}.mu") - F.col(f"_p.{f}.mu")) / pooled)

    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), smd(f).alias("smd")) for f in fields]))
    return parts.select(*keys, listed.alias("_v")).select(*keys, "_v.*")


def balanced_split(df: DataFrame, fields: Sequence[str], tries: int, seed, key: str = "cluster_id") -> DataFrame:
    """The best of ``tries`` seeded 60/20/20 splits by the sum of squared mean differences."""
    copies = df.select(key, *fields).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    copies = copies.withColumn("_draw", digest(seed, F.col("try"), F.col(key)))
    placed = ranked(copies, ["try"], ["_draw", key], slicer=hex_slice(F.col("_draw")))
    place = (F.col("rank") % len(SPLIT_CYCLE)).cast("int")
    assigned = placed.withColumn("split", F.array(*[F.lit(s) for s in SPLIT_CYCLE])[place])
    smd = subset_differences(df, assigned, fields, ["try", "split"])
    objective = smd.groupBy("try").agg(F.round(F.sum(F.coalesce(F.pow("smd", 2), F.lit(0.0))), 9).alias("objective"))
    best = objective.agg(F.min(F.struct("objective", "try")).alias("_b")).select("_b.try", "_b.objective")
    return assigned.join(F.broadcast(best), "try").select(key, "split", "try", "objective")


def balanced_subsample(df: DataFrame, fields: Sequence[str], count: int, tries: int, seed, key: str = "cluster_id") -> DataFrame:
    """The best of ``tries`` stratified samples by distance from the parent's distribution.

    Strata are the quintile bins of the first field. The objective weighs the
    squared standardized shifts of means (20) and deviations (2) and the squared
    relative errors of all quintile counts.
    """
    long = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    cuts = {r["field"]: [r[f"q{i}"] for i in range(1, 5)] for r in exact_quantiles(long, ["field"], "value", {f"q{i}": i / 5 for i in range(1, 5)}).collect()}
    bins = {f"_bin_{f}": edge_bin(F.col(f), F.array(*[F.lit(c) for c in cuts[f]])) for f in fields}
    binned = df.select(key, *fields).withColumns(bins)
    stratum = f"_bin_{fields[0]}"
    allocation = proportional_allocation(stratum_sizes(binned, stratum), count, stratum).select(stratum, "allocated")
    copies = binned.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    copies = copies.withColumn("_draw", digest(seed, F.col("try"), F.col(key)))
    placed = ranked(copies, ["try", stratum], ["_draw", key], slicer=hex_slice(F.col("_draw")))
    taken = placed.join(allocation, stratum).where(F.col("rank") < F.col("allocated"))

    parts = taken.groupBy("try").agg(*_moments("_s_", fields)).withColumns(
        {"_p": _parent_moments(df, fields), "_n": df.agg(F.count(F.lit(1))).scalar()}
    )
    shift = F.lit(0.0)
    for f in fields:
        sd = F.col(f"_p.{f}.sd")
        term = 20 * F.pow((F.col(f"_s_{f}.mu") - F.col(f"_p.{f}.mu")) / sd, 2) + 2 * F.pow((F.col(f"_s_{f}.sd") - sd) / sd, 2)
        shift = shift + F.when(sd > FLAT, term).otherwise(0.0)
    moments = parts.select("try", shift.alias("shift"), "_n")

    def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_bin_{f}").alias("bin")) for f in fields]))
        return rows.select(*keys, cells.alias("_c")).groupBy(*keys, "_c.field", "_c.bin").agg(F.count(F.lit(1)).alias(name))

    grid = counted(binned, [], "full").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    cells = grid.join(counted(taken, ["try"], "seen"), ["try", "field", "bin"], "left").join(moments, "try")
    expected = F.col("full") * F.lit(count) / F.col("_n")
    error = F.pow((F.coalesce("seen", F.lit(0)) - expected) / F.greatest(expected, F.lit(1.0)), 2)
    scored = cells.groupBy("try").agg(F.round(F.first("shift") + F.sum(error), 8).alias("objective"))
    best = scored.agg(F.min(F.struct("objective", "try")).alias("_b")).select("_b.try", "_b.objective")
    return taken.join(F.broadcast(best), "try").select(key, "try", "objective")


def min_max_scaled(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields scaled to [0, 1]; a constant field becomes 0."""
    ends = df.agg(F.struct(*[F.struct(F.min(f).cast("double").alias("lo"), F.max(f).cast("double").alias("hi")).alias(f) for f in fields])).scalar()

    def scaled(f: str) -> Column:
        span = F.col(f"_ends.{f}.hi") - F.col(f"_ends.{f}.lo")
        return (F.col(f) - F.col(f"_ends.{f}.lo")) / F.when(span == 0, 1.0).otherwise(span)

    kept = [c for c in df.columns if c not in fields]
    return df.withColumn("_ends", ends).select(*kept, *[scaled(f).alias(f) for f in fields])


def farthest_first(df: DataFrame, fields: Sequence[str], count: int, seed, key: str = "cluster_id") -> DataFrame:
    """Maximin selection on scaled fields, ties to the smaller hash.

    Each pass is one aggregation over the table: the points chosen so far, at
    most ``count`` rows of a few numbers, enter it as literals.
    """
    scaled = min_max_scaled(df.select(key, *fields), fields).withColumn("_tie", digest(seed, F.col(key)))
    chosen: list = []
    for _ in range(count):
        if chosen:
            gaps = [
                F.sqrt(sum(F.pow(F.col(f) - F.lit(p[f]), 2) for f in fields)) for p in chosen
            ]
            distance = F.round(F.least(*gaps) if len(gaps) > 1 else gaps[0], 9)
            pool = scaled.where(~F.col(key).isin([p[key] for p in chosen]))
        else:
            distance, pool = F.lit(0.0), scaled
        best = pool.agg(F.min(F.struct((-distance).alias("_d"), "_tie", key, *fields)).alias("_b")).first()["_b"]
        if best is None:
            raise ValueError(f"{len(chosen)} rows, {count} asked for")
        chosen.append(best)
    rows = [(p[key], i + 1, float(-p["_d"])) for i, p in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, f"{key} bigint, place int, distance double")


def field_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, low, mean, median, high)."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    ends = long.groupBy("field").agg(F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return ends.join(exact_quantiles(long, ["field"], "value", {"median": 0.5}).drop("n"), "field")


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    table = df.groupBy(row).pivot(column, list(values)).count()
    return table.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])
