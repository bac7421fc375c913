"""Running totals, ranks and exact quantiles without one task per group.

A window ordered inside a key sends the whole key to one task. Here the ordered
rows are cut into slices, totals are taken inside each slice, and the few slice
totals give the offsets that stitch the slices together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stage


def sliced_by_range(df: DataFrame, *order: str, slices: int | None = None) -> DataFrame:
    """Add ``_slice``, rising with ``order``; rows equal in ``order`` share a slice.

    Range bounds come from a sample, so the result is materialized: every later
    reader has to see the same slices, also after a lost executor.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(
        df.repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id())
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    slicer: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``<c>_before`` (sum over earlier rows) and ``<c>_total`` for each c in ``sums``.

    ``keys`` must not be null and ``order`` must be unique inside a key. With
    ``slicer``, a column that never falls along ``order`` (such as the first
    digits of a hash), nothing is materialized.
    """
    keys = list(keys)
    if slicer is None:
        staged = sliced_by_range(df, *keys, *order, slices=slices)
    else:
        staged = df.withColumn("_slice", slicer)
    slice_totals = staged.groupBy(*keys, "_slice").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_offset_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(group).alias(f"{c}_total") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = staged.withColumns(
        {f"_local_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    )
    stitched = local.join(offsets, [*keys, "_slice"])
    return stitched.withColumns(
        {f"{c}_before": F.col(f"_local_{c}") + F.col(f"_offset_{c}") for c in sums}
    ).drop("_slice", *[f"_local_{c}" for c in sums], *[f"_offset_{c}" for c in sums])


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slicer: Column | None = None
) -> DataFrame:
    """Add ``rank`` (0-based) and ``size`` of the key."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), keys, order, ["_one"], slicer)
    return (
        counted.withColumnRenamed("_one_before", "rank")
        .withColumnRenamed("_one_total", "size")
        .drop("_one")
    )


def value_ladder(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts and running counts; NaN and null are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, keys, [value], ["n"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key, any group size. ``probabilities`` maps output name to p.

    ``linear`` interpolates at (n-1)p; ``higher`` takes the observed value at
    index ceil((n-1)p).
    """
    ladder = value_ladder(df, keys, value)

    def at(index: Column) -> Column:
        inside = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    def position(p: float) -> Column:
        return (F.col("n_total") - 1) * F.lit(float(p))

    aggregates = [F.max("n_total").alias("n")]
    for name, p in probabilities.items():
        aggregates += [
            at(F.floor(position(p))).alias(f"_low_{name}"),
            at(F.ceil(position(p))).alias(f"_high_{name}"),
            F.max(position(p) - F.floor(position(p))).alias(f"_part_{name}"),
        ]
    found = ladder.groupBy(*keys).agg(*aggregates)
    outputs = []
    for name in probabilities:
        low, high, part = (F.col(f"_{side}_{name}") for side in ("low", "high", "part"))
        outputs.append((low + (high - low) * part if method == "linear" else high).alias(name))
    return found.select(*keys, "n", *outputs)


# A key of more rows than this is not given to one task.
HOT_ROWS = 1_000_000
# Tables of hot keys up to this many rows are sent to the data.
SENT_KEYS = 100_000
DIGIT_BITS = 16


def _ordered_bits(value: Column) -> Column:
    """A long that sorts as the double does: its bits, the lower 63 inverted for negative numbers."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _double_of(bits: Column) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def radix_quantiles(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(_key, _name, _q): exact interpolated quantiles of ``rows`` (_key, _name, _value).

    A radix selection over the ordered bits of the double. Each of four passes counts
    16 bits of the values that share the bits found so far, so what is shuffled is at
    most 65,536 counts per wanted rank and task, however many rows a key has.
    """
    group = ["_key", "_name"]
    bits = stage(rows.where(F.col("_value").isNotNull() & ~F.isnan("_value")).select(*group, _ordered_bits(F.col("_value")).alias("_bits")), "radix")
    targets = None
    for done in range(0, 64, DIGIT_BITS):
        if targets is None:
            digits = bits.select(*group, F.lit(0).cast("bigint").alias("_prefix"), F.shiftright("_bits", 64 - DIGIT_BITS).alias("_digit"))
        else:
            wanted = targets.select(*group, "_prefix").distinct()
            digit = F.shiftright("_bits", 64 - DIGIT_BITS - done).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            digits = bits.select(*group, F.shiftright("_bits", 64 - done).alias("_prefix"), digit.alias("_digit"))
            # a few rows per key: at most two per probability
            digits = digits.join(F.broadcast(wanted) if targets.count() <= SENT_KEYS else wanted, [*group, "_prefix"])
        counts = digits.groupBy(*group, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        if targets is None:
            counts = materialize(counts)
            sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
            places = [(F.col("_size") - 1) * F.lit(float(p)) for p in probabilities]
            ranks = [F.struct(F.lit(2 * i + side).alias("_t"), cut(place).cast("bigint").alias("_rest")) for i, place in enumerate(places) for side, cut in enumerate((F.floor, F.ceil))]
            targets = sizes.select(*group, "_size", F.lit(0).cast("bigint").alias("_prefix"), F.explode(F.array(*ranks)).alias("_r")).select(*group, "_size", "_prefix", "_r.*")
        # at most 65,536 rows, the counts of one digit
        upto = F.sum("_n").over(Window.partitionBy(*group, "_prefix").orderBy("_digit"))
        steps = counts.select(*group, "_prefix", "_digit", upto.alias("_upto"), (upto - F.col("_n")).alias("_before"))
        found = targets.join(steps, [*group, "_prefix"]).where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto")))
        targets = materialize(found.select(
            *group, "_size", (F.shiftleft("_prefix", DIGIT_BITS) + F.col("_digit")).alias("_prefix"), "_t", (F.col("_rest") - F.col("_before")).alias("_rest")
        ))
    values = targets.select(*group, "_size", "_t", _double_of(F.col("_prefix")).alias("_v"))
    side = [F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(f"_v{t}") for t in range(2 * len(probabilities))]
    wide = values.groupBy(*group).agg(F.max("_size").alias("_size"), *side)

    def between(i: int, p: float) -> Column:
        place = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return wide.select(*group, F.array(*[between(i, p) for i, p in enumerate(probabilities)]).alias("_q"))


def keyed_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], probabilities: Sequence[float], hot_rows: int | None = None) -> DataFrame:
    """(keys, one array of exact interpolated quantiles per column of ``values``).

    Nulls and NaN are left out; a column without a value gives null. Keys of up to
    ``hot_rows`` rows are one aggregate. The others are counted first, at most one in
    ``hot_rows`` rows is such a key, and go through ``radix_quantiles``.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    keys, values = list(keys), list(values)
    # a struct is equal to another also where its fields are null
    rows = df.select(F.struct(*keys).alias("_key"), *[F.col(v).cast("double").alias(v) for v in values])
    rows = rows.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in values})
    hot = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_key"))
    number = hot.count()
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])

    def plain(part: DataFrame) -> DataFrame:
        return part.groupBy("_key").agg(*[F.percentile(v, wanted).alias(v) for v in values])

    if not number:
        return plain(rows).select("_key.*", *values)
    sent = F.broadcast(hot) if number <= SENT_KEYS else hot
    # every hot key has a row here, also where all its values are null
    long = rows.join(sent, "_key", "left_semi").unpivot(["_key"], values, "_name", "_value")
    found = radix_quantiles(long, probabilities).groupBy("_key").agg(*[F.max(F.when(F.col("_name") == v, F.col("_q"))).alias(v) for v in values])
    whole = hot.join(found, "_key", "left")
    return plain(rows.join(sent, "_key", "left_anti")).unionByName(whole).select("_key.*", *values)
