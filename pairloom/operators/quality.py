"""Integrity checks: keys, agreement, leakage, finiteness, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name parts that give away identity or truth, in either kind of source.
FORBIDDEN_PARTS = (
    "gt_", "ground_truth", "world_position", "velocity", "quaternion", "instance_index", "shape_label", "color_label", "material_label", "size_label",
    "object_position", "object_velocity", "segmentation_id", "asset_id", "category", "is_dynamic", "video_id", "dataset", "source_shard", "background",
    "instance", "cluster_id", "label",
)


def failing_reasons(rules: Mapping[str, Column]) -> Column:
    """All reasons whose test holds, in rule order."""
    return F.array_compact(F.array(*[F.when(test, reason) for reason, test in rules.items()]))


def split_by_eligibility(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded rows with every failing reason)."""
    judged = df.withColumn("reasons", failing_reasons(rules))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all fields, through structs, arrays and map values."""
    found = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        found.append(path)
        kind = field.dataType
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            found += field_paths(kind, path + ".")
    return found


def forbid_leaks(df: DataFrame, allowed: Sequence[str] = (), parts: Sequence[str] = FORBIDDEN_PARTS) -> DataFrame:
    """``df`` itself, or an error that names every field holding a forbidden part."""
    leaks = [p for p in field_paths(df.schema) if p not in allowed and any(x in p.lower() for x in parts)]
    if leaks:
        raise ValueError(f"fields not allowed in model inputs: {leaks}")
    return df


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bad, passed) for all columns in one pass."""
    counts = df.agg(*[F.count_if(not_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "bad").withColumn("passed", F.col("bad") == 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def distinct_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys, by two-level grouping."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return once.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys"))


def missing_keys(asked: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return asked.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def keep_known(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys; an unknown key is an error."""
    unknown = missing_keys(wanted, df, keys)
    if not unknown.isEmpty():
        raise ValueError(f"unknown ids, for example {unknown.first().asDict()}")
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def key_overlap(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """How many keys are in which tables; equal key sets give a single row of trues."""
    flags = [
        df.select(*keys, *[F.lit(1 if other == name else 0).alias(f"in_{other}") for other in tables])
        for name, df in tables.items()
    ]
    per_key = reduce(DataFrame.unionByName, flags).groupBy(*keys).agg(
        *[(F.max(f"in_{n}") == 1).alias(f"in_{n}") for n in tables]
    )
    return per_key.groupBy(*[f"in_{n}" for n in tables]).agg(F.count(F.lit(1)).alias("keys"))


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, joined, differing) over the rows both tables share; null equals null."""
    a = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    counts = a.join(b, list(keys)).agg(
        F.count(F.lit(1)).alias("joined"),
        *[F.count_if(~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}"))).alias(f) for f in fields],
    )
    return counts.unpivot(["joined"], list(fields), "field", "differing")


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-free hash sum. Columns must be strings or integers."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    value = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("hash_sum"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with their side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def split_overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split, by split pair. Empty when nothing leaks.

    A key holds at most one entry per split, so the sets are tiny.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
    return sets.groupBy(F.concat_ws("+", "_s").alias("splits")).agg(F.count(F.lit(1)).alias("keys"))


def named_checks(checks: Mapping[str, tuple[Column, Column]], df: DataFrame) -> DataFrame:
    """One row per check: observed and expected text and whether they are equal.

    ``checks`` maps a name to (aggregate, expected value).
    """
    row = df.agg(*[F.struct(seen.cast("string").alias("observed"), wanted.cast("string").alias("expected")).alias(n) for n, (seen, wanted) in checks.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"{n}.observed"), F.col(f"{n}.expected")) for n in checks]))
    return row.select(listed.alias("_c")).select("_c.*").withColumn("passed", F.col("observed").eqNullSafe(F.col("expected")))


def all_pass(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.bool_and("passed").alias("passed"))
