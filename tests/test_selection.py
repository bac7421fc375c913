import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import pairs as P
from pairloom.operators import selection as S


def test_allocation_matches_the_loop(spark):
    rng = random.Random(1)
    for _ in range(4):
        capacities = {f"s{i}": rng.randint(1, 30) for i in range(7)}
        target = rng.randint(1, sum(capacities.values()))
        total = sum(capacities.values())
        raw = {k: target * c / total for k, c in capacities.items()}
        expected = {k: math.floor(v) for k, v in raw.items()}
        order = sorted(capacities, key=lambda k: (raw[k] - expected[k], capacities[k], k), reverse=True)
        for k in order[: target - sum(expected.values())]:
            expected[k] += 1
        df = spark.createDataFrame(list(capacities.items()), "stratum string, capacity bigint")
        assert {r["stratum"]: r["allocated"] for r in S.proportional_allocation(df, target).collect()} == expected


def inventory(spark):
    rows = [(f"v{i:02d}", [[64] * 24] * (3 + i % 8), (["a", "a"] + [f"x{j}" for j in range(8)])[: 3 + i % 8]) for i in range(80)]
    rows.append(("none", [[64] * 24] * 3, ["a", "b", "c"]))
    return spark.createDataFrame(rows, "cluster_id string, visibility array<array<int>>, look array<string>")


def test_selection_end_to_end(spark):
    counts = P.visibility_pair_counts(inventory(spark), "visibility", 32, 2, 23, ["look"])
    assessed = S.assess_clusters(counts, 10, 10)
    refused = assessed.where("not eligible").collect()
    assert [(r["cluster_id"], r["reason"]) for r in refused] == [("none", "insufficient_hard_negative_pairs")]
    # 24 visible frames: 253 pairs with gap 2..23, counted in both orders, per instance.
    row = assessed.where("cluster_id = 'v00'").first()
    assert row["positive_pairs"] == 3 * 506 and row["hard_pairs"] == 506 and row["object_bin"] == "03-04"
    eligible = S.rank_tertiles(assessed.where("eligible"), "pair_capacity", "cluster_id", "tertile")
    chosen = S.stratified_sample(eligible.withColumn("stratum", F.concat_ws("|", "object_bin", "tertile")), "stratum", 50, 7)
    assert chosen.count() == 50
    split = S.exact_split(chosen, {"train": 30, "dev": 10, "test": 10}, "object_bin", 7)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 30, "dev": 10, "test": 10} and split.select("cluster_id").distinct().count() == 50
    per_bin = split.groupBy("object_bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s")).collect()
    assert all(r["s"] == 3 for r in per_bin if r["n"] >= 3)


def test_too_small_split_is_an_error(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(20)], "cluster_id bigint, stratum string")
    with pytest.raises(ValueError):
        S.exact_split(df, {"train": 17, "dev": 2, "test": 1}, "stratum", 1)


def fields(spark, n=25):
    rng = random.Random(6)
    return spark.createDataFrame([(i, rng.random(), float(rng.randint(0, 9)), 4.0) for i in range(n)], "cluster_id bigint, a double, b double, c double")


def test_farthest_first_is_repeatable_and_spread(spark):
    df = fields(spark)
    first = S.farthest_first(df, ["a", "b", "c"], 20, 3)
    again = S.farthest_first(df.repartition(5).orderBy(F.desc("a")), ["a", "b", "c"], 20, 3)
    assert sorted(first.collect()) == sorted(again.collect()) and first.select("cluster_id").distinct().count() == 20
    gaps = [r["distance"] for r in first.orderBy("place").collect()][1:]
    assert gaps == sorted(gaps, reverse=True)


def test_balanced_choices_beat_or_equal_every_try(spark):
    df = fields(spark, 60)
    one = S.balanced_split(df, ["a", "b"], 1, 2).first()["objective"]
    best = S.balanced_split(df, ["a", "b"], 10, 2)
    assert best.first()["objective"] <= one
    assert {r["split"]: r["count"] for r in best.groupBy("split").count().collect()} == {"train": 36, "dev": 12, "test": 12}
    sample = S.balanced_subsample(df, ["a", "b"], 20, 6, 2)
    assert sample.count() == 20 and sample.first()["objective"] <= S.balanced_subsample(df, ["a", "b"], 20, 1, 2).first()["objective"]


def test_constant_field_has_no_difference(spark):
    df = fields(spark)
    got = {r["field"]: r["smd"] for r in S.subset_differences(df, df, ["a", "c"]).collect()}
    assert got == {"a": 0.0, "c": None}


def test_targets_beyond_the_rows_are_an_error(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "stratum string, capacity long")
    with pytest.raises(Exception, match="fewer than 30 rows"):
        S.proportional_allocation(df, 30).collect()
    rows = spark.range(100).selectExpr("id AS cluster_id", "'s' AS stratum")
    with pytest.raises(Exception, match="do not add up"):
        S.exact_split(rows, {"train": 30, "dev": 10, "test": 10}, "stratum", 1).collect()
