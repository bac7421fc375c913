"""The observation, pair and score tables that the queries run on, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import hash_integer
from ..functions.numbers import rounded_to
from ..operators.pairs import band_pairs, classified_pairs, kind_by_scale, log_ratio, same_category_ratios, scale_cutoff
from ..session import stage

SEED = 42
ORIGIN = "2024-01-01 00:00:00"
LOW_GAP, HIGH_GAP = 1, 23
SYSTEMS = ("A", "B", "C")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(cluster: Column) -> Column:
    """60/20/20 by a hash of the cluster, so no cluster is in two splits."""
    draw = F.pmod(hash_integer(SEED, cluster), F.lit(10))
    return F.when(draw < 6, "train").when(draw < 8, "dev").otherwise("test")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """events as observations: cluster = user, frame = hour, instance = type."""
    hours = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{ORIGIN}', cast(ts as timestamp_ntz))")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("observation_id"),
        F.col("user_id").alias("cluster_id"),
        hours.alias("frame"),
        F.col("event_type").alias("instance"),
        F.when(F.col("event_type").isin("click", "view"), "browse").otherwise("other").alias("category"),
        F.col("value").alias("area"),
        F.get_json_object("props", "$.k").cast("bigint").alias("attribute"),
        split_of(F.col("user_id")).alias("split"),
    )


OBS = """
obs AS (
  SELECT event_id AS observation_id, user_id AS cluster_id,
    CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS frame,
    event_type AS instance,
    CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other' END AS category,
    value AS area, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS attribute,
    CASE WHEN draw < 6 THEN 'train' WHEN draw < 8 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('42|' || user_id), 1, 8))::BIGINT % 10 AS draw FROM events))"""

CARRIED = ("instance", "category", "area", "attribute")


def banded(spark: SparkSession, folder: str, seen: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """All band pairs with their log area ratio, before kinds are given. ``seen`` are
    observations that hold the columns ``more`` besides."""
    rows = observations(spark, folder) if seen is None else seen
    pairs = band_pairs(rows, LOW_GAP, HIGH_GAP, [*CARRIED, "split", *more])
    return (
        pairs.withColumnRenamed("split_a", "split").drop("split_b")
        .withColumn("ratio", rounded_to(log_ratio(F.col("area_a"), F.col("area_b")), 9))
    )


BAND = OBS + """,
band AS (
  SELECT a.cluster_id, a.split, a.observation_id AS observation_id_a, b.observation_id AS observation_id_b,
    a.frame AS frame_a, b.frame AS frame_b, b.frame - a.frame AS gap,
    a.instance AS instance_a, b.instance AS instance_b, a.category AS category_a, b.category AS category_b,
    a.area AS area_a, b.area AS area_b, a.attribute AS attribute_a, b.attribute AS attribute_b,
    round(abs(ln(greatest(a.area, 1e-8) / greatest(b.area, 1e-8))), 9) AS ratio
  FROM obs a JOIN obs b ON a.cluster_id = b.cluster_id AND b.frame - a.frame BETWEEN 1 AND 23)"""

CUTOFF = """,
cutoff AS (
  SELECT ratio AS cutoff FROM (
    SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS rn, count(*) OVER () AS n FROM band
    WHERE split = 'train' AND instance_a <> instance_b AND category_a = category_b)
  WHERE rn = CAST(ceil((n - 1) * 0.25) AS BIGINT))"""


def cutoff(spark: SparkSession, folder: str) -> float:
    train = observations(spark, folder).where("split = 'train'")
    return scale_cutoff(same_category_ratios(train, LOW_GAP, HIGH_GAP, "instance", "category", "area"))


def pairs(spark: SparkSession, folder: str, seen: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Positive, hard and easy pairs; the hard cutoff is locked on train."""
    kind = kind_by_scale("instance", "category", F.col("ratio"), F.lit(cutoff(spark, folder)))
    return classified_pairs(banded(spark, folder, seen, more), kind)


def scored_splits(spark: SparkSession, folder: str, *splits: str) -> DataFrame:
    """(cluster_id, split, label, system, score) of some splits. A cluster has one split, so
    no pair of another is formed; the hard cutoff comes from train all the same."""
    seen = observations(spark, folder).where(F.col("split").isin(*splits))
    kept = pairs(spark, folder, seen).select("cluster_id", "split", "label", "ratio", "gap", "attribute_a", "attribute_b", "category_a", "category_b")
    return scored(spark, folder, stage(kept, "pairs")).select("cluster_id", "split", "label", "system", "score")


def staged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pair table as a written stage, for jobs that read it more than once."""
    return stage(pairs(spark, folder), "pairs")


PAIRS = BAND + CUTOFF + """,
pairs AS (
  SELECT *, CASE WHEN kind = 'positive' THEN 1 ELSE 0 END AS label,
    CASE WHEN kind <> 'positive' THEN kind END AS difficulty,
    CASE WHEN gap <= 5 THEN 'short' WHEN gap <= 11 THEN 'medium' ELSE 'long' END AS gap_bin,
    substr(sha256('pair|' || least(observation_id_a, observation_id_b) || '|' || greatest(observation_id_a, observation_id_b)), 1, 24) AS pair_id
  FROM (SELECT band.*, CASE WHEN instance_a = instance_b THEN 'positive' WHEN category_a <> category_b THEN 'easy'
      WHEN ratio <= (SELECT cutoff FROM cutoff) THEN 'hard' END AS kind FROM band)
  WHERE kind IS NOT NULL)"""


def scored(spark: SparkSession, folder: str, pair_table: DataFrame | None = None) -> DataFrame:
    """Three closed-form systems over the pairs, one row per (pair, system)."""
    base = pair_table if pair_table is not None else staged_pairs(spark, folder)
    ratio, gap = F.col("ratio"), F.col("gap")
    near = F.abs(F.col("attribute_a") - F.col("attribute_b"))
    alike = F.when(F.col("category_a") == F.col("category_b"), 0.2).otherwise(0.0)
    scores = {
        "A": 1 / (1.3 + ratio),
        "B": 1 / (1.3 + ratio + 0.02 * gap) + alike,
        "C": 1 / (1.3 + ratio + 0.02 * gap + 0.005 * near) + alike,
    }
    return base.withColumn(
        "_s", F.explode(F.array(*[F.struct(F.lit(k).alias("system"), rounded_to(v, 6).alias("score")) for k, v in scores.items()]))
    ).select("*", "_s.system", "_s.score").drop("_s")


SCORED = PAIRS + """,
scored AS (
  SELECT pairs.*, s.system, round(CASE s.system
      WHEN 'A' THEN 1 / (1.3 + ratio)
      WHEN 'B' THEN 1 / (1.3 + ratio + 0.02 * gap) + alike
      ELSE 1 / (1.3 + ratio + 0.02 * gap + 0.005 * abs(attribute_a - attribute_b)) + alike END, 6) AS score
  FROM (SELECT *, CASE WHEN category_a = category_b THEN 0.2 ELSE 0.0 END AS alike FROM pairs) AS pairs,
    (VALUES ('A'), ('B'), ('C')) AS s(system))"""
