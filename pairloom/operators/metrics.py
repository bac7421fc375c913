"""Ranking, operating-point and calibration metrics over labelled scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles, running_totals

# F1 ties, probability clip of the log loss, calibration bin edges.
F1_DIGITS = 12
CLIP = 2.220446049250313e-16
EDGES = [i * 0.1 for i in range(10)]


def score_steps(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive and negative counts per distinct score: all later work is on these."""
    return scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def score_ladder(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps with the counts below each score (``*_before``) and per key (``*_total``)."""
    return running_totals(score_steps(scored, keys), keys, ["score"], ["pos", "neg"])


def ranking_metrics(ladder: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-aware AUROC and step-wise average precision; null where a class is missing."""
    both = (F.first("pos_total") > 0) & (F.first("neg_total") > 0)
    beaten = F.col("neg_before") + 0.5 * F.col("neg")
    hits = F.col("pos_total") - F.col("pos_before")
    calls = hits + F.col("neg_total") - F.col("neg_before")
    precision = F.when(calls > 0, hits / calls).otherwise(0.0)
    return ladder.groupBy(*keys).agg(
        F.first("pos_total").alias("positives"),
        F.first("neg_total").alias("negatives"),
        F.when(both, F.sum(F.col("pos") * beaten) / F.first("pos_total") / F.first("neg_total")).alias("auroc"),
        F.when(both, F.sum(F.col("pos") * precision) / F.first("pos_total")).alias("average_precision"),
    )


def confusion(scored: DataFrame, keys: Sequence[str], threshold: Column, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn at a threshold; a score equal to it is a match."""
    w = F.lit(1) if weight is None else weight
    match, true = F.col("score") >= threshold, F.col("label") == 1
    cells = {"tp": true & match, "fp": ~true & match, "fn": true & ~match, "tn": ~true & ~match}
    return scored.groupBy(*keys).agg(*[F.sum(F.when(c, w).otherwise(0)).alias(n) for n, c in cells.items()])


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """F1, precision, recall and false-match rate; 0 where nothing divides."""

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return {
        "f1": part(2 * tp, 2 * tp + fp + fn),
        "precision": part(tp, tp + fp),
        "recall": part(tp, tp + fn),
        "false_match_rate": part(fp, fp + tn),
    }


def _neighbour_midpoint(ladder: DataFrame, picked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Move a threshold half way to the next lower distinct score; -inf if there is none."""
    lower = (
        ladder.join(picked, list(keys)).where(F.col("score") < F.col(name)).groupBy(*keys).agg(F.max("score").alias("_below"))
    )
    moved = F.coalesce((F.col(name) + F.col("_below")) / 2, F.lit(float("-inf")))
    return picked.join(lower, list(keys), "left").withColumn(name, moved).drop("_below")


def operating_points(ladder: DataFrame, keys: Sequence[str], recall: float = 0.9) -> DataFrame:
    """The max-F1 and the recall threshold of each key, moved to a stable boundary.

    Equal F1 takes the higher score; the recall point is the highest score whose
    recall reaches the target.
    """
    hits = F.col("pos_total") - F.col("pos_before")
    calls = hits + F.col("neg_total") - F.col("neg_before")
    f1 = F.round(2 * hits / (calls + F.col("pos_total")), F1_DIGITS)
    picks = ladder.groupBy(*keys).agg(
        F.max(F.struct(f1.alias("f1"), F.col("score").alias("score"))).alias("_best"),
        F.max(F.when(hits / F.col("pos_total") >= recall, F.col("score"))).alias("recall_threshold"),
    )
    best = _neighbour_midpoint(ladder, picks.select(*keys, F.col("_best.score").alias("f1_threshold")), keys, "f1_threshold")
    at_recall = _neighbour_midpoint(ladder, picks.select(*keys, "recall_threshold"), keys, "recall_threshold")
    return best.join(at_recall, list(keys)).join(picks.select(*keys, F.col("_best.f1").alias("best_f1")), list(keys))


def locked_metrics(scored: DataFrame, lock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All published metrics per key; ``keys`` must hold ``system``.

    The lock has one row per system; its size is the number of systems.
    """
    ranking = ranking_metrics(score_ladder(scored, keys), keys)
    known = scored.join(F.broadcast(lock.select("system", "f1_threshold", "recall_threshold")), "system")
    points = known.groupBy(*keys).agg(
        *[
            F.count_if((F.col("label") == y) & ((F.col("score") >= F.col(f"{p}_threshold")) == m)).alias(f"{p}_{n}")
            for p in ("f1", "recall")
            for n, y, m in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False), ("tn", 0, False))
        ]
    )
    at = {p: rates(*[F.col(f"{p}_{n}") for n in ("tp", "fp", "fn", "tn")]) for p in ("f1", "recall")}
    return ranking.join(points, list(keys)).select(
        *keys, "positives", "negatives", "auroc", "average_precision",
        at["f1"]["f1"].alias("f1"), at["f1"]["precision"].alias("precision"), at["f1"]["recall"].alias("recall"),
        at["recall"]["false_match_rate"].alias("false_match_rate"), at["recall"]["recall"].alias("recall_at_locked"),
    )


METRICS = ("auroc", "average_precision", "f1", "false_match_rate")


def calibration(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier score, log loss and 10-bin expected calibration error (last bin closed)."""
    p = F.col("score")
    clipped = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    y = F.col("label")
    bin_of = F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: e <= p))
    bins = scored.groupBy(*keys, bin_of.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_score"), F.sum("label").alias("_label"),
        F.sum(F.pow(p - y, 2)).alias("_square"),
        F.sum(-F.when(y == 1, F.ln(clipped)).otherwise(F.ln(1 - clipped))).alias("_loss"),
    )
    n = F.sum("_n")
    return bins.groupBy(*keys).agg(
        (F.sum("_square") / n).alias("brier"), (F.sum("_loss") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("_score") - F.col("_label"))) / n).alias("calibration_error"),
    )


def macro(per_cluster: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean over clusters and the sample deviation between them."""
    return per_cluster.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[F.stddev_samp(m).alias(f"sd_{m}") for m in metrics],
    )


def train_cutpoints(df: DataFrame, fields: Sequence[str], low: float = 1 / 3, high: float = 2 / 3) -> dict[str, tuple[float, float]]:
    """Tertile cut points of each field, from train rows only: two numbers per field."""
    train = df.where(F.col("split") == "train").select(*[F.col(f).cast("double").alias(f) for f in fields])
    long = train.unpivot([], list(fields), "field", "value")
    rows = exact_quantiles(long, ["field"], "value", {"low": low, "high": high}).collect()
    found = {r["field"]: (round(r["low"], 12), round(r["high"], 12)) for r in rows}
    for field in fields:
        if field not in found or not found[field][0] < found[field][1]:
            raise ValueError(f"train cut points of {field} are missing or equal")
    return found


def comparison_levels(label: Column, difficulty: Column) -> Column:
    """Array of comparisons a row takes part in: positives are reused in both."""
    return F.array_compact(
        F.array(
            *[F.when((label == 1) | (difficulty == d), F.lit(f"positive_vs_{d}")) for d in ("hard", "easy")]
        )
    )


def stratified(scored: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """One row per (row, dimension, level): a value may be a level or an array of levels."""
    types = dict(scored.select(*[c.alias(n) for n, c in dimensions.items()]).dtypes)

    def tagged(name: str, value: Column) -> Column:
        levels = value if types[name].startswith("array") else F.array(value.cast("string"))
        return F.transform(levels, lambda level: F.struct(F.lit(name).alias("dimension"), level.alias("level")))

    arrays = [tagged(n, c) for n, c in dimensions.items()]
    return scored.withColumn("_d", F.explode(F.concat(*arrays))).select("*", "_d.*").drop("_d")


def metric_by_content(metrics: DataFrame) -> DataFrame:
    """AUROC where both classes exist, else recall (positives only) or false-match rate."""
    return metrics.withColumns(
        {
            "metric": F.when((F.col("positives") > 0) & (F.col("negatives") > 0), "auroc")
            .when(F.col("positives") > 0, "recall").otherwise("false_match_rate"),
            "value": F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("auroc"))
            .when(F.col("positives") > 0, F.col("recall_at_locked")).otherwise(F.col("false_match_rate")),
        }
    )


def wide_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long (key, system, score) to one map per key, for sinks."""
    return scored.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", "score")))).alias("scores"))
