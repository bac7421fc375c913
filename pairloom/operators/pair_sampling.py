"""Quota sampling, template split and balance of pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import GAP_BINS
from ..functions.ids import digest, hex_slice
from ..session import materialize
from .ordering import ranked

# Fixed value of the balance gate.
SMD_GATE = 0.10


def even_quotas(total: int, bins: Sequence[str] = GAP_BINS) -> dict[str, int]:
    """``total`` spread over the bins, the remainder to the first ones."""
    share, extra = divmod(total, len(bins))
    return {name: share + (1 if place < extra else 0) for place, name in enumerate(bins)}


def hash_top(df: DataFrame, keys: Sequence[str], limit: int, draw: Column, tie: str) -> DataFrame:
    """The first ``limit`` rows of each key in hash order.

    Written as row_number() <= limit, which Spark also applies before the
    shuffle, so a hot key never travels whole.
    """
    order = Window.partitionBy(*keys).orderBy(draw, tie)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")


def capped(df: DataFrame, prior: Column, cap: int, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows that still fit under ``cap`` per key after ``prior`` earlier ones."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= cap)
        .where(prior + F.col("_rn") <= cap)
        .drop("_rn")
    )


def _literal(values: Mapping[str, object], key: str, kind: str) -> Column:
    """``values[key]`` as a column of literals; null for other keys."""
    return F.coalesce(*[F.when(F.col(key) == k, F.lit(v)) for k, v in values.items()], F.lit(None)).cast(kind)


def _numbered(candidates: DataFrame, keys: Sequence[str], item: Column, cap: int) -> DataFrame:
    """``_rn``: the place of each row in its cluster's queue, in hash order; rows past the cap
    can never be taken and go before the shuffle."""
    queue = Window.partitionBy("split", "cluster_id", *keys).orderBy("_item", "pair_id")
    return materialize(candidates.withColumn("_item", item).withColumn("_rn", F.row_number().over(queue)).where(F.col("_rn") <= cap).drop("_item"))


def _edges(at_cut: DataFrame, take: Mapping[str, int]) -> dict[str, tuple]:
    """Per split, the ``take``-th smallest (draw, cluster) of the rows."""
    order = Window.partitionBy("split").orderBy("_draw", "cluster_id")
    most = max(take.values())
    placed = at_cut.select("split", "_draw", "cluster_id", F.row_number().over(order).alias("_place")).where(F.col("_place") <= most)
    rows = placed.where(F.col("_place") == _literal(take, "split", "int")).collect()  # a row per split
    return {r["split"]: (r["_draw"], r["cluster_id"]) for r in rows}


def _up_to(edge: Mapping[str, tuple]) -> Column:
    """Whether (draw, cluster) is not past its split's edge; splits without an edge take none."""
    out = F.lit(False)
    for split, (draw, cluster) in edge.items():
        out = out | ((F.col("split") == split) & ((F.col("_draw") < draw) | ((F.col("_draw") == draw) & (F.col("cluster_id") <= F.lit(cluster)))))
    return out


def _fill_levels(queues: DataFrame, length: str, quota: Mapping[str, int], cap: int) -> Column:
    """How many of ``length`` queued items a step takes from each cluster with ``_prior`` picks.

    Item ``rn`` of a cluster has level prior + rn - 1, so a queue covers the levels from
    prior to its end. Only how many queues start and end at each level reaches the driver,
    at most twice the cap per split; then one draw per split.
    """
    first, end = F.col("_prior"), F.least(F.col("_prior") + F.col(length), F.lit(cap))
    here = queues.where(F.col("split").isin(list(quota)) & (first < end))
    steps = F.explode(F.array(F.struct(first.alias("level"), F.lit(1).alias("d")), F.struct(end.alias("level"), F.lit(-1).alias("d"))))
    rows = here.select("split", steps.alias("_e")).groupBy("split", "_e.level").agg(F.sum("_e.d").alias("d")).collect()
    levels, rest = {}, {}
    for split, wanted in quota.items():
        events = {r["level"]: r["d"] for r in rows if r["split"] == split}
        width = taken = 0
        levels[split] = cap
        for level in range(min(events, default=0), max(events, default=0)):
            width += events.get(level, 0)
            if taken + width >= wanted:
                levels[split], rest[split] = level, wanted - taken
                break
            taken += width
    cut = _literal(levels, "split", "long")
    edge = _edges(here.where((first <= cut) & (cut < end)), rest) if any(rest.values()) else {}
    below = F.greatest(F.least(end, cut) - first, F.lit(0))
    at_cut = ((first <= cut) & (cut < end) & _up_to(edge)).cast("long")
    return F.when(F.col("split").isin(list(quota)), F.coalesce(below + at_cut, F.lit(0))).otherwise(0)


def _fill_totals(queues: DataFrame, length: str, quota: Mapping[str, int], limits: Mapping[str, int]) -> Column:
    """The same for items ordered by (picks in this step, all picks of the cluster): what
    reaches the driver is how many queues have each prior and usable length, which the
    limit bounds both."""
    usable = F.greatest(F.least(F.col(length), _literal(limits, "split", "long") - F.col("_prior")), F.lit(0))
    here = queues.where(F.col("split").isin(list(quota)) & (usable > 0)).withColumn("_usable", usable)
    rows = here.groupBy("split", "_prior", "_usable").agg(F.count(F.lit(1)).alias("n")).collect()
    levels, priors, rest = {}, {}, {}
    for split, wanted in quota.items():
        mine = [(r["_prior"], r["_usable"], r["n"]) for r in rows if r["split"] == split]
        levels[split], priors[split], left = limits[split], -1, wanted
        for level, prior in ((lv, p) for lv in range(limits[split]) for p in sorted({m[0] for m in mine})):
            width = sum(n for p, usable_, n in mine if p == prior and usable_ > level)
            if width and left <= width:
                levels[split], priors[split], rest[split] = level, prior, left
                break
            left -= width
    level, prior = _literal(levels, "split", "long"), _literal(priors, "split", "long")
    open_ = (usable > level) & (F.col("_prior") == prior)
    edge = _edges(here.where((F.col("_usable") > level) & (F.col("_prior") == prior)), rest) if any(rest.values()) else {}
    at_cut = ((usable > level) & ((F.col("_prior") < prior) | (open_ & _up_to(edge)))).cast("long")
    return F.when(F.col("split").isin(list(quota)), F.coalesce(F.least(usable, level) + at_cut, F.lit(0))).otherwise(0)


def _taken(numbered: DataFrame, steps: Sequence[tuple], names: Sequence[str], fill, draw) -> DataFrame:
    """The rows that the steps take one after the other. All steps run on queue lengths, a
    row per cluster; the numbered rows are read twice, to count and to filter."""
    is_step = [reduce(Column.__and__, [F.col(n) == v for n, v in zip(names, step)]) for step in steps]
    lengths = numbered.groupBy("split", "cluster_id").agg(*[F.count_if(here).alias(f"_n{i}") for i, here in enumerate(is_step)])
    queues = materialize(lengths).withColumn("_prior", F.lit(0).cast("long"))
    for i, step in enumerate(steps):
        drawn = queues.withColumn("_draw", draw(*step))
        taken = drawn.withColumn(f"_t{i}", fill(drawn, f"_n{i}", step)).drop("_draw", f"_n{i}")
        queues = materialize(taken.withColumn("_prior", F.col("_prior") + F.col(f"_t{i}")))  # a row per cluster
    takes = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step)], F.col(f"_t{i}").alias("_take")) for i, step in enumerate(steps)]))
    wanted = queues.select("split", "cluster_id", takes.alias("_s")).select("split", "cluster_id", "_s.*").where("_take > 0")
    columns = [c for c in numbered.columns if c != "_rn"]
    return numbered.join(wanted, ["split", "cluster_id", *names]).where(F.col("_rn") <= F.col("_take")).select(*columns)


def balanced_quota_sample(candidates: DataFrame, targets: Mapping[str, Mapping[str, int]], cap: int, seed,
                          strict: bool = False) -> DataFrame:
    """Fill (kind, gap bin) quotas from the least represented cluster, all splits at once.

    ``targets[split][kind]`` is spread evenly over the bins. Taking one item at a
    time from the cluster with the fewest picks is a merge of the clusters'
    queues, so item number rn of a cluster with p earlier picks has level
    p + rn - 1, and the sample is the first ``target`` items by (level, cluster
    hash). The merge depends on queue lengths and hashes only, so it runs on these.
    """
    place = [F.col(c) for c in ("split", "kind", "gap_bin", "cluster_id")]
    numbered = _numbered(candidates, ["kind", "gap_bin"], digest(seed, *place, F.col("pair_id")), cap)
    kinds = dict.fromkeys(k for per in targets.values() for k in per)
    quotas = {(kind, gap): {s: even_quotas(per[kind])[gap] for s, per in targets.items() if kind in per} for kind in kinds for gap in GAP_BINS}
    sample = _taken(
        numbered, list(quotas), ["kind", "gap_bin"], lambda queues, length, step: _fill_levels(queues, length, quotas[step], cap),
        lambda kind, gap: digest(seed, F.col("split"), F.lit(kind), F.lit(gap), F.col("cluster_id")),
    )
    if strict:
        _require_quotas(sample, targets)
    return sample


def _require_quotas(sample: DataFrame, targets: Mapping[str, Mapping[str, int]]) -> None:
    got = {(r["split"], r["kind"], r["gap_bin"]): r["count"] for r in sample.groupBy("split", "kind", "gap_bin").count().collect()}
    for split, per in targets.items():
        for kind, total in per.items():
            for gap, wanted in even_quotas(total).items():
                if got.get((split, kind, gap), 0) != wanted:
                    raise ValueError(f"{split}/{kind}/{gap}: {got.get((split, kind, gap), 0)} of {wanted}")


def two_level_quota_sample(positives: DataFrame, targets: Mapping[str, int], cap: int, seed, strict: bool = False) -> DataFrame:
    """Positives balanced first on the picks in the bin, then on all picks of the cluster.

    The cap is the smaller of ``cap`` and 1.25 times an equal share of the split's
    clusters, rounded up. With ``strict`` a bin short of its quota is an error.
    """
    counted = positives.groupBy("split").agg(F.count_distinct("cluster_id").alias("n")).collect()
    clusters = {s: 1 for s in targets} | {r["split"]: r["n"] for r in counted}
    limits = {s: min(cap, -(-5 * t // (4 * clusters[s]))) for s, t in targets.items()}
    place = [F.col("split"), F.col("gap_bin"), F.col("cluster_id")]
    numbered = _numbered(positives, ["gap_bin"], digest(seed, *place, F.col("pair_id")), max(limits.values()))
    quotas = {(gap,): {s: even_quotas(t)[gap] for s, t in targets.items()} for gap in GAP_BINS}
    sample = _taken(
        numbered, list(quotas), ["gap_bin"], lambda queues, length, step: _fill_totals(queues, length, quotas[step], limits),
        lambda gap: digest(seed, F.col("split"), F.lit(gap), F.col("cluster_id")),
    )
    if strict:
        _require_quotas(sample, {s: {"positive": t} for s, t in targets.items()})
    return sample


def template_quotas(positives: DataFrame, share: float = 0.5) -> DataFrame:
    """Per split, how many positives of each bin serve as templates for hard negatives."""
    n = {g: F.count_if(F.col("gap_bin") == g) for g in GAP_BINS}
    row = positives.groupBy("split").agg(*[v.alias(f"n_{g}") for g, v in n.items()])
    row = row.withColumn("_left", F.floor(F.expr(" + ".join(f"n_{g}" for g in GAP_BINS)) * share))
    for place, g in enumerate(GAP_BINS):
        part = F.bround(F.col("_left") / (len(GAP_BINS) - place)).cast("bigint")
        row = row.withColumn(f"hard_{g}", F.least(f"n_{g}", part)).withColumn("_left", F.col("_left") - F.col(f"hard_{g}"))
    return row.select(
        "split", F.explode(F.array(*[F.struct(F.lit(g).alias("gap_bin"), F.col(f"hard_{g}").alias("hard_quota")) for g in GAP_BINS])).alias("_q")
    ).select("split", "_q.*")


def split_templates(positives: DataFrame, seed, share: float = 0.5) -> DataFrame:
    """Add ``template_for``: hard for the first quota of each bin in hash order, else easy."""
    drawn = positives.withColumn("_draw", digest(seed, "template", F.col("pair_id")))
    placed = ranked(drawn, ["split", "gap_bin"], ["_draw", "pair_id"], slicer=hex_slice(F.col("_draw")))
    return (
        placed.join(template_quotas(positives, share), ["split", "gap_bin"])
        .withColumn("template_for", F.when(F.col("rank") < F.col("hard_quota"), "hard").otherwise("easy"))
        .drop("_draw", "rank", "size", "hard_quota")
    )


def log_controls(names: Mapping[str, Column]) -> dict[str, Column]:
    """log1p of each control; frames and gaps are added as they are by the caller."""
    return {name: F.log1p(value.cast("double")) for name, value in names.items()}


def balance_report(pairs: DataFrame, controls: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Standardized mean difference of hard and easy negatives from positives.

    Long rows (keys, comparison, control, smd); the pooled deviation is the root
    of the mean of both sample variances, 1 where that is 0.
    """
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("control"), c.cast("double").alias("value")) for n, c in controls.items()]))
    long = pairs.select(*keys, "kind", values.alias("_v")).select(*keys, "kind", "_v.*")
    moments = long.groupBy(*keys, "control").agg(
        *[F.avg(F.when(F.col("kind") == k, F.col("value"))).alias(f"mean_{k}") for k in ("positive", "hard", "easy")],
        *[F.var_samp(F.when(F.col("kind") == k, F.col("value"))).alias(f"var_{k}") for k in ("positive", "hard", "easy")],
    )

    def smd(kind: str) -> Column:
        pooled = F.sqrt((F.col("var_positive") + F.col(f"var_{kind}")) / 2)
        return F.abs(F.col(f"mean_{kind}") - F.col("mean_positive")) / F.when(pooled == 0, 1.0).otherwise(pooled)

    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("comparison"), smd(k).alias("smd")) for k in ("hard", "easy")]))
    return moments.select(*keys, "control", sides.alias("_s")).select(*keys, "_s.comparison", "control", "_s.smd")


def balance_gate(report: DataFrame, keys: Sequence[str] = (), gate: float = SMD_GATE) -> DataFrame:
    return (
        report.groupBy(*keys, "comparison")
        .agg(F.max("smd").alias("max_smd"), F.max_by("control", "smd").alias("worst_control"))
        .withColumn("passed", F.col("max_smd") <= gate)
    )


def require_balance(pairs: DataFrame, controls: Mapping[str, Column], keys: Sequence[str] = (), gate: float = SMD_GATE) -> DataFrame:
    """The gate's rows; a comparison that fails it is an error that names its worst control."""
    rows = materialize(balance_gate(balance_report(pairs, controls, keys), keys, gate))
    failed = rows.where(~F.coalesce("passed", F.lit(False))).orderBy(*keys, "comparison").limit(1).collect()
    if failed:
        place = "/".join(str(failed[0][k]) for k in (*keys, "comparison"))
        raise ValueError(f"{place}: largest SMD {failed[0]['max_smd']} ({failed[0]['worst_control']}) exceeds {gate}")
    return rows
