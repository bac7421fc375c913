"""Pair enumeration, capacity, sampling and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bins import GAP_BINS, gap_bin, object_bin
from ..functions.ids import digest, stable_id, unordered_pair_id
from ..operators import matching
from ..operators import pair_sampling as sampling
from ..operators import pairs as P
from ..operators.ordering import exact_quantiles
from ..session import materialize
from . import views as V
from .registry import query

KINDS = ("positive", "hard", "easy")
TARGETS = {
    "train": {"positive": 600, "hard": 300, "easy": 300},
    "dev": {"positive": 200, "hard": 100, "easy": 100},
    "test": {"positive": 150, "hard": 75, "easy": 75},
}
CAP = 40
RETAINED = 30
MATCH_TARGETS = {"train": 300, "dev": 120, "test": 60}

ATTRIBUTE_KIND = """CASE WHEN a.instance = b.instance THEN 'positive' WHEN a.category = b.category THEN 'hard' ELSE 'easy' END"""
GAP_SQL = "CASE WHEN {g} <= 5 THEN 'short' WHEN {g} <= 11 THEN 'medium' ELSE 'long' END"


def usable(spark, folder):
    """Observations that pass the area gate."""
    return V.observations(spark, folder).where(F.col("area") >= 1.0)


@query("A2_pair_capacity", f"""
WITH {V.OBS}
SELECT a.split, {ATTRIBUTE_KIND} AS kind, {GAP_SQL.format(g='b.frame - a.frame')} AS gap_bin, count(*) AS available
FROM obs a JOIN obs b ON a.cluster_id = b.cluster_id AND b.frame - a.frame BETWEEN 2 AND 23
WHERE a.area >= 1.0 AND b.area >= 1.0 GROUP BY ALL
""")
def pair_capacity(spark, folder):
    counts = P.band_pair_counts(usable(spark, folder), 2, 23, ["instance", "category", "split"])
    return (
        counts.withColumn("kind", P.kind_by_attributes("instance", ["category"]))
        .groupBy(F.col("split_a").alias("split"), "kind", gap_bin(F.col("gap")).alias("gap_bin"))
        .agg(F.sum("pairs").alias("available"))
    )


@query("A2_capacity_groupings", f"""
WITH {V.OBS}, listed AS (
SELECT a.split, {ATTRIBUTE_KIND} AS kind, {GAP_SQL.format(g='b.frame - a.frame')} AS gap_bin
FROM obs a JOIN obs b ON a.cluster_id = b.cluster_id AND b.frame - a.frame BETWEEN 2 AND 23)
SELECT coalesce(split, 'all') AS split, coalesce(kind, 'all') AS kind, coalesce(gap_bin, 'all') AS gap_bin, count(*) AS available
FROM listed GROUP BY GROUPING SETS ((split, kind, gap_bin), (split, kind), (split))
""")
def capacity_groupings(spark, folder):
    counts = P.band_pair_counts(V.observations(spark, folder), 2, 23, ["instance", "category", "split"])
    named = counts.select(
        F.col("split_a").alias("split"), P.kind_by_attributes("instance", ["category"]).alias("kind"),
        gap_bin(F.col("gap")).alias("gap_bin"), "pairs",
    )
    return P.capacity_report(named, [["split", "kind", "gap_bin"], ["split", "kind"], ["split"]], F.col("pairs"))


@query("J3_band_join", f"""
WITH {V.BAND}
SELECT cluster_id, observation_id_a, observation_id_b, gap FROM band
""")
def band_join(spark, folder):
    pairs = P.band_pairs(V.observations(spark, folder), V.LOW_GAP, V.HIGH_GAP, [])
    return pairs.select("cluster_id", "observation_id_a", "observation_id_b", "gap")


@query("J3_band_join_by_kind_and_bin", f"""
WITH {V.BAND}
SELECT CASE WHEN instance_a = instance_b THEN 'positive' WHEN category_a = category_b AND attribute_a % 4 = attribute_b % 4 THEN 'hard' ELSE 'easy' END AS kind,
  {GAP_SQL.format(g='gap')} AS gap_bin, count(*) AS pairs
FROM band WHERE gap >= 2 GROUP BY ALL
""")
def band_join_counts(spark, folder):
    look = V.observations(spark, folder).withColumn("look", F.col("attribute") % 4)
    counts = P.band_pair_counts(look, 2, 23, ["instance", "category", "look"])
    return (
        counts.withColumn("kind", P.kind_by_attributes("instance", ["category", "look"]))
        .groupBy("kind", gap_bin(F.col("gap")).alias("gap_bin"))
        .agg(F.sum("pairs").alias("pairs"))
    )


@query("J4_cross_frame_pairs", f"""
WITH {V.OBS}
SELECT a.cluster_id, count(*) AS all_pairs,
  count(*) FILTER (a.instance = b.instance) AS positive_pairs,
  count(*) FILTER (a.instance <> b.instance AND a.category = b.category) AS same_category_pairs,
  count(*) FILTER (a.category <> b.category) AS easy_pairs
FROM obs a JOIN obs b ON a.cluster_id = b.cluster_id AND a.frame < b.frame GROUP BY a.cluster_id
""")
def cross_frame_pairs(spark, folder):
    return P.cross_frame_capacity(V.observations(spark, folder), "instance", "category").where("all_pairs > 0")


@query("P11_gap_bins", f"""
WITH {V.BAND}
SELECT gap, {GAP_SQL.format(g='gap')} AS gap_bin, count(*) AS pairs FROM band GROUP BY ALL
""")
def gap_bins(spark, folder):
    counts = P.band_pair_counts(V.observations(spark, folder), V.LOW_GAP, V.HIGH_GAP, [])
    return counts.groupBy("gap", gap_bin(F.col("gap")).alias("gap_bin")).agg(F.sum("pairs").alias("pairs"))


@query("P12_object_bins", """
SELECT CASE WHEN n BETWEEN 3 AND 4 THEN '03-04' WHEN n BETWEEN 5 AND 6 THEN '05-06' WHEN n BETWEEN 7 AND 8 THEN '07-08'
  WHEN n BETWEEN 9 AND 10 THEN '09-10' ELSE 'other-' || lpad(n::VARCHAR, 2, '0') END AS object_bin, count(*) AS clusters
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1
""")
def object_bins(spark, folder):
    sizes = V.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(object_bin(F.col("n")).alias("object_bin")).agg(F.count(F.lit(1)).alias("clusters"))


@query("P13_kind_by_attributes", f"""
WITH {V.BAND}
SELECT split, CASE WHEN instance_a = instance_b THEN 'positive' WHEN category_a = category_b THEN 'hard' ELSE 'easy' END AS kind,
 count(*) AS pairs FROM band GROUP BY ALL
""")
def kinds_by_attributes(spark, folder):
    counts = P.band_pair_counts(V.observations(spark, folder), V.LOW_GAP, V.HIGH_GAP, ["instance", "category", "split"])
    return counts.groupBy(F.col("split_a").alias("split"), P.kind_by_attributes("instance", ["category"]).alias("kind")).agg(
        F.sum("pairs").alias("pairs")
    )


@query("P14_kind_by_scale", f"""
WITH {V.PAIRS} SELECT pair_id, kind, label, difficulty, gap_bin, ratio FROM pairs
""")
def kinds_by_scale(spark, folder):
    return V.pairs(spark, folder).select("pair_id", "kind", "label", "difficulty", "gap_bin", "ratio")


@query("P15_relation_labels", f"""
WITH {V.BAND}
SELECT CASE WHEN instance_a = instance_b THEN 'same_instance' WHEN category_a = category_b THEN 'same_category' ELSE 'different_category' END AS category_relation,
  CASE WHEN instance_a = instance_b THEN 'same_instance' WHEN asset_a = asset_b THEN 'same_asset_different_instance' ELSE 'different_asset' END AS asset_relation,
  CASE WHEN da AND db THEN 'dynamic-dynamic' WHEN da OR db THEN 'dynamic-static' ELSE 'static-static' END AS motion_status,
  count(*) AS pairs
FROM (SELECT *, attribute_a % 5 AS asset_a, attribute_b % 5 AS asset_b, instance_a IN ('click', 'purchase') AS da,
  instance_b IN ('click', 'purchase') AS db FROM band) GROUP BY ALL
""")
def relations(spark, folder):
    observed = V.observations(spark, folder).withColumns(
        {"asset": F.col("attribute") % 5, "dynamic": F.col("instance").isin("click", "purchase")}
    )
    counts = P.band_pair_counts(observed, V.LOW_GAP, V.HIGH_GAP, ["instance", "category", "asset", "dynamic"])
    labels = P.relation_labels("instance", "category", "asset", "dynamic")
    return counts.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.sum("pairs").alias("pairs"))


TARGET_ROWS = ", ".join(f"('{s}', '{k}', {t})" for s, per in TARGETS.items() for k, t in per.items())


@query("A3_capacity_gate", f"""
WITH {V.PAIRS}, target(split, kind, target) AS (VALUES {TARGET_ROWS})
SELECT t.split, t.kind, t.target, count(p.pair_id) AS available, round(count(p.pair_id) / t.target, 9) AS ratio, count(p.pair_id) >= t.target AS passed
FROM target t LEFT JOIN pairs p ON p.split = t.split AND p.kind = t.kind GROUP BY t.split, t.kind, t.target
""")
def capacity_gate(spark, folder):
    available = P.capacity_report(V.pairs(spark, folder), [["split", "kind"]])
    wanted = {(s, k): t for s, per in TARGETS.items() for k, t in per.items()}
    return P.capacity_gate(available, wanted, ["split", "kind"]).withColumn("ratio", F.round("ratio", 9))


@query("A5_contributing_clusters", f"""
WITH {V.PAIRS} SELECT split, kind, count(DISTINCT cluster_id) AS clusters FROM pairs GROUP BY ALL
""")
def contributing_clusters(spark, folder):
    once = V.pairs(spark, folder).groupBy("split", "kind", "cluster_id").count()
    return once.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("clusters"))


@query("A6_cluster_contributions", f"""
WITH {V.PAIRS}
SELECT split, kind, count(*) AS clusters, min(n) AS min_rows, max(n) AS max_rows, quantile_cont(n, 0.5) AS median_rows, max(n) <= {CAP} AS within_cap
FROM (SELECT split, kind, cluster_id, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY split, kind
""")
def cluster_contributions(spark, folder):
    return P.contribution_summary(V.pairs(spark, folder), ["split", "kind"], CAP)


@query("A9_scale_cutoff", f"""
WITH {V.BAND}, pool AS (SELECT split, gap_bin, ratio, row_number() OVER (PARTITION BY split, gap_bin ORDER BY ratio) - 1 AS rn, count(*) OVER (PARTITION BY split, gap_bin) AS n
  FROM (SELECT *, {GAP_SQL.format(g='gap')} AS gap_bin FROM band) WHERE instance_a <> instance_b AND category_a = category_b)
SELECT split, gap_bin, n, round(max(ratio) FILTER (rn = CAST(ceil((n - 1) * 0.25) AS BIGINT)), 9) AS cutoff,
  round(max(ratio) FILTER (rn = CAST(ceil((n - 1) * 0.5) AS BIGINT)), 9) AS middle
FROM pool GROUP BY split, gap_bin, n
""")
def scale_cutoffs(spark, folder):
    band = V.banded(spark, folder).withColumn("gap_bin", gap_bin(F.col("gap")))
    pool = band.where((F.col("instance_a") != F.col("instance_b")) & (F.col("category_a") == F.col("category_b")))
    found = exact_quantiles(pool, ["split", "gap_bin"], "ratio", {"cutoff": 0.25, "middle": 0.5}, "higher")
    return found.withColumns({c: F.round(c, 9) for c in ("cutoff", "middle")})


@query("F1_stable_ids", f"""
WITH {V.OBS} SELECT observation_id, substr(sha256('obs|' || cluster_id || '|' || frame || '|' || instance), 1, 20) AS stable_id FROM obs
""")
def stable_ids(spark, folder):
    return V.observations(spark, folder).select(
        "observation_id", stable_id("obs", F.col("cluster_id"), F.col("frame"), F.col("instance")).alias("stable_id")
    )


@query("F2_unordered_pair_keys", f"""
WITH {V.BAND}
SELECT split, count(*) AS pairs, count(DISTINCT substr(sha256('pair|' || least(observation_id_a, observation_id_b) || '|' || greatest(observation_id_a, observation_id_b)), 1, 24)) AS ids,
  min(substr(sha256('pair|' || least(observation_id_a, observation_id_b) || '|' || greatest(observation_id_a, observation_id_b)), 1, 24)) AS first_id
FROM band GROUP BY split
""")
def unordered_keys(spark, folder):
    band = V.banded(spark, folder)
    # Ids are asked for with the endpoints swapped: the order must not matter.
    ids = band.select("split", unordered_pair_id(F.col("observation_id_b"), F.col("observation_id_a"), "pair").alias("pair_id"))
    per_id = ids.groupBy("split", "pair_id").agg(F.count(F.lit(1)).alias("copies"))
    return per_id.groupBy("split").agg(
        F.sum("copies").alias("pairs"), F.count(F.lit(1)).alias("ids"), F.min("pair_id").alias("first_id")
    )


@query("F3_seeded_hash_order", f"""
WITH {V.OBS} SELECT cluster_id, observation_id, row_number() OVER (PARTITION BY cluster_id ORDER BY sha256('7|' || cluster_id || '|' || observation_id)) AS place
FROM obs QUALIFY place <= 3
""")
def seeded_order(spark, folder):
    draw = digest(7, F.col("cluster_id"), F.col("observation_id"))
    order = Window.partitionBy("cluster_id").orderBy(draw)
    return V.observations(spark, folder).select("cluster_id", "observation_id", F.row_number().over(order).alias("place")).where("place <= 3")


RETAIN_SQL = f"""retained AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY cluster_id, kind, gap_bin
    ORDER BY sha256('{V.SEED}|' || split || '|' || kind || '|' || gap_bin || '|' || pair_id), pair_id) <= {RETAINED})"""


def retained(spark, folder, pair_table=None):
    source = pair_table if pair_table is not None else V.pairs(spark, folder)
    draw = digest(V.SEED, F.col("split"), F.col("kind"), F.col("gap_bin"), F.col("pair_id"))
    return sampling.hash_top(source, ["cluster_id", "kind", "gap_bin"], RETAINED, draw, "pair_id")


@query("W2_retained_candidates", f"WITH {V.PAIRS}, {RETAIN_SQL} SELECT pair_id, cluster_id, kind, gap_bin FROM retained")
def retained_candidates(spark, folder):
    return retained(spark, folder).select("pair_id", "cluster_id", "kind", "gap_bin")


def quota_sql() -> str:
    parts, steps = [], 0
    for kind in KINDS:
        for gap in GAP_BINS:
            goal = " ".join(f"WHEN '{s}' THEN {sampling.even_quotas(per[kind])[gap]}" for s, per in TARGETS.items())
            tag = f"{V.SEED}|' || split || '|{kind}|{gap}|' || cluster_id"
            prior = f"coalesce((SELECT n FROM cnt{steps} c WHERE c.cluster_id = q.cluster_id), 0)" if steps else "0"
            parts.append(f"""
q{steps} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY split, cluster_id ORDER BY sha256('{tag} || '|' || pair_id), pair_id) AS rn
  FROM pairs WHERE kind = '{kind}' AND gap_bin = '{gap}'),
p{steps} AS (SELECT q.*, {prior} AS prior FROM q{steps} q),
s{steps} AS MATERIALIZED (SELECT * EXCLUDE (pos, rn, prior) FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY prior + rn - 1, sha256('{tag}), cluster_id) AS pos
  FROM p{steps} WHERE prior + rn - 1 < {CAP}) WHERE pos <= CASE split {goal} END),""")
            steps += 1
            every = " UNION ALL ".join(f"SELECT cluster_id FROM s{i}" for i in range(steps))
            parts.append(f"cnt{steps} AS MATERIALIZED (SELECT cluster_id, count(*) AS n FROM ({every}) GROUP BY 1),")
    return "".join(parts) + "sample AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(steps)) + ")"


SAMPLE_SQL = f"WITH {V.PAIRS}, {quota_sql()}"


def quota_sample(spark, folder, pair_table=None):
    source = pair_table if pair_table is not None else V.staged_pairs(spark, folder)
    return sampling.balanced_quota_sample(source, TARGETS, CAP, V.SEED, strict=True)


@query("W3_balanced_quota_sample", SAMPLE_SQL + " SELECT pair_id, split, kind, gap_bin, cluster_id FROM sample")
def balanced_sample(spark, folder):
    return quota_sample(spark, folder).select("pair_id", "split", "kind", "gap_bin", "cluster_id")


@query("W11_contribution_cap", f"""
WITH {V.PAIRS}, prior AS (SELECT cluster_id, count(*) AS n FROM pairs WHERE kind = 'hard' GROUP BY 1)
SELECT pair_id, cluster_id FROM (SELECT p.pair_id, p.cluster_id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY p.cluster_id ORDER BY p.pair_id) AS rn
  FROM pairs p LEFT JOIN prior USING (cluster_id) WHERE kind = 'positive') WHERE n + rn <= {CAP}
""")
def contribution_cap(spark, folder):
    pairs = V.staged_pairs(spark, folder)
    prior = pairs.where("kind = 'hard'").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("prior"))
    rows = pairs.where("kind = 'positive'").join(prior, "cluster_id", "left")
    return sampling.capped(rows, F.coalesce("prior", F.lit(0)), CAP, ["cluster_id"], ["pair_id"]).select("pair_id", "cluster_id")


@query("T3_even_quotas", f"""
WITH {V.PAIRS}, totals AS (SELECT split, kind, count(*) // 2 AS total FROM pairs GROUP BY ALL),
bins(gap_bin, place) AS (VALUES ('short', 0), ('medium', 1), ('long', 2))
SELECT split, kind, gap_bin, total // 3 + CASE WHEN place < total % 3 THEN 1 ELSE 0 END AS quota FROM totals, bins
""")
def even_quotas(spark, folder):
    totals = V.pairs(spark, folder).groupBy("split", "kind").agg(F.expr("count(1) div 2").alias("total"))
    quotas = [
        F.struct(F.lit(g).alias("gap_bin"), (F.expr("total div 3") + F.when(F.lit(i) < F.col("total") % 3, 1).otherwise(0)).alias("quota"))
        for i, g in enumerate(GAP_BINS)
    ]
    return totals.select("split", "kind", F.explode(F.array(*quotas)).alias("_q")).select("split", "kind", "_q.*")


def positives_sql() -> str:
    parts = []
    limit = "(SELECT least(" + str(CAP) + ", (5 * t + 4 * n - 1) // (4 * n)) FROM shares WHERE shares.split = u.split)"
    goals = " ".join(f"WHEN '{s}' THEN {n}" for s, n in MATCH_TARGETS.items())
    parts.append(f"shares AS MATERIALIZED (SELECT split, count(DISTINCT cluster_id) AS n, CASE split {goals} END AS t FROM pairs WHERE kind = 'positive' GROUP BY split),")
    for i, gap in enumerate(GAP_BINS):
        goal = " ".join(f"WHEN '{s}' THEN {sampling.even_quotas(t)[gap]}" for s, t in MATCH_TARGETS.items())
        tag = f"{V.SEED}|' || split || '|{gap}|' || cluster_id"
        every = " UNION ALL ".join(f"SELECT cluster_id FROM t{j}" for j in range(i))
        prior = f"coalesce((SELECT count(*) FROM ({every}) c WHERE c.cluster_id = q.cluster_id), 0)" if i else "0"
        parts.append(f"""
r{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY split, cluster_id ORDER BY sha256('{tag} || '|' || pair_id), pair_id) AS rn FROM pairs WHERE kind = 'positive' AND gap_bin = '{gap}'),
u{i} AS (SELECT q.*, {prior} AS prior FROM r{i} q),
t{i} AS MATERIALIZED (SELECT * EXCLUDE (rn, prior, pos) FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rn - 1, prior + rn - 1, sha256('{tag}), cluster_id) AS pos
  FROM u{i} u WHERE prior + rn - 1 < {limit}) WHERE pos <= CASE split {goal} END),""")
    return "".join(parts) + "chosen AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"


TEMPLATE_SQL = """,
counted AS (SELECT split, count(*) FILTER (gap_bin = 'short') AS n1, count(*) FILTER (gap_bin = 'medium') AS n2, count(*) FILTER (gap_bin = 'long') AS n3 FROM chosen GROUP BY split),
h1 AS (SELECT *, (n1 + n2 + n3) // 2 AS h, least(n1, CAST(round_even(((n1 + n2 + n3) // 2) / 3, 0) AS BIGINT)) AS k1 FROM counted),
h2 AS (SELECT *, least(n2, CAST(round_even((h - k1) / 2, 0) AS BIGINT)) AS k2 FROM h1),
quota AS (SELECT split, k1, k2, least(n3, h - k1 - k2) AS k3 FROM h2),
templates AS (SELECT c.*, CASE WHEN row_number() OVER (PARTITION BY c.split, gap_bin ORDER BY sha256('42|template|' || pair_id), pair_id)
  <= CASE gap_bin WHEN 'short' THEN k1 WHEN 'medium' THEN k2 ELSE k3 END THEN 'hard' ELSE 'easy' END AS template_for FROM chosen c JOIN quota q ON c.split = q.split)"""


def chosen_positives(pair_table):
    return sampling.two_level_quota_sample(pair_table.where("kind = 'positive'"), MATCH_TARGETS, CAP, V.SEED, strict=True)


@query("W4_two_level_quota_sample", f"WITH {V.PAIRS}, {positives_sql()} SELECT pair_id, split, gap_bin, cluster_id FROM chosen")
def two_level_sample(spark, folder):
    return chosen_positives(V.pairs(spark, folder)).select("pair_id", "split", "gap_bin", "cluster_id")


@query("T11_template_partition", f"WITH {V.PAIRS}, {positives_sql()}{TEMPLATE_SQL} SELECT pair_id, split, gap_bin, template_for FROM templates")
def template_partition(spark, folder):
    return sampling.split_templates(chosen_positives(V.pairs(spark, folder)), V.SEED).select("pair_id", "split", "gap_bin", "template_for")


CONTROLS = ("c_frame_a", "c_frame_b", "c_gap", "c_area_a", "c_area_b", "c_attribute_a", "c_attribute_b")


def with_controls(pairs):
    logs = sampling.log_controls({f"c_{n}": F.col(n) for n in ("area_a", "area_b", "attribute_a", "attribute_b")})
    plain = {f"c_{n}": F.col(n).cast("double") for n in ("frame_a", "frame_b", "gap")}
    return pairs.withColumns({**plain, **logs})


@query("F5_control_vectors", f"""
WITH {V.PAIRS} SELECT pair_id, frame_a, frame_b, gap, round(ln(1 + area_a), 9) AS area_a, round(ln(1 + area_b), 9) AS area_b,
 round(ln(1 + attribute_a), 9) AS attribute_a, round(ln(1 + attribute_b), 9) AS attribute_b FROM pairs
""")
def control_vectors(spark, folder):
    pairs = with_controls(V.pairs(spark, folder))
    return pairs.select(
        "pair_id", "frame_a", "frame_b", "gap",
        *[F.round(f"c_{n}", 9).alias(n) for n in ("area_a", "area_b", "attribute_a", "attribute_b")],
    )


SMD_SQL = """ , controls AS (SELECT split, kind, unnest(['c_frame_a', 'c_frame_b', 'c_gap', 'c_area_a', 'c_area_b', 'c_attribute_a', 'c_attribute_b']) AS control,
  unnest([frame_a, frame_b, gap, ln(1 + area_a), ln(1 + area_b), ln(1 + attribute_a), ln(1 + attribute_b)]) AS v FROM {src}),
m AS (SELECT split, kind, control, avg(v) AS mu, var_samp(v) AS va FROM controls GROUP BY ALL),
smd AS (SELECT n.split, n.kind AS comparison, n.control, abs(n.mu - p.mu) / CASE WHEN p.va + n.va = 0 THEN 1 ELSE sqrt((p.va + n.va) / 2) END AS smd
  FROM m n JOIN m p ON n.split = p.split AND n.control = p.control AND p.kind = 'positive' WHERE n.kind <> 'positive')"""


@query("A13_balance_report", f"WITH {V.PAIRS} {SMD_SQL.format(src='pairs')} SELECT split, comparison, control, round(smd, 8) AS smd FROM smd")
def balance_report(spark, folder):
    pairs = with_controls(V.pairs(spark, folder))
    return sampling.balance_report(pairs, {c: F.col(c) for c in CONTROLS}, ["split"]).withColumn("smd", F.round("smd", 8))


@query("A13_balance_gate", SAMPLE_SQL + SMD_SQL.format(src="sample") + """
SELECT split, comparison, round(max(smd), 8) AS max_smd, max_by(control, smd) AS worst_control, max(smd) <= 0.1 AS passed FROM smd GROUP BY split, comparison""")
def balance_gate(spark, folder):
    pairs = with_controls(quota_sample(spark, folder))
    report = sampling.balance_report(pairs, {c: F.col(c) for c in CONTROLS}, ["split"])
    return sampling.balance_gate(report, ["split"]).withColumn("max_smd", F.round("max_smd", 8))


def matched(spark, folder, pairs=None):
    pairs = with_controls(V.staged_pairs(spark, folder)) if pairs is None else pairs
    templates = materialize(sampling.split_templates(chosen_positives(pairs), V.SEED))
    used = templates.groupBy("split", "cluster_id").agg(F.count(F.lit(1)).alias("used"))
    lanes = ["split", "kind"]
    goals = templates.withColumn("kind", F.explode(F.array(F.lit("hard"), F.lit("easy"))))
    found = matching.match_negatives(
        templates.withColumn("kind", F.col("template_for")), pairs.where("kind <> 'positive'"), CONTROLS, MATCH_CAP, used,
        lanes=lanes, grid=["c_area_a", "c_area_b"], goals=goals,
    )
    return templates, found


MATCH_CAP = 60


@query("J14_matched_negatives")
def matched_negatives(spark, folder):
    _, found = matched(spark, folder)
    return found.select("split", "kind", "gap_bin", "template_id", "negative_id", "cluster_id", "exact_frames", F.round("distance", 6).alias("distance"))


@query("J14_matching_invariants", f"""
WITH {V.PAIRS}, {positives_sql()}{TEMPLATE_SQL}
SELECT split, template_for AS kind, count(*) AS templates, count(*) AS matched, count(*) AS distinct_negatives, 0 AS wrong_kind, 0 AS wrong_bin, 0 AS wrong_split
FROM templates GROUP BY ALL
""")
def matching_invariants(spark, folder):
    templates, found = matched(spark, folder)
    pairs = V.pairs(spark, folder).select(
        F.col("pair_id").alias("negative_id"), F.col("kind").alias("true_kind"), F.col("gap_bin").alias("negative_bin"), F.col("split").alias("negative_split")
    )
    checked = found.join(pairs, "negative_id").groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("matched"), F.count_distinct("negative_id").alias("distinct_negatives"),
        F.count_if(F.col("kind") != F.col("true_kind")).alias("wrong_kind"),
        F.count_if(F.col("gap_bin") != F.col("negative_bin")).alias("wrong_bin"),
        F.count_if(F.col("split") != F.col("negative_split")).alias("wrong_split"),
    )
    asked = templates.groupBy("split", F.col("template_for").alias("kind")).agg(F.count(F.lit(1)).alias("templates"))
    return asked.join(checked, ["split", "kind"], "left")


@query("A13_matched_gate")
def matched_gate(spark, folder):
    """The balance gate over the positives and the negatives matched to them, a row per split and kind."""
    pairs = with_controls(V.staged_pairs(spark, folder))
    templates, found = matched(spark, folder, pairs)
    negatives = pairs.join(found.select(F.col("negative_id").alias("pair_id")), "pair_id", "left_semi")
    both = templates.select("split", "kind", *CONTROLS).unionByName(negatives.select("split", "kind", *CONTROLS))
    return sampling.balance_gate(sampling.balance_report(both, {c: F.col(c) for c in CONTROLS}, ["split"]), ["split"])


@query("J17_template_links", f"""
WITH {V.PAIRS}, {positives_sql()}{TEMPLATE_SQL}
SELECT pair_id AS template_id, split, template_for AS kind, gap_bin AS template_bin, 1 AS links FROM templates
""")
def template_links(spark, folder):
    templates, found = matched(spark, folder)
    linked = found.join(templates.select(F.col("pair_id").alias("template_id"), F.col("gap_bin").alias("template_bin")), "template_id")
    return linked.groupBy("template_id", "split", "kind", "template_bin").agg(F.count(F.lit(1)).alias("links"))


@query("A38_pair_definition_audit", SAMPLE_SQL + f"""
SELECT s.split, count(*) AS rows, count(*) FILTER (kind = 'positive') AS positive, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'easy') AS easy,
  max(c.n) AS largest_contribution, 0 AS violation_count, true AS definitions_hold, max(c.n) <= {CAP} AS cap_respected
FROM sample s JOIN cnt9 c USING (cluster_id) GROUP BY s.split""")
def definition_audit(spark, folder):
    pairs = V.staged_pairs(spark, folder)
    cutoff = V.cutoff(spark, folder)
    return P.pair_definition_audit(quota_sample(spark, folder, pairs), cutoff, CAP).drop("violations")


@query("A38_pair_violations", f"""WITH {V.PAIRS}
SELECT split, 'positive_identity' AS rule, count(*) AS violations FROM pairs WHERE kind = 'easy' AND gap_bin = 'short' GROUP BY 1
UNION ALL SELECT split, 'easy_definition', count(*) FROM pairs WHERE kind = 'positive' AND gap_bin = 'long' GROUP BY 1
UNION ALL SELECT split, 'duplicate', count(*) FROM pairs WHERE gap = 7 GROUP BY 1""")
def violations(spark, folder):
    """The violations, counted, of the pair table with faults put in: near easy pairs called
    positive, far positives called easy, and pairs of one gap written twice."""
    pairs = V.staged_pairs(spark, folder)
    wrong = F.when((F.col("kind") == "easy") & (F.col("gap_bin") == "short"), "positive").when((F.col("kind") == "positive") & (F.col("gap_bin") == "long"), "easy")
    faulty = pairs.withColumn("kind", F.coalesce(wrong, "kind"))
    # The second copies keep their right kind, so they break no rule but that of being copies.
    found = P.pair_violations(faulty.unionByName(pairs.where("gap = 7")), V.cutoff(spark, folder))
    return found.groupBy("split", "rule").agg(F.count(F.lit(1)).alias("violations"))


@query("F29_visibility_pair_counts", f"""
WITH {V.OBS}, seen AS (SELECT DISTINCT cluster_id, instance, category, frame % 24 AS frame FROM obs WHERE area >= 10)
SELECT c.cluster_id, c.instances, c.usable AS usable_observations, coalesce(p.positive_pairs, 0) AS positive_pairs, coalesce(p.hard_pairs, 0) AS hard_pairs
FROM (SELECT o.cluster_id, count(DISTINCT o.instance) AS instances, (SELECT count(*) FROM seen s WHERE s.cluster_id = o.cluster_id) AS usable FROM obs o GROUP BY o.cluster_id) c
LEFT JOIN (SELECT a.cluster_id, count(*) FILTER (a.instance = b.instance) AS positive_pairs,
    count(*) FILTER (a.instance < b.instance AND a.category = b.category) AS hard_pairs
  FROM seen a JOIN seen b ON a.cluster_id = b.cluster_id AND abs(a.frame - b.frame) BETWEEN 2 AND 23 GROUP BY 1) p USING (cluster_id)
""")
def visibility_pairs(spark, folder):
    return P.visibility_pair_counts(inventory(spark, folder), "visibility", 10, 2, 23, ["category"])


def inventory(spark, folder):
    """One row per cluster: a 24-frame visibility array for each of its instances."""
    hourly = V.observations(spark, folder).groupBy("cluster_id", "instance", "category", (F.col("frame") % 24).alias("slot")).agg(
        F.max(F.floor("area")).alias("pixels")
    )
    per_instance = hourly.groupBy("cluster_id", "instance", "category").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "pixels"))).alias("_m")
    ).withColumn("frames", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint")), lambda t: F.coalesce(F.col("_m")[t], F.lit(0).cast("bigint"))))
    # At most one entry per event type and 24 slots each, so the arrays are small.
    rows = per_instance.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("instance", "category", "frames"))).alias("_rows"))
    return rows.select("cluster_id", F.col("_rows.frames").alias("visibility"), F.col("_rows.category").alias("category"), F.col("_rows.instance").alias("instance"))
