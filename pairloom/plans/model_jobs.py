"""Fitting, locking, scoring, transfer and the noise study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import hash_integer
from ..functions.numbers import rounded_to
from ..operators import bootstrap as B
from ..operators import features as X
from ..operators import metrics as M
from ..operators import model as L
from ..operators import points as PT
from ..operators import stress as T
from ..session import fresh_path, short_methods, stage
from . import views as V
from .feature_jobs import ALL_SQL, DONOR, EXTENT_SQL, donors, endpoint, shuffled, wide_features, with_extent
from .metric_jobs import REPLICATES, draws_sql, replicate_sql
from .point_jobs import SUMMARY, summarized
from .registry import query

SIMPLE = ("ratio", "gap", "near")

# Locked coefficients, as an earlier run would have stored them.
LOCKED = {
    "A": L.Linear(("ratio",), (1.2,), (0.9,), (-1.1,), -0.4),
    "B": L.Linear(("ratio", "gap"), (1.2, 11.0), (0.9, 6.5), (-1.0, -0.3), -0.5),
    "C": L.Linear(SIMPLE, (1.2, 11.0, 33.0), (0.9, 6.5, 23.0), (-1.0, -0.3, -0.2), -0.6),
}
THRESHOLDS = {"A": (0.42, 0.2), "B": (0.4, 0.2), "C": (0.38, 0.18)}


def simple_features(spark, folder):
    pairs = V.staged_pairs(spark, folder)
    return pairs.select(
        "pair_id", "cluster_id", "split", "label", "kind", "gap_bin", "ratio", F.col("gap").cast("double").alias("gap"),
        F.abs(F.col("attribute_a") - F.col("attribute_b")).cast("double").alias("near"),
    )


def locked():
    return L.Lock(LOCKED, {s: t[0] for s, t in THRESHOLDS.items()}, {s: t[1] for s, t in THRESHOLDS.items()})


def margin_sql(m: L.Linear) -> str:
    return f"{m.intercept} + " + " + ".join(f"({c}) * ({f} - {mu}) / {d}" for f, mu, d, c in zip(m.features, m.means, m.deviations, m.coefficients))


SIMPLE_SQL = f"""WITH {V.PAIRS}, sf AS (SELECT pair_id, cluster_id, split, label, kind, gap_bin, ratio, gap::DOUBLE AS gap, abs(attribute_a - attribute_b)::DOUBLE AS near FROM pairs),
ls AS ({" UNION ALL ".join(f"SELECT sf.*, '{s}' AS system, 1 / (1 + exp(-({margin_sql(m)}))) AS score, {THRESHOLDS[s][0]} AS f1_threshold, {THRESHOLDS[s][1]} AS recall_threshold FROM sf" for s, m in LOCKED.items())})"""


@query("M1_logistic_fit")
def logistic_fit(spark, folder):
    """Coefficients with the gradient of the objective, which is zero at the optimum."""
    table = simple_features(spark, folder)
    model = L.fit(table, SIMPLE, 1.0)
    slopes = L.gradient(table, model)
    rows = [("intercept", model.intercept, slopes[0]), *zip(SIMPLE, model.coefficients, slopes[1:])]
    return spark.createDataFrame([(n, float(c), float(g)) for n, c, g in rows], "term string, coefficient double, gradient double").select(
        "term", F.round("coefficient", 6).alias("coefficient"), F.round("gradient", 6).alias("gradient")
    )


@query("M1_zero_gradient", f"""{SIMPLE_SQL} SELECT term, 0.0 AS gradient, (SELECT count(*) FROM sf WHERE split = 'train') AS rows FROM (VALUES ('intercept'), ('ratio'), ('gap'), ('near')) t(term)""")
def zero_gradient(spark, folder):
    table = simple_features(spark, folder)
    slopes = L.gradient(table, L.fit(table, SIMPLE, 1.0))
    rows = spark.createDataFrame([(n, float(g)) for n, g in zip(("intercept", *SIMPLE), slopes)], "term string, gradient double")
    trained = table.where("split = 'train'").agg(F.count(F.lit(1)))
    return rows.select("term", F.abs(F.round("gradient", 5)).alias("gradient"), trained.scalar().alias("rows"))


@query("M2_regularization_grid")
def regularization_grid(spark, folder):
    best, aurocs = L.choose_regularization(simple_features(spark, folder), SIMPLE)
    return aurocs.select("regularization", F.round("auroc", 9).alias("auroc"), (F.col("regularization") == best.regularization).alias("chosen"))


@query("M3_lock_before_test")
def lock_before_test(spark, folder):
    """Fit and lock on a store whose test split is sealed until the lock exists."""
    store = L.SealedSplits.store(simple_features(spark, folder), fresh_path(spark, "sealed"))
    models, _ = L.fit_grid(store.fitting(spark), {s: m.features for s, m in LOCKED.items()}, [1.0])
    held = L.lock({s: m for (s, _), m in models.items()}, store.fitting(spark))
    scored = store.scored_test(spark, held, ["pair_id", "label"])
    return scored.select("pair_id", "system", F.round("score", 6).alias("score"), "f1_match", "recall_match")


@query("S10_locked_model_table", f"""{SIMPLE_SQL} SELECT system, count(*) AS pairs, round(avg(score), 9) AS mean_score, count(*) FILTER (score >= f1_threshold) AS f1_matches, count(*) FILTER (score >= recall_threshold) AS recall_matches FROM ls GROUP BY 1""")
def locked_table(spark, folder):
    """Through the stored form of the lock and back."""
    held = L.Lock.read(locked().table(spark))
    scored = held.score(simple_features(spark, folder), ["pair_id"])
    return scored.groupBy("system").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("score"), 9).alias("mean_score"), F.count_if("f1_match").alias("f1_matches"), F.count_if("recall_match").alias("recall_matches")
    )


@query("M4_frozen_scoring", f"{SIMPLE_SQL} SELECT pair_id, round(score, 9) AS score, score >= f1_threshold AS f1_match, score >= recall_threshold AS recall_match FROM ls WHERE system = 'C'")
def frozen_scoring(spark, folder):
    held = locked()
    one = L.Lock({"C": held.models["C"]}, held.f1, held.recall)
    return one.score(simple_features(spark, folder), ["pair_id"]).select("pair_id", F.round("score", 9).alias("score"), "f1_match", "recall_match")


def flat_model(features) -> L.Linear:
    """A scorer with the same weight on every feature."""
    n = len(features)
    return L.Linear(tuple(features), (0.0,) * n, (1.0,) * n, (-1.0 / n,) * n, 0.5)


@query("M5_system_sweep", f"""{ALL_SQL}, s AS ({" UNION ALL ".join(f"SELECT pair_id, split, label, '{s}' AS system, 1 / (1 + exp(-(0.5 - ({' + '.join(f)}) / {len(f)}))) AS score FROM wide" for s, f in X.SYSTEMS.items())}),
k AS (SELECT split, system, score, label FROM s)
SELECT p.split, p.system, count(*) AS comparisons, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 5) AS auroc
FROM k p JOIN k n ON p.split = n.split AND p.system = n.system AND p.label = 1 AND n.label = 0 WHERE p.split <> 'train' GROUP BY ALL""")
def system_sweep(spark, folder):
    wide = wide_features(spark, folder, with_shuffled=True).where("split <> 'train'")
    scored = L.scored_by(wide, {s: flat_model(f) for s, f in X.SYSTEMS.items()}, ["pair_id", "split", "label"])
    out = M.ranking_metrics(M.score_ladder(scored, ["split", "system"]), ["split", "system"])
    return out.select("split", "system", (F.col("positives") * F.col("negatives")).alias("comparisons"), F.round("auroc", 5).alias("auroc"))


def fitting_store(spark, folder):
    """All features of all pairs, packed and stored by split."""
    names = sorted({f for features in X.SYSTEMS.values() for f in features})
    return L.PackedSplits.store(wide_features(spark, folder, with_shuffled=True), fresh_path(spark, "sealed"), names)


@query("M5_fitted_systems")
def fitted_systems(spark, folder):
    """All eight systems over the whole grid, chosen and locked on dev, then scored on test:
    one row per system with its C and its metrics at the locked threshold."""
    with short_methods(spark):
        store = fitting_store(spark, folder)
        held = store.sweep(spark, X.SYSTEMS)
        scored = stage(store.scored_test(spark, held), "scored")
    ranks = M.ranking_metrics(M.score_ladder(scored, ["system"]), ["system"]).select("system", F.round("auroc", 6).alias("auroc"))
    at = scored.groupBy("system").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.count_if(F.col("recall_match") & (F.col("label") == 1)) / F.sum("label"), 6).alias("recall"),
        F.round(F.count_if(F.col("recall_match") & (F.col("label") == 0)) / F.count_if(F.col("label") == 0), 6).alias("false_match_rate"),
    )
    chosen = spark.createDataFrame([(s, m.regularization) for s, m in held.models.items()], "system string, regularization double")
    return ranks.join(at, "system").join(F.broadcast(chosen), "system")  # a row per system


@query("M5_fitted_gradients", f"""{ALL_SQL} SELECT system, c AS regularization, 0.0 AS gradient, (SELECT count(*) FROM pairs WHERE split = 'train') AS rows
FROM (VALUES {', '.join(f"('{s}')" for s in X.SYSTEMS)}) s(system), (VALUES {', '.join(f"({c}::DOUBLE)" for c in L.GRID)}) g(c)""")
def fitted_gradients(spark, folder):
    """The gradient of every system at every C, computed anew from the weights: zero at an optimum."""
    with short_methods(spark):
        table = stage(wide_features(spark, folder, with_shuffled=True).where("split = 'train'"), "features")
        models, _ = L.fit_grid(table, X.SYSTEMS)
        slopes = L.gradients(table, {f"{i}": m for i, m in enumerate(models.values())})
    rows = [(s, float(c), float(abs(round(slopes[f"{i}"], 6)))) for i, (s, c) in enumerate(models)]
    trained = table.agg(F.count(F.lit(1)))
    return spark.createDataFrame(rows, "system string, regularization double, gradient double").withColumn("rows", trained.scalar())


@query("M8_reproduction_check", f"""{SIMPLE_SQL} SELECT system, count(*) FILTER (split <> 'train') AS compared, count(*) FILTER (split = 'train') AS unmatched, round(max(abs(score - round(score, 4))) FILTER (split <> 'train'), 9) AS largest_difference FROM ls GROUP BY 1""")
def reproduction_check(spark, folder):
    """Against the stored scores of an earlier run, which kept four digits and no train rows."""
    table = stage(simple_features(spark, folder), "features")
    earlier = locked().score(table.where("split <> 'train'"), ["pair_id"]).select("pair_id", "system", F.round("score", 4).alias("score"))
    ours = L.Lock.read(locked().table(spark)).score(table, ["pair_id"])
    return L.largest_difference(ours, stage(earlier, "earlier")).withColumn("largest_difference", F.round("largest_difference", 9))


# Two datasets without a common cluster: the clusters are dealt by a hash.
DATASET = ("source", "target")


def dataset_of(cluster):
    return F.when(F.pmod(hash_integer("dataset", cluster), F.lit(2)) == 0, DATASET[0]).otherwise(DATASET[1])


def flags(scored):
    """One row per pair: whether the target's own lock matches it, and whether the source's does."""
    return scored.groupBy("pair_id", "cluster_id", "label").agg(
        F.bool_or((F.col("system") == DATASET[1]) & F.col("recall_match")).alias("ref"), F.bool_or((F.col("system") == DATASET[0]) & F.col("recall_match")).alias("cmp")
    )


def transferred(scored, seed):
    """Paired intervals of the source's lock against the target's own, on the target's test pairs."""
    draws = B.cluster_draws(scored, REPLICATES, seed)
    auroc = B.replicate_auc_difference(scored, draws, DATASET[1], DATASET[0]).withColumn("metric", F.lit("auroc"))
    fmr = B.replicate_rate_difference(flags(scored), draws, 0, F.col("ref"), F.col("cmp")).withColumn("metric", F.lit("false_match_rate"))
    out = B.interval(auroc.unionByName(fmr), ["metric"], "delta").drop("standard_error")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "ci_low", "ci_high")})


# Each dataset's scorer, as its fit would give it; thresholds come from that dataset's dev pairs.
TRANSFER = {"source": LOCKED["A"], "target": LOCKED["C"]}
TRANSFER_SQL = f"""{SIMPLE_SQL.rsplit("ls AS (", 1)[0]}ds AS (SELECT *, CASE WHEN ('0x' || substr(sha256('dataset|' || cluster_id), 1, 8))::BIGINT % 2 = 0 THEN 'source' ELSE 'target' END AS dataset FROM sf),
ts AS ({" UNION ALL ".join(f"SELECT ds.*, '{d}' AS system, round(1 / (1 + exp(-({margin_sql(m)}))), 9) AS score FROM ds" for d, m in TRANSFER.items())}),
tl AS (SELECT dataset, score, sum(label) AS pos FROM ts WHERE dataset = system AND split = 'dev' GROUP BY ALL),
tc AS (SELECT *, sum(pos) OVER (PARTITION BY dataset ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY dataset) AS np, lead(score) OVER (PARTITION BY dataset ORDER BY score DESC) AS below FROM tl),
th AS (SELECT dataset AS system, coalesce((score + below) / 2, '-infinity'::DOUBLE) AS recall_threshold FROM tc WHERE tp / np >= 0.9 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC) = 1),
lt AS (SELECT ts.*, recall_threshold FROM ts JOIN th USING (system) WHERE dataset = 'target' AND split = 'test')"""
TRANSFER_DRAWS = draws_sql("transfer", "SELECT DISTINCT cluster_id FROM lt", "x")


@query("M7_transfer", f"""{TRANSFER_SQL}{TRANSFER_DRAWS}{replicate_sql("SELECT * FROM lt", 'system', 'xw')},
d AS (SELECT a.replicate, a.auroc - c.auroc AS delta FROM rm a JOIN rm c USING (replicate) WHERE a.system = 'source' AND c.system = 'target'),
f AS (SELECT replicate, (sum(weight * (system = 'source' AND score >= recall_threshold)::INT) - sum(weight * (system = 'target' AND score >= recall_threshold)::INT)) / (sum(weight) / 2) AS delta FROM lt JOIN xw USING (cluster_id) WHERE label = 0 GROUP BY 1)
SELECT metric, count(*) AS replicates, round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS ci_low, round(quantile_cont(delta, 0.975), 9) AS ci_high FROM (SELECT 'auroc' AS metric, delta FROM d UNION ALL SELECT 'false_match_rate', delta FROM f) WHERE delta IS NOT NULL GROUP BY 1""")
def transfer(spark, folder):
    """A lock of the source dataset against the target's own, both thresholds from their own
    dev pairs, on the target's test pairs."""
    table = stage(simple_features(spark, folder).withColumn("dataset", dataset_of(F.col("cluster_id"))), "datasets")
    scored = table.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("system"), F.round(m.score(), 9).alias("score")) for d, m in TRANSFER.items()])).alias("_s")).select(
        "pair_id", "cluster_id", "split", "label", "dataset", "_s.system", "_s.score"
    )
    dev = scored.where("split = 'dev' AND dataset = system")
    points = M.operating_points(M.score_ladder(dev, ["system"]), ["system"], 0.9).select("system", "recall_threshold")
    test = scored.where("split = 'test' AND dataset = 'target'").join(F.broadcast(points), "system")  # a row per dataset
    return transferred(test.withColumn("recall_match", F.col("score") >= F.col("recall_threshold")), "transfer")


@query("M7_fitted_transfer")
def fitted_transfer(spark, folder):
    """The same with both locks fitted, tuned and locked on their own dataset."""
    table = stage(simple_features(spark, folder).withColumn("dataset", dataset_of(F.col("cluster_id"))), "datasets")
    held = [L.sweep(table.where((F.col("dataset") == d) & (F.col("split") != "test")), {d: SIMPLE}) for d in DATASET]
    both = L.Lock(*[{d: getattr(h, part)[d] for d, h in zip(DATASET, held)} for part in ("models", "f1", "recall")])
    scored = both.score(table.where("split = 'test' AND dataset = 'target'"), ["pair_id", "cluster_id", "label"])
    return transferred(scored, "transfer")


# --- pose stress -------------------------------------------------------------

GRID = T.noise_grid()
GRID_SQL = ", ".join(f"('{c}', {t}, {r})" for c, t, r in GRID)
POSED = f"WITH {V.OBS}{SUMMARY}, wo AS (SELECT *, {EXTENT_SQL} FROM su)"


@query("W6_donor_frames", f"WITH {V.OBS}{DONOR} SELECT split, cluster_id, frame, donor_cluster_id, donor_frame FROM dn")
def donor_frames(spark, folder):
    return donors(spark, folder)


@query("W6_no_fixed_points", f"WITH {V.OBS}{DONOR} SELECT count(*) AS keys, 0 AS fixed_points FROM dn")
def no_fixed_points(spark, folder):
    return T.fixed_points(donors(spark, folder), ["cluster_id", "frame"])


DONOR_POSE = DONOR + """, j AS (SELECT p.*, d.donor_cluster_id, d.donor_frame, q.px AS qpx, q.py AS qpy, q.pz AS qpz, q.qw AS dqw FROM pose p JOIN dn d USING (split, cluster_id, frame) JOIN pose q ON q.cluster_id = d.donor_cluster_id AND q.frame = d.donor_frame)"""


@query("J16_donor_poses", f"{POSED}{DONOR_POSE} SELECT cluster_id, frame, round(qpx, 7) AS donor_px, round(qpy, 7) AS donor_py, round(qpz, 7) AS donor_pz FROM j")
def donor_poses(spark, folder):
    from .point_jobs import poses

    out = T.with_donor_pose(poses(spark, folder), donors(spark, folder), ["split"], ["cluster_id", "frame"], ["px", "py", "pz"])
    return out.select("cluster_id", "frame", *[F.round(f"donor_p{a}", 7).alias(f"donor_p{a}") for a in "xyz"])


# The donor sees the camera-space centre from its own pose, which is the same thing.
@query("F22_shuffled_centres", f"""{POSED}{DONOR}, s AS (SELECT o.observation_id, d.px + d.r00*o.cx - d.r01*o.cy - d.r02*o.cz AS sx, d.py + d.r10*o.cx - d.r11*o.cy - d.r12*o.cz AS sy, d.pz + d.r20*o.cx - d.r21*o.cy - d.r22*o.cz AS sz
 FROM wo o JOIN dn k USING (split, cluster_id, frame) JOIN (SELECT DISTINCT cluster_id, frame, px, py, pz, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM su) d ON d.cluster_id = k.donor_cluster_id AND d.frame = k.donor_frame)
SELECT observation_id, round(sx, 7) AS sx, round(sy, 7) AS sy, round(sz, 7) AS sz FROM s""")
def shuffled_centres(spark, folder):
    return shuffled(spark, folder).select("observation_id", *[F.round(f"s{a}", 7).alias(f"s{a}") for a in "xyz"])


@query("F23_noise_grid", f"WITH {V.OBS}, g(condition_id, translation_sd, rotation_sd) AS (VALUES {GRID_SQL}) SELECT condition_id, translation_sd::DOUBLE AS translation_sd, rotation_sd::DOUBLE AS rotation_sd, (SELECT count(*) FROM obs) AS rows FROM g")
def noise_grid(spark, folder):
    crossed = T.with_conditions(V.observations(spark, folder).select("observation_id"), GRID)
    return crossed.groupBy("condition_id", "translation_sd", "rotation_sd").agg(F.count(F.lit(1)).alias("rows"))


@query("J11_grid_times_frames", f"WITH {V.OBS}, fr AS (SELECT DISTINCT cluster_id, frame FROM obs), g(condition_id, t, r) AS (VALUES {GRID_SQL}) SELECT condition_id, cluster_id, count(*) AS frames, sum(frame)::BIGINT AS frame_sum FROM fr, g GROUP BY ALL")
def grid_times_frames(spark, folder):
    frames = V.observations(spark, folder).select("cluster_id", "frame").distinct()
    crossed = T.with_conditions(frames, GRID)
    return crossed.groupBy("condition_id", "cluster_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame").alias("frame_sum"))


def uniform_sql(i: int) -> str:
    return f"((('0x' || substr(h, {8 * i + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0)"


def normal_sql(i: int) -> str:
    pair = i // 2 * 2
    return f"sqrt(-2 * ln({uniform_sql(pair)})) * {'cos' if i % 2 == 0 else 'sin'}(2 * pi() * {uniform_sql(pair + 1)})"


NOISE = f""", g(condition_id, tsd, rsd) AS (VALUES {GRID_SQL}), fr AS (SELECT DISTINCT split, cluster_id, frame, px, py, pz, {", ".join(PT.ROTATION)} FROM su),
h AS (SELECT fr.*, g.condition_id, g.tsd::DOUBLE AS tsd, g.rsd::DOUBLE AS rsd, sha256('21|' || split || '|' || cluster_id || '|' || frame || '|' || condition_id) AS h FROM fr, g),
z AS (SELECT *, {", ".join(f"{normal_sql(i)} AS z{i}" for i in range(7))} FROM h),
ax AS (SELECT *, z3 / sqrt(z3*z3 + z4*z4 + z5*z5) AS ux, z4 / sqrt(z3*z3 + z4*z4 + z5*z5) AS uy, z5 / sqrt(z3*z3 + z4*z4 + z5*z5) AS uz, radians(z6 * rsd) AS an FROM z)"""


def frame_errors(spark, folder):
    from .point_jobs import poses

    return T.noisy_frames(PT.with_rotation(poses(spark, folder)), GRID, 21, ["split", "cluster_id", "frame"])


@query("F20_frame_noise", f"{POSED}{NOISE} SELECT cluster_id, frame, condition_id, round(z0 * tsd, 8) AS nx, round(z1 * tsd, 8) AS ny, round(z2 * tsd, 8) AS nz FROM ax")
def frame_noise(spark, folder):
    return frame_errors(spark, folder).select("cluster_id", "frame", "condition_id", *[rounded_to(F.col(f"n{a}"), 8).alias(f"n{a}") for a in "xyz"])


# A rotation about an axis, seen from the world, is the rotation about the turned axis.
WORLD_AXIS = """, wa AS (SELECT *, r00*ux + r01*uy + r02*uz AS wux, r10*ux + r11*uy + r12*uz AS wuy, r20*ux + r21*uy + r22*uz AS wuz FROM ax),
dr AS (SELECT *, cos(an) + wux*wux*(1-cos(an)) AS d0, wux*wuy*(1-cos(an)) - wuz*sin(an) AS d1, wux*wuz*(1-cos(an)) + wuy*sin(an) AS d2, wuy*wux*(1-cos(an)) + wuz*sin(an) AS d3, cos(an) + wuy*wuy*(1-cos(an)) AS d4,
 wuy*wuz*(1-cos(an)) - wux*sin(an) AS d5, wuz*wux*(1-cos(an)) - wuy*sin(an) AS d6, wuz*wuy*(1-cos(an)) + wux*sin(an) AS d7, cos(an) + wuz*wuz*(1-cos(an)) AS d8 FROM wa)"""


@query("F19_axis_angle_rotation", f"{POSED}{NOISE}{WORLD_AXIS} SELECT cluster_id, frame, condition_id, {', '.join(f'round(d{i}, 8) AS d{i}' for i in range(9))} FROM dr")
def axis_angle(spark, folder):
    return frame_errors(spark, folder).select("cluster_id", "frame", "condition_id", *[rounded_to(F.col(f"d{i}"), 8).alias(f"d{i}") for i in range(9)])


MOVED = WORLD_AXIS + """, nv AS (SELECT o.observation_id, o.split, o.cluster_id, e.condition_id, e.tsd, e.rsd, o.px + z0*tsd + d0*(wx-o.px) + d1*(wy-o.py) + d2*(wz-o.pz) AS vx, o.py + z1*tsd + d3*(wx-o.px) + d4*(wy-o.py) + d5*(wz-o.pz) AS vy, o.pz + z2*tsd + d6*(wx-o.px) + d7*(wy-o.py) + d8*(wz-o.pz) AS vz,
 abs(d0)*wex + abs(d1)*wey + abs(d2)*wez AS vex, abs(d3)*wex + abs(d4)*wey + abs(d5)*wez AS vey, abs(d6)*wex + abs(d7)*wey + abs(d8)*wez AS vez FROM wo o JOIN dr e USING (cluster_id, frame))"""


def noisy(spark, folder, extra=()):
    # Dealt while the rows are narrow: a small file may come as one part, which becomes 36 times as many wide rows.
    dealt = V.observations(spark, folder).repartition("cluster_id", "frame")
    return T.noisy_rows(with_extent(summarized(dealt)), GRID, 21, {"": ["split", "cluster_id", "frame"]}, ["observation_id"])


@query("F21_noisy_summaries", f"{POSED}{NOISE}{MOVED} SELECT observation_id, condition_id, {', '.join(f'round({c}, 7) AS {c}' for c in ('vx', 'vy', 'vz', 'vex', 'vey', 'vez'))} FROM nv")
def noisy_summaries(spark, folder):
    return noisy(spark, folder).select("observation_id", "condition_id", *[rounded_to(F.col(c), 7).alias(c) for c in ("vx", "vy", "vz", "vex", "vey", "vez")])


@query("M6_noise_grid_scores", f"""WITH {V.PAIRS}{SUMMARY}, wo AS (SELECT *, {EXTENT_SQL} FROM su){NOISE}{MOVED},
s AS (SELECT p.split, p.label, a.condition_id, round(1 / (1 + exp(-(1.0 - 0.5 * sqrt((a.vx-b.vx)**2 + (a.vy-b.vy)**2 + (a.vz-b.vz)**2) - 0.05 * p.gap))), 9) AS score FROM pairs p JOIN nv a ON a.observation_id = p.observation_id_a JOIN nv b ON b.observation_id = p.observation_id_b AND a.condition_id = b.condition_id WHERE p.split = 'test')
SELECT n.condition_id, count(*) AS comparisons, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 5) AS auroc FROM s p JOIN s n ON p.condition_id = n.condition_id AND p.label = 1 AND n.label = 0 GROUP BY 1""")
def noise_grid_scores(spark, folder):
    """A locked world-distance scorer over every condition, without a refit. A pair holds what
    its endpoints' frames need to draw their errors, so nothing is joined per condition."""
    seen = V.observations(spark, folder).where("split = 'test'")
    pairs = V.pairs(spark, folder, seen).select("cluster_id", "split", "label", "gap", *[f"{n}_{s}" for s in "ab" for n in ("frame", "area", "attribute")])
    posed_fields = ["wx", "wy", "wz", "wex", "wey", "wez", "px", "py", "pz", *PT.ROTATION]
    for side in "ab":
        pairs = endpoint(pairs, side, posed_fields, lambda rows: with_extent(summarized(rows)))
    ends = {f"_{s}": ["split", "cluster_id", f"frame_{s}"] for s in "ab"}
    joined = T.noisy_rows(pairs, GRID, 21, ends, ["label", "gap"])
    columns = X.geometry_features("world", ("vx", "vy", "vz"), ("vx", "vy", "vz"))
    featured = joined.select("condition_id", "label", columns["world_distance"].alias("distance"), F.col("gap").cast("double").alias("gap"))
    model = L.Linear(("distance", "gap"), (0.0, 0.0), (1.0, 1.0), (-0.5, -0.05), 1.0)
    scored = featured.withColumn("score", rounded_to(model.score(), 9))
    out = M.ranking_metrics(M.score_ladder(scored, ["condition_id"]), ["condition_id"])
    return out.select("condition_id", (F.col("positives") * F.col("negatives")).alias("comparisons"), F.round("auroc", 5).alias("auroc"))
