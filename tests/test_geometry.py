import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import geometry as G
from pairloom.functions.numbers import rounded_to
from pairloom.operators import points as P
from pairloom.operators import stress as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


def test_depth_decode(spark):
    row = one(spark, *[G.decode_depth(F.lit(v), F.lit(-2.0), F.lit(3.0)) for v in (0, 13107, 65535)])
    assert row[:] == pytest.approx((-2.0, -1.0, 3.0))


def test_back_projection_is_radial(spark):
    row = one(spark, *[G.norm(G.back_project(F.lit(r), F.lit(c), F.lit(d), 3.0, 5.0, 6, 4)) for r, c, d in ((0, 0, 2.5), (3, 5, 0.75))])
    assert row[:] == pytest.approx((2.5, 0.75))


def test_round_trip_and_projection(spark):
    point, position = lits(0.3, -0.2, 4.0), lits(1.0, 2.0, 3.0)
    r = G.rotation(*lits(0.7, 0.1, -0.4, 0.2))
    back = G.world_to_camera(G.camera_to_world(point, position, r), position, r)
    row = one(spark, *back, G.orthonormality_error(r), *G.project(G.back_project(F.lit(5), F.lit(2), F.lit(3.0), 20.0, 30.0, 8, 8), 20.0, 30.0, 8, 8))
    assert row[:3] == pytest.approx((0.3, -0.2, 4.0), abs=1e-12) and row[3] < 1e-12
    assert row[4:] == pytest.approx((5.0, 2.0))


def test_zero_quaternion_and_point_behind_camera_fail(spark):
    with pytest.raises(Exception):
        one(spark, *G.rotation(*lits(0, 0, 0, 0)))
    with pytest.raises(Exception):
        one(spark, *G.project(lits(0, 0, -1), 1.0, 1.0, 2, 2))


def test_relative_angle(spark):
    turned = G.rotation(F.lit(math.cos(math.radians(15))), F.lit(math.sin(math.radians(15))), F.lit(0.0), F.lit(0.0))
    assert one(spark, G.angle_degrees(G.rotation(*lits(1, 0, 0, 0)), turned))[0] == pytest.approx(30.0)


def test_padded_box(spark):
    # six columns by three rows with one pixel missing, half a side of padding, clipped at the left and lower edges
    pixels = spark.createDataFrame([(1, r, c) for r in range(5, 8) for c in range(1, 7) if (r, c) != (6, 3)], "o int, row int, col int")
    row = P.mask_summary(pixels, ["o"], 0.5, 20, 9).first()
    assert [row[k] for k in ("x0", "y0", "x1", "y1")] == [1, 5, 7, 8]
    assert (row["px0"], row["px1"], row["py1"]) == (0, 10, 9) and 3 <= row["py0"] <= 4
    assert row["fill"] == pytest.approx(17 / 18) and row["aspect"] == 2.0


def test_donors_are_a_derangement_whatever_the_order(spark):
    keys = [("d", f"v{i}", t) for i in range(4) for t in range(3)]
    df = spark.createDataFrame(keys, "split string, cluster_id string, frame int")
    a = T.donor_assignment(df, ["split"], ["cluster_id", "frame"], 1)
    b = T.donor_assignment(spark.createDataFrame(keys[::-1], df.schema).repartition(5), ["split"], ["cluster_id", "frame"], 1)
    assert sorted(a.collect()) == sorted(b.collect())
    assert T.fixed_points(a, ["cluster_id", "frame"]).first()[:] == (12, 0)
    assert a.select("donor_cluster_id", "donor_frame").distinct().count() == 12


def frames_and_observations(spark):
    pose = "1.0D px, 2.0D py, 3.0D pz, 0.5D qw, 0.5D qx, -0.5D qy, 0.5D qz"
    frames = P.with_rotation(spark.sql(f"SELECT 7 AS cluster_id, 1 AS frame, {pose}"))
    seen = spark.sql("SELECT * FROM VALUES (1, 2.0D, 0.0D, 1.0D), (2, 3.0D, 1.0D, 0.0D) t(observation_id, wx, wy, wz)")
    seen = seen.selectExpr("*", "7 AS cluster_id", "1 AS frame", "0.5D wex", "0.4D wey", "0.3D wez")
    return frames, P.with_rotation(seen.selectExpr("*", *pose.split(", ")))


def test_noise_is_shared_inside_a_frame_and_exact_at_zero(spark):
    frames, seen = frames_and_observations(spark)
    grid = T.noise_grid((0.0, 0.5), (0.0, 5.0))
    out = T.noisy_summaries(seen, T.noisy_frames(frames, grid, 3, ["cluster_id", "frame"]), ["cluster_id", "frame"]).collect()
    by = {(r["condition_id"], r["observation_id"]): r for r in out}
    clean = {r["observation_id"]: r for r in seen.collect()}
    for o in (1, 2):
        assert [by["t0_r0", o][f"v{a}"] for a in "xyz"] == [clean[o][f"w{a}"] for a in "xyz"]
    for c, _, _ in grid:
        a, b = by[c, 1], by[c, 2]
        assert math.dist([a[f"v{x}"] for x in "xyz"], [b[f"v{x}"] for x in "xyz"]) == pytest.approx(math.sqrt(3), abs=1e-9)
    assert len({round(by[c, 1]["vx"], 9) for c, _, _ in grid}) == 4


def test_tokens_and_grid():
    assert T.level_token(0.01) == "0p01" and T.level_token(5.0) == "5"
    grid = T.noise_grid()
    assert len(grid) == 36 and len({c for c, _, _ in grid}) == 36


def test_camera_motion_of_a_straight_path(spark):
    poses = spark.createDataFrame([(1, t, float(t), 0.0, 1.0, 1.0, 0.0, 0.0, 0.0) for t in range(4)], "cluster_id int, frame int, px double, py double, pz double, qw double, qx double, qy double, qz double")
    row = P.camera_motion(poses).first()
    assert row["displacement"] == 3.0 and row["path_length"] == 3.0 and row["step_max"] == 1.0 and row["rotation"] == pytest.approx(0)


def test_noise_of_rows_equals_the_join_with_frames_and_shuffles_nothing(spark):
    frames, seen = frames_and_observations(spark)
    grid, keys = T.noise_grid((0.0, 0.5), (0.0, 5.0)), ["cluster_id", "frame"]
    names = ["vx", "vy", "vz", "vex", "vey", "vez"]
    joined = T.noisy_summaries(seen, T.noisy_frames(frames, grid, 3, keys), keys).select("observation_id", "condition_id", *names)
    rows = T.noisy_rows(seen, grid, 3, {"": keys}, ["observation_id"]).select(*joined.columns)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    expected = {r[:2]: r[2:] for r in joined.collect()}
    got = {r[:2]: r[2:] for r in rows.collect()}
    assert got.keys() == expected.keys() and len(got) == 8
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, abs=1e-12)
    hollow = T.noisy_rows(seen.withColumn("wx", F.lit(None).cast("double")), grid, 3, {"": keys}, ["observation_id"])
    assert hollow.where("vx IS NULL AND vy IS NULL AND vex IS NOT NULL").count() == 8


def test_rounding_goes_away_from_zero_and_keeps_what_has_no_digits(spark):
    values = [0.125, -0.125, 2.5e-7, -2.5, 1e300, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(rounded_to(F.col("v"), 2)).collect()] == [0.13, -0.13, 0.0, -2.5, 1e300, float("inf"), None]
    assert math.isnan(df.limit(1).select(rounded_to(F.lit(float("nan")), 2)).first()[0])
