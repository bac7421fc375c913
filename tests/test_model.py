import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import features as X
from pairloom.operators import model as L
from pairloom.operators import newton


def table(spark, n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x, y = rng.gauss(2, 3), rng.gauss(0, 1)
        label = int(rng.random() < 1 / (1 + math.exp(-(0.6 * x - y - 1))))
        rows.append((f"p{i}", ("train", "train", "train", "dev", "test")[i % 5], label, x, y, 7.0))
    return spark.createDataFrame(rows, "pair_id string, split string, label int, x double, y double, flat double")


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_gradient_is_zero_at_the_fit(spark, c):
    df = table(spark)
    model = L.fit(df, ["x", "y", "flat"], c)
    assert max(map(abs, L.gradient(df, model))) < 1e-6
    assert model.deviations[2] == 1.0 and abs(model.coefficients[2]) < 1e-9


def test_fit_and_lock_ignore_test_rows(spark):
    df = table(spark)
    flipped = df.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (L.lock({"m": L.fit(d, ["x", "y"], 1.0)}, d) for d in (df, flipped))
    assert a == b


def test_lock_survives_its_table(spark, tmp_path):
    df = table(spark)
    held = L.sweep(df, {"one": ["x"], "two": ["x", "y"]}, grid=(0.1, 1.0))
    held.table(spark).write.parquet(str(tmp_path / "lock"))
    again = L.Lock.read(spark.read.parquet(str(tmp_path / "lock")))
    assert again == held
    diff = L.largest_difference(held.score(df, ["pair_id"]), again.score(df, ["pair_id"])).collect()
    assert all(r["largest_difference"] == 0 and r["unmatched"] == 0 and r["compared"] == 900 for r in diff)


def test_equal_dev_auroc_takes_the_smaller_grid_point(spark):
    model, aurocs = L.choose_regularization(table(spark), ["x"], grid=(10.0, 0.1, 1.0))
    assert aurocs.count() == 3 and model.regularization == 0.1


def test_train_values_must_be_finite(spark):
    bad = table(spark, 50).withColumn("x", F.when(F.col("pair_id") == "p0", float("nan")).otherwise(F.col("x")))
    with pytest.raises(ValueError):
        L.fit(bad, ["x"], 1.0)


def test_scoring_runs_on_a_stream(spark, tmp_path):
    df = table(spark, 40)
    df.write.parquet(str(tmp_path / "in"))
    model = L.Linear(("x",), (2.0,), (3.0,), (1.0,), 0.0)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.scored_by(stream, {"m": model}, ["pair_id"]).writeStream.format("memory").queryName("scored_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("scored_stream").collect()) == sorted(L.scored_by(df, {"m": model}, ["pair_id"]).collect())


def observation(spark, shift):
    names = ["mx", "my", "area", "crop_w", "crop_h", "aspect", "visibility", *X.DEPTH_LEVELS, "cx", "cy", "cz", "ex", "ey", "ez"]
    values = [0.5 + shift, 0.4, 100 + 10 * shift, 12, 10, 1.2, 90, 1.0 + shift, 1.1, 1.2, 1.3, 1.4, 0.1, 0.2 + shift, 1.5, 0.3, 0.2, 0.1 + shift]
    return {n: F.lit(float(v)) for n, v in zip(names, values)}


def test_thirty_one_finite_features(spark):
    a, b = observation(spark, 0.0), observation(spark, 0.1)
    unit = X.unit_embedding(F.array(*[F.lit(float(v)) for v in (3, 4, 0)]))
    row = spark.range(1).select(F.lit(4).alias("gap"), unit.alias("unit_a"), unit.alias("unit_b"), *[c.alias(f"{n}_a") for n, c in a.items()], *[c.alias(f"{n}_b") for n, c in b.items()])
    columns = {**X.shared_features(), **X.geometry_features("camera", ("cx", "cy", "cz"), ("ex", "ey", "ez"))}
    got = row.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()
    assert tuple(got) == X.SYSTEMS["C_camera"] and len(got) == 31 and all(math.isfinite(v) for v in got.values())
    assert got["cosine"] == pytest.approx(1.0) and got["camera_distance"] == pytest.approx(0.1) and got["depth_rate"] == 0.0


def test_zero_embedding_fails(spark):
    with pytest.raises(Exception):
        spark.range(1).select(X.unit_embedding(F.array(F.lit(0.0), F.lit(0.0)))).collect()


def test_catalog_audit(spark):
    assert all(r["passed"] for r in X.catalog_audit(X.system_catalog(spark), ("C_camera", "D_world"), "P_pose_only").collect())
    broken = {**X.SYSTEMS, "B_plane": X.SYSTEMS["B_plane"] + ("camera_rotation",), "C_camera": X.SYSTEMS["C_camera"][:-1]}
    got = {r["check_name"]: r["passed"] for r in X.catalog_audit(X.system_catalog(spark, broken), ("C_camera", "D_world"), "P_pose_only").collect()}
    assert got == {"twin_widths": False, "twin_correspondence": False, "pose_disjoint": False, "features_unique": True}


def test_every_query_is_named_after_an_operator():
    from pairloom.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def plain_fit(x, y, c):
    """Newton steps on the whole table in memory."""
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.diag([1 / c] * (x.shape[1] - 1) + [0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x + pull + 1e-12 * np.eye(len(w)), x.T @ (p - y) + pull @ w)
    return w


def test_many_fits_share_their_passes(spark):
    df = table(spark).withColumn("near", F.col("x") + 0.01 * F.col("y"))
    systems = {"one": ["x"], "two": ["y", "x"], "all": ["x", "y", "near", "flat"]}
    models, passes = L.fit_grid(df, systems)
    assert passes <= 15 and len(models) == 15
    rows = df.where("split = 'train'").toPandas()
    for (system, c), model in models.items():
        expected = plain_fit(rows[systems[system]].to_numpy(), rows["label"].to_numpy(), c)
        assert np.allclose([*model.coefficients, model.intercept], expected, atol=1e-6), (system, c)
        assert max(map(abs, L.gradient(df, model))) < 1e-6
    again = L.gradients(df, {f"{i}": m for i, m in enumerate(models.values())})
    assert max(again.values()) < 1e-6


def test_fit_needs_both_classes(spark):
    with pytest.raises(ValueError):
        L.fit(table(spark).withColumn("label", F.lit(1)), ["x"], 1.0)


def test_test_split_is_sealed_until_a_lock_exists(spark, tmp_path):
    store = L.SealedSplits.store(table(spark), str(tmp_path / "store"))
    fitting = store.fitting(spark)
    assert {r[0] for r in fitting.select("split").distinct().collect()} == {"train", "dev"}
    whole = spark.read.parquet(store.path)
    for attempt in (lambda: L.fit(whole, ["x"], 1.0), lambda: L.lock({}, whole), lambda: L.sweep(whole.where("split != 'test'"), {"m": ["x"]})):
        with pytest.raises(PermissionError):
            attempt()
    with pytest.raises(PermissionError):
        store.scored_test(spark, L.fit(fitting, ["x"], 1.0), ["pair_id"])
    held = L.sweep(fitting, {"m": ["x"]}, grid=(1.0,))
    assert store.scored_test(spark, held, ["pair_id"]).count() == 180


def test_start_from_a_sample_gives_the_same_fit_in_fewer_passes(spark, monkeypatch):
    df = table(spark, 4_000).withColumn("near", F.col("x") + 0.01 * F.col("y"))
    systems = {"one": ["x"], "all": ["x", "y", "near", "flat"]}
    whole, many = L.fit_grid(df, systems)
    monkeypatch.setattr(newton, "START_ROWS", 300)
    seen, passed = [], newton._passed
    monkeypatch.setattr(newton, "_passed", lambda rows, *args: seen.append(sum(m[2] for m in args[3].values())) or passed(rows, *args))
    models, passes = L.fit_grid(df, systems)
    assert passes <= many and seen[-passes] == 0  # the pass over all rows starts from the sample's Hessians
    for key, model in models.items():
        assert np.allclose([*model.coefficients, model.intercept], [*whole[key].coefficients, whole[key].intercept], atol=1e-6), key


def test_many_models_score_as_one(spark):
    df = table(spark, 300).withColumn("y", F.when(F.col("pair_id") != "p3", F.col("y")))
    models = {f"m{i}": L.Linear(("x", "y", "flat"), (2.0, 0.1, 6.0), (3.0, 0.9, 1.0), (0.3 * i, -0.2, 0.1), 0.4) for i in range(30)}
    got = L.scored_by(df, models, ["pair_id", "label"])
    one = {s: {r.pair_id: r.score for r in L.scored_by(df, {s: m}, ["pair_id"]).collect()} for s, m in models.items()}
    rows = got.collect()
    assert got.columns == ["pair_id", "label", "system", "score"] and len(rows) == 9_000
    for r in rows:
        assert (r.score is None and r.pair_id == "p3") if one[r.system][r.pair_id] is None else r.score == pytest.approx(one[r.system][r.pair_id], abs=1e-15)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_packed_store_gives_the_same_lock_and_holds_each_row_once(spark, tmp_path):
    df = table(spark).withColumn("y", F.when(F.col("split") != "test", F.col("y")).otherwise(F.when(F.col("x") > 0, F.col("y"))))
    systems, grid = {"one": ["x"], "two": ["y", "x"]}, (0.1, 1.0)
    plain = L.SealedSplits.store(df, str(tmp_path / "plain"))
    held = L.sweep(plain.fitting(spark), systems, grid)
    expected = plain.scored_test(spark, held, ["label"])
    store = L.PackedSplits.store(df, str(tmp_path / "packed"), ["x", "y"])
    stored = spark.read.parquet(store.path)
    assert stored.groupBy("split").agg((F.sum(F.length("y")) / 8).cast("int").alias("n")).count() == df.select("split").distinct().count()
    assert stored.agg(F.sum(F.length("y")) / 8).first()[0] == df.count()
    with pytest.raises(PermissionError):
        store.scored_test(spark, held.models["one"])
    ours = store.sweep(spark, systems, grid)
    assert not (tmp_path / "packed" / "split=train").exists()  # read to the end, then deleted
    for s, m in held.models.items():
        assert ours.models[s].regularization == m.regularization
        assert ours.models[s].coefficients == pytest.approx(m.coefficients, abs=1e-6)
        assert (ours.f1[s], ours.recall[s]) == pytest.approx((held.f1[s], held.recall[s]), abs=1e-6)
    key = lambda r: (r["system"], r["score"] is None, r["score"] or 0.0, r["label"])
    a, b = (sorted(d.collect(), key=key) for d in (expected, store.scored_test(spark, ours)))
    assert [(r["system"], r["label"], r["recall_match"]) for r in a] == [(r["system"], r["label"], r["recall_match"]) for r in b]
    assert any(r["score"] is None for r in b) and [r["score"] is None for r in a] == [r["score"] is None for r in b]
