import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.bins import edge_bin, gap_bin, object_bin, tertile
from pairloom.operators import bootstrap as B
from pairloom.operators import metrics as M
from pairloom.operators.ordering import exact_quantiles, keyed_quantiles, ranked, running_totals
from pairloom.operators.review import error_class


def scored(spark, labels, scores):
    return spark.createDataFrame([("s", int(y), float(p)) for y, p in zip(labels, scores)], "system string, label int, score double")


def points(spark, labels, scores, recall):
    return M.operating_points(M.score_ladder(scored(spark, labels, scores), ["system"]), ["system"], recall).first()


def test_f1_threshold_is_a_midpoint(spark):
    # negatives end at 0.25, positives begin at 0.35: nothing between them changes a decision
    row = points(spark, [0, 1, 0, 1, 0], [0.25, 0.35, 0.05, 0.8, 0.2], 0.9)
    assert row["f1_threshold"] == pytest.approx(0.3) and row["best_f1"] == 1.0


def test_recall_threshold(spark):
    # three of the five positives are wanted: those at 0.95, 0.7 and 0.55; the next score below is 0.45
    labels, scores = [1, 0, 1, 1, 0, 1, 0, 1], [0.95, 0.85, 0.7, 0.55, 0.45, 0.35, 0.15, 0.05]
    row = points(spark, labels, scores, 0.6)
    assert row["recall_threshold"] == pytest.approx(0.5)
    cells = M.confusion(scored(spark, labels, scores), ["system"], F.lit(row["recall_threshold"])).first()
    assert cells["tp"] == 3 and cells["fp"] == 1


def test_threshold_without_lower_score_accepts_everything(spark):
    assert points(spark, [1, 1], [0.3, 0.3], 0.9)["recall_threshold"] == float("-inf")


def test_ranking_and_rates(spark):
    # of the six positive-negative pairs four are in order and one is a tie; at 0.4 two of three positives match
    df = scored(spark, [1, 0, 1, 0, 1], [0.9, 0.6, 0.6, 0.2, 0.3])
    assert M.ranking_metrics(M.score_ladder(df, ["system"]), ["system"]).first()["auroc"] == pytest.approx(4.5 / 6)
    cells = M.confusion(df, ["system"], F.lit(0.4))
    row = cells.select(*[c.alias(n) for n, c in M.rates(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]).items()]).first()
    assert (row["f1"], row["false_match_rate"], row["recall"]) == (pytest.approx(2 / 3), 0.5, pytest.approx(2 / 3))


def brute_auroc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    p, n = y == 1, y == 0
    wins = (s[p][:, None] > s[n][None]) + 0.5 * (s[p][:, None] == s[n][None])
    return (w[p][:, None] * w[n][None] * wins).sum() / (w[p].sum() * w[n].sum())


def brute_ap(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    total, out, before = (w * y).sum(), 0.0, 0.0
    for level in np.unique(s)[::-1]:
        kept = s >= level
        hits = (w * y)[kept].sum()
        if w[kept].sum() > 0:
            out += (hits - before) / total * hits / w[kept].sum()
        before = hits
    return out


def test_metrics_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    row = M.ranking_metrics(M.score_ladder(scored(spark, y, s), ["system"]), ["system"]).first()
    assert row["auroc"] == pytest.approx(brute_auroc(y, s), abs=1e-12)
    assert row["average_precision"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_perfect_scores_are_calibrated(spark):
    row = M.calibration(scored(spark, [0, 0, 1, 1], [0.0, 0.0, 1.0, 1.0]), ["system"]).first()
    assert row["brier"] == 0 and row["calibration_error"] == 0 and row["log_loss"] == pytest.approx(0, abs=1e-12)


def test_one_class_has_no_ranking_metric(spark):
    row = M.ranking_metrics(M.score_ladder(scored(spark, [1, 1], [0.1, 0.2]), ["system"]), ["system"]).first()
    assert row["auroc"] is None and row["average_precision"] is None


def test_bins(spark):
    df = spark.createDataFrame([(g,) for g in (2, 5, 6, 11, 12)], "gap int")
    assert [r[0] for r in df.select(gap_bin(F.col("gap"))).collect()] == ["short", "short", "medium", "medium", "long"]
    sizes = spark.createDataFrame([(n,) for n in (3, 6, 10, 2)], "n int").select(object_bin(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["03-04", "05-06", "09-10", "other-02"]
    edges = F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))
    assert spark.range(1).select(edge_bin(F.lit(1.0), edges), edge_bin(F.lit(0.5), edges), edge_bin(F.lit(9.0), edges)).first()[:] == (1, 0, 2)


def test_train_tertiles(spark):
    rows = [("train", v / 10) for v in range(10, 101, 10)] + [("test", -50.0)]
    low, high = M.train_cutpoints(spark.createDataFrame(rows, "split string, value double"), ["value"])["value"]
    assert 1 < low < high < 10
    values = spark.createDataFrame([(v,) for v in (high + 1e-6, low + 1e-6, low, high)], "v double")
    assert [r[0] for r in values.select(tertile(F.col("v"), F.lit(low), F.lit(high))).collect()] == ["high", "medium", "low", "medium"]


def test_comparisons_reuse_positives(spark):
    rows = [(0, "easy")] * 5 + [(1, None)] * 3 + [(0, "hard")]
    df = spark.createDataFrame(rows, "label int, difficulty string").select("label", F.explode(M.comparison_levels(F.col("label"), F.col("difficulty"))).alias("c"))
    got = {r["c"]: (r["n"], r["p"]) for r in df.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    assert got == {"positive_vs_hard": (4, 3), "positive_vs_easy": (8, 3)}


def test_error_class(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.49), (1, 0.5), (0, 0.49)], "y int, s double").select(error_class(F.col("y"), F.col("s"), F.lit(0.5)))
    assert [r[0] for r in df.collect()] == ["false_positive", "false_negative", None, None]


def test_running_totals_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(1)
    # One key holds a third of all rows.
    keys = np.where(rng.random(3000) < 0.34, 0, rng.integers(1, 50, 3000))
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 9, 3000)))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    expected, running = {}, {}
    for k, i, v in sorted(rows):
        expected[i] = running.get(k, 0)
        running[k] = expected[i] + v
    for slices in (1, 7, 40):
        got = running_totals(df, ["k"], ["i"], ["v"], slices=slices).collect()
        assert {r["i"]: r["v_before"] for r in got} == expected
        assert all(r["v_total"] == running[r["k"]] for r in got)
    assert [r["rank"] for r in ranked(df, [], ["i"]).orderBy("i").collect()] == list(range(3000))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=701), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    wanted = {"a": 0.05, "b": 1 / 3, "c": 0.5, "d": 0.95}
    got = exact_quantiles(df, [], "v", wanted).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    small = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (7.0,)], "v double")
    assert exact_quantiles(small, [], "v", {"q": 0.25}, "higher").first()["q"] == 2.0


def test_quantiles_of_hot_keys_by_radix_equal_one_aggregate(spark):
    """A third of all rows in one key, a null key, nulls, NaN, signs, infinities, ties, and a hot key without values."""
    draw = np.random.default_rng(11)
    odd = [0.0, -0.0, 1e-310, -1e-310, float("inf"), float("-inf"), float("nan"), None, 1.5, 1.5, -7.25, 1e300]
    rows = [("hot", float(v), 3.0) for v in draw.normal(0, 1e3, 400)] + [("hot", 0.125, None)] * 300
    rows += [("small", float(v), float(-v)) for v in draw.normal(size=7)]
    rows += [(None, v, 1.0) for v in odd * 20] + [("empty", None, None)] * 200 + [("odd", v, v) for v in odd]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)
    levels = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]

    def values(limit):
        found = keyed_quantiles(df, ["k"], ["a", "b"], levels, limit).collect()
        assert len(found) == 5
        return {r["k"]: tuple(None if r[c] is None else [None if np.isnan(v) else v for v in r[c]] for c in ("a", "b")) for r in found}

    expected = values(10**6)
    plain = np.array([a for k, a, _ in rows if k == "hot"])
    assert np.allclose(expected["hot"][0], np.quantile(plain, levels), rtol=1e-12)
    assert expected["empty"] == (None, None)
    for limit in (50, 0):
        assert values(limit) == expected


def clustered(spark, n=600, clusters=9, seed=5):
    rng = np.random.default_rng(seed)
    c, y = rng.integers(0, clusters, n), rng.integers(0, 2, n)
    a = np.round(0.3 * y + rng.random(n), 2)
    b = np.round(0.5 * y + rng.random(n), 2)
    rows = [(s, f"p{i}", int(c[i]), int(y[i]), float(v[i])) for i in range(n) for s, v in (("A", a), ("B", b))]
    return spark.createDataFrame(rows, "system string, pair_id string, cluster_id bigint, label int, score double"), c, y, {"A": a, "B": b}


def weights_of(draws, replicates):
    table = {}
    for r in draws.collect():
        table[(r["replicate"], r["cluster_id"])] = r["weight"]
    return table


def test_bootstrap_matches_brute_force(spark):
    df, c, y, scores = clustered(spark)
    draws = B.cluster_draws(df, 12, 1)
    table = weights_of(draws, 12)
    assert all(sum(w for (r, _), w in table.items() if r == i) == 9 for i in range(12))
    got = {(r["replicate"], r["system"]): r for r in B.replicate_ranking(df, draws, ["system"]).collect()}
    delta = {r["replicate"]: r["delta"] for r in B.replicate_auc_difference(df, draws, "A", "B").collect()}
    for i in range(12):
        w = np.array([table.get((i, k), 0) for k in c], dtype=float)
        for s, v in scores.items():
            assert got[i, s]["auroc"] == pytest.approx(brute_auroc(y, v, w), abs=1e-10)
            assert got[i, s]["average_precision"] == pytest.approx(brute_ap(y, v, w), abs=1e-10)
        expected = brute_auroc(y, scores["B"], w) - brute_auroc(y, scores["A"], w)
        assert delta[i] == pytest.approx(expected, abs=1e-10)


def test_weighted_sums_equal_the_join_of_draws(spark, monkeypatch):
    """Ten thousand replicates shuffle a row per cluster and batch; sparse and null keys have rows only where drawn."""
    draw = np.random.default_rng(2)
    rows = [(k, c, int(draw.integers(0, 9)), int(draw.integers(-4, 5))) for k, share in (("a", 1.0), ("b", 0.1), (None, 0.3)) for c in range(40) if draw.random() < share]
    counts = spark.createDataFrame(rows, "kind string, cluster_id bigint, n bigint, gain bigint")
    draws = B.materialize(B.cluster_draws(counts, 10_000, 3))
    joined = counts.join(draws, "cluster_id")
    for keys in (["kind"], []):
        expected = sorted(map(str, joined.groupBy("replicate", *keys).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n", "gain")]).collect()))
        for clusters in (1_024, 7):
            monkeypatch.setattr(B, "BLOCK_CLUSTERS", clusters)
            assert sorted(map(str, B.weighted_sums(counts, draws, keys, ["n", "gain"]).collect())) == expected


def test_matrix_matches_all_pairs_whatever_the_tiles(spark, monkeypatch):
    df, *_ = clustered(spark, 300, 9)
    df = df.withColumn("score", F.round("score", 1))  # ties inside and across clusters
    rows = df.select("system", "cluster_id", "label", "score").collect()
    pairs = {}
    for p in (r for r in rows if r["label"] == 1):
        for n in (r for r in rows if r["label"] == 0 and r["system"] == p["system"]):
            key = (p["system"], p["cluster_id"], n["cluster_id"])
            pairs[key] = pairs.get(key, 0.0) + (p["score"] > n["score"]) + 0.5 * (p["score"] == n["score"])
    expected = sorted((*k, v) for k, v in pairs.items() if v)
    assert sorted(map(tuple, B.cluster_auc_matrix(df).collect())) == expected
    for name, value in {"MATRIX_SLICE": 10, "TILE_CLUSTERS": 2, "TILE_GROUP": 3, "TILE_LEVELS": 2}.items():
        monkeypatch.setattr(B, name, value)
    assert sorted(map(tuple, B.cluster_auc_matrix(df).collect())) == expected


def test_tile_does_not_depend_on_levels_at_a_time(monkeypatch):
    draw = np.random.default_rng(3)
    at, neg_at, pos, neg = (draw.integers(1, 9, n).astype(float) for n in (40, 60, 40, 60))
    i, j = draw.integers(0, 5, 40), draw.integers(0, 7, 60)
    expected = np.zeros((5, 7))
    for a, p, c in zip(at, pos, i):
        for b, n, d in zip(neg_at, neg, j):
            expected[c, d] += p * n * ((a > b) + 0.5 * (a == b))
    for levels in (1, 2, 512):
        monkeypatch.setattr(B, "TILE_LEVELS", levels)
        assert np.array_equal(B._tile_wins(at, i, pos, neg_at, j, neg, (5, 7), 0.5), expected)


def test_identical_systems_have_zero_intervals(spark):
    df, *_ = clustered(spark, 200, 4)
    twin = df.where("system = 'A'").unionByName(df.where("system = 'A'").withColumn("system", F.lit("B")))
    row = B.interval(B.replicate_auc_difference(twin, B.cluster_draws(twin, 20, 2), "A", "B"), [], "delta").first()
    assert row["ci_low"] == row["ci_high"] == row["mean"] == 0


def test_matrix_of_many_clusters(spark):
    n = 2_100
    df = spark.range(n).selectExpr("'A' AS system", "id AS cluster_id", "CAST(id % 2 AS INT) AS label", "CAST(id AS DOUBLE) AS score").where("cluster_id > 2090 OR label = 0")
    got = B.cluster_auc_matrix(df).groupBy("pos_cluster").agg(F.sum("wins").alias("w")).collect()
    assert {r["pos_cluster"]: r["w"] for r in got} == {float(p): (p + 1) / 2 for p in range(2091, n, 2)}


def test_matrix_of_fifty_thousand_clusters_works_in_tiles(spark, monkeypatch):
    """A few rows per cluster, and no tile wider than its blocks."""
    n, winners = 50_000, 30
    df = spark.range(2 * n).selectExpr(
        "'A' AS system", f"id % {n} AS cluster_id", f"CAST(id < {n} AND id % {n} < {winners} AS INT) AS label", f"CAST(id % {n} % 1000 AS DOUBLE) AS score"
    )
    widest = B.TILE_CLUSTERS * 1.25

    def narrow(*args, plain=B._tile_wins):
        assert max(args[6]) <= widest
        return plain(*args)

    monkeypatch.setattr(B, "_tile_wins", narrow)
    got = B.cluster_auc_matrix(df).groupBy("pos_cluster").agg(F.sum("wins").alias("w")).collect()
    score, label = np.arange(2 * n) % n % 1000, (np.arange(2 * n) < winners).astype(int)
    negative = score[label == 0]
    assert {r["pos_cluster"]: r["w"] for r in got} == {c: (negative < c).sum() + (negative == c).sum() / 2 for c in range(winners)}


def test_tile_of_one_slice_is_final_and_positive_wins_are_the_margin(spark, monkeypatch):
    df, *_ = clustered(spark, 300, 9)
    df = df.withColumn("score", F.round("score", 1))
    plan = lambda m: m._jdf.queryExecution().optimizedPlan().toString()
    matrix = B.cluster_auc_matrix(df)
    assert "sum(wins" not in plan(matrix)
    margin = {r[:2]: r[2] for r in matrix.groupBy("system", "pos_cluster").agg(F.sum("wins")).collect()}
    assert {r[:2]: r[2] for r in B.positive_wins(df).where("wins > 0").collect()} == margin
    monkeypatch.setattr(B, "MATRIX_SLICE", 10)
    assert "sum(wins" in plan(B.cluster_auc_matrix(df))


def test_ranking_by_pieces_and_heavy_weights(spark, monkeypatch):
    """Scores that go on over batches and pieces, weights of more than a byte, a null key and one without draws."""
    draw = np.random.default_rng(4)
    rows = [(k, int(draw.integers(0, 6)), int(draw.integers(0, 2)), float(draw.integers(0, 30)) / 10) for k in ("a", "b", None) for _ in range(400)]
    rows += [("alone", 9, 1, 0.5), ("alone", 9, 0, 0.1)]
    df = spark.createDataFrame(rows, "kind string, cluster_id bigint, label int, score double")
    table = {(r, c): int(draw.choice([0, 1, 2, 300, 700])) for r in (0, 1, 499, 500, 777) for c in range(6)}
    draws = spark.createDataFrame([(r, c, w) for (r, c), w in table.items() if w], "replicate int, cluster_id bigint, weight bigint")
    packed = B.packed_weights(draws)
    assert sum(sum(r["_weights"]) for r in packed.collect()) == sum(table.values())
    assert B.packed_weights(packed) is packed
    monkeypatch.setattr(B, "PIECE_LEVELS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["replicate"], r["kind"]): r for r in B.replicate_ranking(df, packed, ["kind"]).collect()}
        plain = {(r["replicate"], r["kind"]): r["auroc"] for r in B.replicate_ranking(df, draws, ["kind"], precision=False).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain == {k: r["auroc"] for k, r in got.items()}
    assert {k for _, k in got} == {"a", "b", None}
    for (replicate, kind), row in got.items():
        mine = [r for r in rows if r[0] == kind]
        y, v = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        w = np.array([table[replicate, r[1]] for r in mine], float)
        assert (row["positives"], row["negatives"]) == (w[y == 1].sum(), w[y == 0].sum())
        assert row["auroc"] == pytest.approx(brute_auroc(y, v, w), abs=1e-10)
        assert row["average_precision"] == pytest.approx(brute_ap(y, v, w), abs=1e-10)


def test_matrix_sends_each_step_once_per_block_of_the_other_side(spark, monkeypatch):
    """Not once per tile: what is shuffled grows with the blocks, whatever the tiles in them."""
    n = 600
    df = spark.range(8 * n).selectExpr("'A' AS system", f"id % {n} AS cluster_id", "CAST(id % 7 < 3 AS INT) AS label", "CAST(pmod(id * 7919, 997) AS DOUBLE) / 10 AS score")
    expected = sorted(map(tuple, B.cluster_auc_matrix(df).collect()))
    monkeypatch.setattr(B, "TILE_CLUSTERS", 16)
    monkeypatch.setattr(B, "MATRIX_GRID", 2)
    sent = []
    packed = B._packed_steps
    monkeypatch.setattr(B, "_packed_steps", lambda steps, side, blocks: sent.append(blocks) or packed(steps, side, blocks))
    assert sorted(map(tuple, B.cluster_auc_matrix(df).collect())) == expected
    assert sent == [2, 2] and len(expected) > 100_000


def test_tile_with_crowded_and_equal_scores(monkeypatch):
    draw = np.random.default_rng(5)
    monkeypatch.setattr(B, "TILE_STEPS", 9)
    for kinds in (1, 4, 300):
        at, neg_at = (np.r_[draw.integers(0, kinds, n) / 7, np.full(40, 0.5)] for n in (150, 220))
        pos, neg = draw.integers(1, 5000, len(at)), draw.integers(1, 5000, len(neg_at))
        i, j = draw.integers(0, 6, len(at)), draw.integers(0, 4, len(neg_at))
        for own in (0.0, 0.5):
            expected = np.zeros((6, 4))
            np.add.at(expected, (i[:, None], j), pos[:, None] * neg * ((at[:, None] > neg_at) + own * (at[:, None] == neg_at)))
            for levels in (2, 512):
                monkeypatch.setattr(B, "TILE_LEVELS", levels)
                assert np.array_equal(B._tile_wins(at, i, pos, neg_at, j, neg, (6, 4), own), expected)
