import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions.ids import digest, unordered_pair_id
from pairloom.operators import matching as M
from pairloom.operators import pair_sampling as S
from pairloom.operators import pairs as P


def hot_observations(spark, n=900):
    """One cluster holds a third of all rows."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        cluster = 0 if i % 3 == 0 else rng.randint(1, 40)
        rows.append((i, cluster, "train", rng.randint(0, 60), rng.choice("abcde"), rng.choice("xy"), rng.random() + 0.01))
    return rows, spark.createDataFrame(rows, "observation_id bigint, cluster_id bigint, split string, frame bigint, instance string, category string, area double")


@pytest.mark.parametrize("hot_rows", [None, 5, 1000])
def test_band_join_is_exact_with_and_without_salt(spark, hot_rows):
    rows, df = hot_observations(spark)
    got = P.band_pairs(df, 2, 9, ["instance"], hot_rows=hot_rows)
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and 2 <= b[3] - a[3] <= 9)
    assert sorted((r["observation_id_a"], r["observation_id_b"]) for r in got.collect()) == expected


def test_counts_without_listing(spark):
    rows, df = hot_observations(spark)
    counted = P.band_pair_counts(df, 2, 9, ["instance"]).agg(F.sum("pairs")).first()[0]
    assert counted == sum(1 for a in rows for b in rows if a[1] == b[1] and 2 <= b[3] - a[3] <= 9)
    closed = P.cross_frame_capacity(df, "instance", "category").agg(F.sum("all_pairs")).first()[0]
    assert closed == sum(1 for a in rows for b in rows if a[1] == b[1] and a[3] < b[3])


def test_cutoff_ratios_are_the_same_category_pairs(spark):
    rows, df = hot_observations(spark, 300)
    got = P.same_category_ratios(df, 1, 9, "instance", "category", "area").count()
    assert got == sum(1 for a in rows for b in rows if a[1] == b[1] and 1 <= b[3] - a[3] <= 9 and a[5] == b[5] and a[4] != b[4])


def test_even_quotas():
    for total in range(50):
        shares = list(S.even_quotas(total).values())
        assert sum(shares) == total and max(shares) - min(shares) <= 1 and shares == sorted(shares, reverse=True)


def test_a_template_without_a_negative_is_an_error(spark):
    templates, negatives = matching_tables(spark)
    with pytest.raises(ValueError, match="have no negative left"):
        M.match_negatives(templates, negatives.limit(3), ["c1", "c2"], cap=12)
    assert M.match_negatives(templates, negatives.limit(3), ["c1", "c2"], cap=12, strict=False).count() <= 3


def test_pair_id_ignores_order(spark):
    a, b = F.lit(5).cast("bigint"), F.lit(12).cast("bigint")
    row = spark.range(1).select(unordered_pair_id(a, b, "x"), unordered_pair_id(b, a, "x")).first()
    assert row[0] == row[1] and len(row[0]) == 24


def candidates(spark, n=700):
    rng = random.Random(9)
    rows = [(f"p{i}", "train", 0 if i % 3 == 0 else rng.randint(1, 12), rng.choice(("positive", "hard", "easy")), rng.choice(("short", "medium", "long"))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pair_id string, split string, cluster_id bigint, kind string, gap_bin string")


def hashes(spark, rows, seed):
    df = spark.createDataFrame(rows, "pair_id string, split string, cluster_id bigint, kind string, gap_bin string")
    place = [F.col(c) for c in ("split", "kind", "gap_bin", "cluster_id")]
    return {r["pair_id"]: (r["item"], r["draw"]) for r in df.select("pair_id", digest(seed, *place, F.col("pair_id")).alias("item"), digest(seed, *place).alias("draw")).collect()}


def test_quota_sample_equals_one_at_a_time_picking(spark):
    rows, df = candidates(spark)
    targets, cap = {"train": {"positive": 60, "hard": 50, "easy": 40}}, 25
    got = sorted(r["pair_id"] for r in S.balanced_quota_sample(df, targets, cap, 3, strict=True).collect())
    keys, counts, expected = hashes(spark, rows, 3), {}, []
    for kind in ("positive", "hard", "easy"):
        for gap, quota in S.even_quotas(targets["train"][kind]).items():
            queues = {}
            for r in sorted((r for r in rows if r[3] == kind and r[4] == gap), key=lambda r: (keys[r[0]][0], r[0])):
                queues.setdefault(r[2], []).append(r)
            for _ in range(quota):
                open_clusters = [c for c, q in queues.items() if q and counts.get(c, 0) < cap]
                best = min(open_clusters, key=lambda c: (counts.get(c, 0), keys[queues[c][0][0]][1], c))
                expected.append(queues[best].pop(0)[0])
                counts[best] = counts.get(best, 0) + 1
    assert got == sorted(expected)


def test_short_quota_is_an_error(spark):
    _, df = candidates(spark, 60)
    with pytest.raises(ValueError):
        S.balanced_quota_sample(df, {"train": {"positive": 300}}, 100, 3, strict=True)


def matching_tables(spark):
    rng = random.Random(2)
    schema = "split string, cluster_id bigint, pair_id string, frame_a bigint, frame_b bigint, gap_bin string, c1 double, c2 double"

    def rows(prefix, n):
        out = []
        for i in range(n):
            a = rng.randint(0, 5)
            gap = rng.choice((3, 8, 14))
            out.append(("train", rng.randint(0, 6), f"{prefix}{i:03d}", a, a + gap, {3: "short", 8: "medium", 14: "long"}[gap], rng.random(), rng.random()))
        return out

    return spark.createDataFrame(rows("t", 40), schema), spark.createDataFrame(rows("n", 160), schema)


def test_matching_is_one_to_one_capped_and_complete(spark):
    templates, negatives = matching_tables(spark)
    found = M.match_negatives(templates, negatives, ["c1", "c2"], cap=12).toPandas()
    assert len(found) == 40 and found["negative_id"].is_unique and found["template_id"].is_unique
    assert found.groupby("cluster_id").size().max() <= 12
    again = M.match_negatives(templates.repartition(7), negatives.repartition(3), ["c1", "c2"], cap=12).toPandas()
    pairs = lambda t: sorted(zip(t["template_id"], t["negative_id"]))
    assert pairs(found) == pairs(again)


def plain_matching(templates, negatives, batch_of, cap, batches):
    """The rounds with every free negative looked at, one lane, controls at places 6 and 7."""
    mean = [sum(t[i] for t in templates) / len(templates) for i in (6, 7)]
    sd = [(sum((t[i] - m) ** 2 for t in templates) / (len(templates) - 1)) ** 0.5 for i, m in zip((6, 7), mean)]
    z = lambda r: [r[6] / sd[0], r[7] / sd[1]]
    goal, free, used, out = [m / s for m, s in zip(mean, sd)], {n[2]: n for n in negatives}, Counter(), {}
    for batch in range(batches):
        waiting = {t[2]: t for t in templates if batch_of[t[2]] == batch}
        count, sums = len(out), [sum(z(n)[i] for n in out.values()) for i in (0, 1)]

        def cost(t, n, moved):
            value = sum((a - b) ** 2 for a, b in zip(z(t), z(n)))
            if count:
                value += 50 * sum(((s + a) / (count + 1) - g) ** 2 for s, a, g in zip(sums, z(n), goal))
            return round(value + (4 * (abs(t[3] - n[3]) + abs(t[4] - n[4])) if moved else 0), 9)

        while True:
            offers = {}
            for t in waiting.values():
                open_ = [n for n in free.values() if used[n[1]] < cap]
                same = [n for n in open_ if n[3:5] == t[3:5]]
                pool = same or [n for n in open_ if n[5] == t[5]]
                if pool:
                    offers[t[2]] = min((cost(t, n, not same), n[2]) for n in pool)
            winners = {}
            for t, (c, n) in offers.items():
                winners[n] = min(winners.get(n, (c, t)), (c, t))
            if not winners:
                break
            for n, (c, t) in sorted(winners.items(), key=lambda w: w[1]):
                if used[free[n][1]] < cap:
                    out[t] = free.pop(n)
                    used[out[t][1]] += 1
                    del waiting[t]
    return {t: n[2] for t, n in out.items()}


@pytest.mark.parametrize("n_templates, n_negatives, cap, frames", [(16, 100, 100, 3), (18, 16, 4, 200)])
def test_matching_equals_rounds_over_all_negatives(spark, monkeypatch, n_templates, n_negatives, cap, frames):
    """Few and many frame pairs, more templates than negatives, clusters that fill up."""
    monkeypatch.setattr(M, "KEPT", 3)
    monkeypatch.setattr(M, "ENOUGH", 2)
    runs = []
    kept = M._Search.__init__
    monkeypatch.setattr(M._Search, "__init__", lambda self, *a: (runs.append(self), kept(self, *a))[1])
    rng = random.Random(n_templates + frames)
    schema = "split string, cluster_id bigint, pair_id string, frame_a bigint, frame_b bigint, gap_bin string, c1 double, c2 double"

    def rows(prefix, n):
        out = []
        for i in range(n):
            a, gap = rng.randint(0, frames), rng.choice((3, 8, 14))
            cluster = 0 if i % 3 == 0 else rng.randint(1, 8)
            out.append(("train", cluster, f"{prefix}{i:03d}", a, a + gap, {3: "short", 8: "medium", 14: "long"}[gap], rng.random(), rng.random() ** 2))
        return out

    templates, negatives = rows("t", n_templates), rows("n", n_negatives)
    df = spark.createDataFrame(templates, schema)
    batch_of = {r[0]: r[1] for r in df.select("pair_id", F.pmod(F.xxhash64("pair_id"), F.lit(2))).collect()}
    got = M.match_negatives(df, spark.createDataFrame(negatives, schema), ["c1", "c2"], cap, strict=False, batches=2)
    assert {r["template_id"]: r["negative_id"] for r in got.collect()} == plain_matching(templates, negatives, batch_of, cap, 2)
    assert runs[0].searches <= 2 * 6


def test_negatives_stay_in_their_lane_and_clusters_under_one_cap(spark):
    rows = [("train", k, c, f"{k}{c}{i}", 1, 4, "short", float(i)) for k in ("hard", "easy") for c in (1, 2) for i in range(6)]
    schema = "split string, kind string, cluster_id bigint, pair_id string, frame_a bigint, frame_b bigint, gap_bin string, c double"
    negatives = spark.createDataFrame(rows, schema)
    templates = spark.createDataFrame([("train", k, 9, f"t{k}{i}", 1, 4, "short", float(i)) for k in ("hard", "easy") for i in range(4)], schema)
    prior = spark.createDataFrame([("train", 1, 3)], "split string, cluster_id bigint, used bigint")
    found = M.match_negatives(templates, negatives, ["c", "frame_a"], 6, prior, lanes=["split", "kind"]).toPandas()
    assert all(r.template_id[1:5] == r.negative_id[:4] for r in found.itertuples()) and len(found) == 8
    assert found.groupby("cluster_id").size().to_dict() in ({1: 3, 2: 5}, {1: 2, 2: 6})


def test_unbalanced_matches_are_refused(spark):
    rows = [(k, v + (k == "easy")) for k in ("positive", "hard", "easy") for v in (1.0, 2.0, 5.0)]
    with pytest.raises(ValueError, match="easy: largest SMD"):
        S.require_balance(spark.createDataFrame(rows, "kind string, v double"), {"v": F.col("v")})


def test_balance_of_equal_groups_is_zero(spark):
    rows = [(k, v) for k in ("positive", "hard", "easy") for v in (1.0, 2.0, 5.0)]
    report = S.balance_report(spark.createDataFrame(rows, "kind string, v double"), {"v": F.col("v")})
    gate = S.balance_gate(report).collect()
    assert all(r["max_smd"] == 0 and r["passed"] for r in gate) and len(gate) == 2


def test_definition_audit_lists_violations(spark):
    schema = "split string, pair_id string, cluster_id bigint, kind string, frame_a bigint, frame_b bigint, instance_a string, instance_b string, category_a string, category_b string, ratio double"
    good = ("train", "a", 1, "positive", 1, 2, "i", "i", "c", "c", 0.1)
    bad = [("train", "b", 1, "positive", 1, 1, "i", "j", "c", "c", 0.1), ("train", "c", 1, "easy", 1, 2, "i", "j", "c", "c", 0.1), ("train", "a", 1, "positive", 1, 2, "i", "i", "c", "c", 0.1)]
    row = P.pair_definition_audit(spark.createDataFrame([good, *bad], schema), 0.5, 3).first()
    assert row["violations"] == ["duplicate:a", "easy_definition:c", "positive_identity:b", "same_frame:b"]
    assert row["violation_count"] == 4 and not row["definitions_hold"] and not row["cap_respected"]
