import random
from collections import Counter

import pytest

from pairloom.operators import review as R

BINS = ("short", "medium", "long")


def errors(spark, n=1500):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        error = rng.choice(("false_positive", "false_negative"))
        cluster = 0 if i % 3 == 0 else rng.randint(1, 60)
        rows.append(dict(
            pair_id=f"p{rng.randint(0, n)}", system=rng.choice("AB"), error_type=error, gap_bin=rng.choice(BINS),
            difficulty=rng.choice(("hard", "easy")) if error == "false_positive" else None, visibility_stratum=rng.choice(("low", "high")),
            motion_stratum=rng.choice(("low", "high")), cluster_id=cluster, margin=round(rng.random(), 2), dataset=rng.choice("DE"),
            diagnosis=rng.choice(list(R.PRIORITY)),
        ))
    # One row per pair and system, as a scored table has.
    rows = list({(r["pair_id"], r["system"]): r for r in rows}.values())
    schema = ("pair_id string, system string, error_type string, gap_bin string, difficulty string, visibility_stratum string, motion_stratum string, "
              "cluster_id bigint, margin double, dataset string, diagnosis string")
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def fits(row, slot):
    return all(row[n] == v for n, v in slot.wanted)


def test_diverse_review_equals_greedy_on_all_candidates(spark):
    rows, df = errors(spark)
    slots = R.method_slots(("A", "B"))
    v, m, c, used, expected = Counter(), Counter(), Counter(), set(), []
    for slot in slots:
        pool = [r for r in rows if fits(r, slot) and r["pair_id"] not in used]
        best = min(pool, key=lambda r: (v[r["visibility_stratum"]] + m[r["motion_stratum"]] + c[r["cluster_id"]],
                                        max(v[r["visibility_stratum"]], m[r["motion_stratum"]], c[r["cluster_id"]]), -r["margin"], r["pair_id"]))
        expected.append(best["pair_id"])
        used.add(best["pair_id"])
        v[best["visibility_stratum"]] += 1
        m[best["motion_stratum"]] += 1
        c[best["cluster_id"]] += 1
    got = [r["pair_id"] for r in R.diverse_review(df, slots).orderBy("slot").collect()]
    assert got == expected and len(set(got)) == len(slots)


def test_scarce_review_equals_greedy_on_all_candidates(spark):
    rows, df = errors(spark, 700)
    slots = [R.Slot((("dataset", d), ("system", s), ("error_type", e))) for d in "DE" for s in "AB" for e in ("false_positive", "false_negative")] * 2
    g, k, c, used, expected, left = Counter(), Counter(), Counter(), set(), {}, list(range(len(slots)))
    while left:
        pools = {i: [r for r in rows if fits(r, slots[i]) and r["pair_id"] not in used] for i in left}
        i = min(left, key=lambda i: (len(pools[i]), i))
        best = min(pools[i], key=lambda r: (k[r["diagnosis"]], R.PRIORITY[r["diagnosis"]], g[r["gap_bin"]], c[r["dataset"], r["cluster_id"]], -r["margin"], r["pair_id"]))
        expected[i + 1] = best["pair_id"]
        used.add(best["pair_id"])
        k[best["diagnosis"]] += 1
        g[best["gap_bin"]] += 1
        c[best["dataset"], best["cluster_id"]] += 1
        left.remove(i)
    assert {r["slot"]: r["pair_id"] for r in R.scarce_review(df, slots).collect()} == expected


def test_slots_are_balanced():
    slots = R.method_slots(("A", "B", "C", "D"))
    assert len(slots) == 24 == len(set(slots))
    assert Counter(dict(s.wanted).get("difficulty") for s in slots) == {None: 12, "hard": 6, "easy": 6}


def test_missing_candidate_is_an_error(spark):
    _, df = errors(spark, 50)
    with pytest.raises(ValueError):
        R.diverse_review(df.where("system = 'A'"), R.method_slots(("A", "B")))


def test_unfilled_slots_stay_visible(spark):
    rows, df = errors(spark, 50)
    slots = R.method_slots(("A", "B"))
    for sample in (R.diverse_review(df.where("system = 'A'"), slots, strict=False), R.scarce_review(df.where("system = 'A'"), slots, strict=False)):
        got = {r["slot"]: r["pair_id"] for r in sample.collect()}
        assert sorted(got) == list(range(1, len(slots) + 1))
        assert all(got[i + 1] is None for i, s in enumerate(slots) if dict(s.wanted)["system"] == "B")
        filled = [p for p in got.values() if p is not None]
        assert filled and len(filled) == len(set(filled))


def test_slot_mask_names_every_slot(spark):
    rows, df = errors(spark, 60)
    slots = R.method_slots(("A", "B"))
    masks = {(r["pair_id"], r["system"]): r["m"] for r in df.select("pair_id", "system", R.slot_mask(slots).alias("m")).collect()}
    assert all(masks[r["pair_id"], r["system"]] == sum(1 << i for i, s in enumerate(slots) if fits(r, s)) for r in rows)
    with pytest.raises(ValueError, match="at most 63"):
        R.slot_mask(slots * 6)


def test_second_diagnosis_forms_the_pairs_once(spark, monkeypatch):
    from pairloom.plans import review_jobs, views

    made = []
    pairs = views.pairs
    monkeypatch.setattr(views, "pairs", lambda *args: made.append(1) or pairs(*args))
    assert "diagnosis" in review_jobs.two_system_errors(spark, "/root/testdata/sf0.001").columns and len(made) == 1
