"""Cluster audit, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import selection as S
from . import views as V
from .pair_jobs import inventory
from .registry import query

FIELDS = ("balance", "orders", "spend")
SAMPLE = 120
SIZES = {"train": 72, "dev": 24, "test": 24}
TRIES = 12


def pool(spark, folder):
    """Customers as clusters, with the fields that selection balances."""
    customers = V.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cluster_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )
    orders = V.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("spend")
    )
    return customers.join(orders, "cluster_id")


POOL = """pool AS (SELECT c_custkey AS cluster_id, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation, orders, spend
  FROM customer JOIN (SELECT o_custkey, count(*) AS orders, avg(o_totalprice) AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def allocation_sql(source: str, stratum: str, target: int, p: str = "") -> str:
    return f"""{p}cap AS (SELECT {stratum} AS stratum, count(*) AS capacity FROM {source} GROUP BY 1),
{p}raw AS (SELECT *, {target} * capacity / sum(capacity) OVER () AS raw FROM {p}cap),
{p}alloc AS (SELECT stratum, capacity, floor(raw)::BIGINT + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, capacity DESC, stratum DESC) <= {target} - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS allocated FROM {p}raw)"""


ASSESS_SQL = f"""WITH {V.OBS}, seen AS (SELECT DISTINCT cluster_id, instance, category, frame % 24 AS frame FROM obs WHERE area >= 10),
cnt AS (SELECT c.cluster_id, c.instances, coalesce(p.positive_pairs, 0) AS positive_pairs, coalesce(p.hard_pairs, 0) AS hard_pairs
FROM (SELECT cluster_id, count(DISTINCT instance) AS instances FROM obs GROUP BY 1) c
LEFT JOIN (SELECT a.cluster_id, count(*) FILTER (a.instance = b.instance) AS positive_pairs, count(*) FILTER (a.instance < b.instance AND a.category = b.category) AS hard_pairs
  FROM seen a JOIN seen b ON a.cluster_id = b.cluster_id AND abs(a.frame - b.frame) BETWEEN 2 AND 23 GROUP BY 1) p USING (cluster_id)),
assessed AS (SELECT *, positive_pairs >= 400 AND hard_pairs >= 400 AS eligible,
  CASE WHEN positive_pairs >= 400 AND hard_pairs >= 400 THEN 'eligible' ELSE concat_ws(';', CASE WHEN positive_pairs < 400 THEN 'insufficient_positive_pairs' END, CASE WHEN hard_pairs < 400 THEN 'insufficient_hard_negative_pairs' END) END AS reason,
  CASE WHEN instances BETWEEN 3 AND 4 THEN '03-04' WHEN instances BETWEEN 5 AND 6 THEN '05-06' ELSE 'other-' || lpad(instances::VARCHAR, 2, '0') END AS object_bin,
  least(positive_pairs, hard_pairs) AS pair_capacity FROM cnt)"""


def assessed(spark, folder):
    counts = P.visibility_pair_counts(inventory(spark, folder), "visibility", 10, 2, 23, ["category"])
    return S.assess_clusters(counts.drop("usable_observations"), 400, 400)


@query("P3_cluster_eligibility", ASSESS_SQL + " SELECT * FROM assessed")
def cluster_eligibility(spark, folder):
    return assessed(spark, folder)


@query("W1_capacity_tertiles", ASSESS_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY pair_capacity, cluster_id) - 1 AS rank, count(*) OVER () AS n FROM assessed)
SELECT cluster_id, pair_capacity, CASE (3 * rank) // n WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS tertile FROM r""")
def capacity_tertiles(spark, folder):
    return S.rank_tertiles(assessed(spark, folder), "pair_capacity", "cluster_id", "tertile").select("cluster_id", "pair_capacity", "tertile")


@query("P4_repeated_instances", f"""WITH {V.OBS}, pi AS (SELECT cluster_id, instance, count(*) AS n FROM obs WHERE area >= 20 GROUP BY ALL)
SELECT cluster_id, count(*) FILTER (n >= 2) AS repeated_instances, cluster_id % 10 = 3 AS pilot, count(*) FILTER (n >= 2) >= 2 AND cluster_id % 10 <> 3 AS eligible FROM pi GROUP BY cluster_id""")
def repeated_instances(spark, folder):
    return S.repeated_instances(V.observations(spark, folder).where("area >= 20"), pilot(spark, folder))


def pilot(spark, folder):
    return V.table(spark, folder, "events").select(F.col("user_id").alias("cluster_id")).where("cluster_id % 10 = 3").distinct()


@query("J18_pilot_exclusion", f"WITH {V.OBS} SELECT cluster_id, count(*) AS rows FROM obs WHERE cluster_id % 10 <> 3 GROUP BY 1")
def pilot_exclusion(spark, folder):
    kept = V.observations(spark, folder).join(pilot(spark, folder), "cluster_id", "left_anti")
    return kept.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("rows"))


@query("T1_proportional_allocation", f"WITH {POOL}, {allocation_sql('pool', 'nation', SAMPLE)} SELECT stratum AS nation, capacity, allocated FROM alloc")
def allocation(spark, folder):
    return S.proportional_allocation(S.stratum_sizes(pool(spark, folder), "nation"), SAMPLE, "nation")


SELECTED = f"""{allocation_sql('pool', 'segment', SAMPLE)},
selected AS (SELECT * EXCLUDE (rn, allocated) FROM (SELECT pool.*, allocated, row_number() OVER (PARTITION BY segment ORDER BY sha256('5|sample|' || cluster_id), cluster_id) AS rn FROM pool JOIN alloc ON segment = stratum) WHERE rn <= allocated)"""


def selected(spark, folder):
    return S.stratified_sample(pool(spark, folder), "segment", SAMPLE, 5)


@query("T2_stratified_sample", f"WITH {POOL}, {SELECTED} SELECT cluster_id, segment FROM selected")
def stratified_sample(spark, folder):
    return selected(spark, folder).select("cluster_id", "segment")


SPLIT_SQL = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY sha256('5|split|' || cluster_id), cluster_id) - 1 AS rn, count(*) OVER (PARTITION BY segment) AS n FROM selected),
g AS (SELECT count(*) FILTER (n >= 3) AS g FROM (SELECT segment, count(*) AS n FROM selected GROUP BY 1)),
slot AS (SELECT split, row_number() OVER (ORDER BY (i + 0.5) / k, o) - 1 AS place FROM (
  SELECT 'train' AS split, 0 AS o, {SIZES['train']} - g AS k, unnest(range({SIZES['train']} - g)) AS i FROM g UNION ALL SELECT 'dev', 1, {SIZES['dev']} - g, unnest(range({SIZES['dev']} - g)) FROM g UNION ALL SELECT 'test', 2, {SIZES['test']} - g, unnest(range({SIZES['test']} - g)) FROM g)),
rest AS (SELECT *, row_number() OVER (ORDER BY segment, sha256('5|split|' || cluster_id)) - 1 AS place FROM placed WHERE NOT (n >= 3 AND rn < 3)),
assigned AS (SELECT cluster_id, segment, CASE rn WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM placed WHERE n >= 3 AND rn < 3 UNION ALL SELECT cluster_id, segment, slot.split FROM rest JOIN slot USING (place))"""


def assigned(spark, folder):
    return S.exact_split(selected(spark, folder), SIZES, "segment", 5)


@query("T4_exact_stratified_split", f"WITH {POOL}, {SELECTED}, {SPLIT_SQL} SELECT cluster_id, segment, split FROM assigned")
def exact_split(spark, folder):
    return assigned(spark, folder).select("cluster_id", "segment", "split")


@query("A40_strata_by_split", f"WITH {POOL}, {SELECTED}, {SPLIT_SQL} SELECT segment, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM assigned GROUP BY segment")
def strata_by_split(spark, folder):
    return S.contingency(assigned(spark, folder), "segment", "split", list(SIZES))


FIELD_LIST = ", ".join(f"'{f}'" for f in FIELDS)
LONG = "SELECT {keys} unnest([" + FIELD_LIST + "]) AS field, unnest([balance, orders, spend]) AS v FROM {src}"


@query("T5_balanced_split", f"""WITH {POOL}, copies AS (SELECT pool.*, CAST(t AS INTEGER) AS try, row_number() OVER (PARTITION BY t ORDER BY sha256('9|' || t || '|' || cluster_id), cluster_id) - 1 AS rn FROM pool, range({TRIES}) r(t)),
a AS (SELECT *, CASE WHEN rn % 5 < 3 THEN 'train' WHEN rn % 5 = 3 THEN 'dev' ELSE 'test' END AS split FROM copies),
pm AS (SELECT field, avg(v) AS mu, var_samp(v) AS va FROM ({LONG.format(keys='', src='pool')}) GROUP BY 1),
sm AS (SELECT try, split, field, avg(v) AS mu, var_samp(v) AS va FROM ({LONG.format(keys='try, split,', src='a')}) GROUP BY ALL),
o AS (SELECT try, round(sum(((sm.mu - pm.mu) / sqrt((sm.va + pm.va) / 2)) ** 2), 9) AS objective FROM sm JOIN pm USING (field) GROUP BY try),
best AS (SELECT * FROM o ORDER BY objective, try LIMIT 1)
SELECT cluster_id, split, try, objective FROM a JOIN best USING (try)""")
def balanced_split(spark, folder):
    return S.balanced_split(pool(spark, folder), FIELDS, TRIES, 9)


@query("T6_balanced_subsample", f"""WITH {POOL}, e AS (SELECT quantile_cont(balance, [0.2, 0.4, 0.6, 0.8]) AS e1, quantile_cont(orders, [0.2, 0.4, 0.6, 0.8]) AS e2, quantile_cont(spend, [0.2, 0.4, 0.6, 0.8]) AS e3 FROM pool),
b AS (SELECT pool.*, len(list_filter(list_distinct(e1), lambda x: x <= balance)) AS b1, len(list_filter(list_distinct(e2), lambda x: x <= orders)) AS b2, len(list_filter(list_distinct(e3), lambda x: x <= spend)) AS b3 FROM pool, e),
{allocation_sql('b', 'b1', SAMPLE)},
copies AS (SELECT b.*, CAST(t AS INTEGER) AS try, row_number() OVER (PARTITION BY t, b1 ORDER BY sha256('9|' || t || '|' || cluster_id), cluster_id) AS rn FROM b, range({TRIES}) r(t)),
taken AS (SELECT c.* FROM copies c JOIN alloc ON b1 = stratum WHERE rn <= allocated),
pm AS (SELECT field, avg(v) AS mu, stddev_pop(v) AS sd FROM ({LONG.format(keys='', src='pool')}) GROUP BY 1),
sm AS (SELECT try, field, avg(v) AS mu, stddev_pop(v) AS sd FROM ({LONG.format(keys='try,', src='taken')}) GROUP BY ALL),
shift AS (SELECT try, sum(20 * ((sm.mu - pm.mu) / pm.sd) ** 2 + 2 * ((sm.sd - pm.sd) / pm.sd) ** 2) AS s FROM sm JOIN pm USING (field) GROUP BY try),
full_cells AS (SELECT field, bin, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS field, unnest([b1, b2, b3]) AS bin FROM b) GROUP BY ALL),
seen AS (SELECT try, field, bin, count(*) AS n FROM (SELECT try, unnest([1, 2, 3]) AS field, unnest([b1, b2, b3]) AS bin FROM taken) GROUP BY ALL),
exp AS (SELECT CAST(t AS INTEGER) AS try, field, bin, n * {SAMPLE} / (SELECT count(*) FROM pool) AS e FROM full_cells, range({TRIES}) r(t)),
err AS (SELECT exp.try, sum(((coalesce(seen.n, 0) - e) / greatest(e, 1.0)) ** 2) AS s FROM exp LEFT JOIN seen USING (try, field, bin) GROUP BY 1),
o AS (SELECT try, round(shift.s + err.s, 8) AS objective FROM shift JOIN err USING (try)), best AS (SELECT * FROM o ORDER BY objective, try LIMIT 1)
SELECT cluster_id, try, objective FROM taken JOIN best USING (try)""")
def balanced_subsample(spark, folder):
    return S.balanced_subsample(pool(spark, folder), FIELDS, SAMPLE, TRIES, 9)


SCALED = """sc AS (SELECT cluster_id, (balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()) AS balance, (orders - min(orders) OVER ()) / (max(orders) OVER () - min(orders) OVER ()) AS orders,
 (spend - min(spend) OVER ()) / (max(spend) OVER () - min(spend) OVER ()) AS spend, sha256('3|' || cluster_id) AS tie FROM pool)"""


def distance_sql(p: str) -> str:
    return f"sqrt((s.balance - {p}.balance) ** 2 + (s.orders - {p}.orders) ** 2 + (s.spend - {p}.spend) ** 2)"


@query("T7_farthest_first", f"""WITH {POOL}, {SCALED}, p1 AS (SELECT *, 0.0 AS d FROM sc ORDER BY tie LIMIT 1),
p2 AS (SELECT s.*, round({distance_sql('p1')}, 9) AS d FROM sc s, p1 WHERE s.cluster_id <> p1.cluster_id ORDER BY d DESC, s.tie LIMIT 1),
p3 AS (SELECT s.*, round(least({distance_sql('p1')}, {distance_sql('p2')}), 9) AS d FROM sc s, p1, p2 WHERE s.cluster_id NOT IN (p1.cluster_id, p2.cluster_id) ORDER BY d DESC, s.tie LIMIT 1),
p4 AS (SELECT s.*, round(least({distance_sql('p1')}, {distance_sql('p2')}, {distance_sql('p3')}), 9) AS d FROM sc s, p1, p2, p3 WHERE s.cluster_id NOT IN (p1.cluster_id, p2.cluster_id, p3.cluster_id) ORDER BY d DESC, s.tie LIMIT 1)
SELECT cluster_id, 1 AS place, d AS distance FROM p1 UNION ALL SELECT cluster_id, 2, d FROM p2 UNION ALL SELECT cluster_id, 3, d FROM p3 UNION ALL SELECT cluster_id, 4, d FROM p4""")
def farthest_first(spark, folder):
    return S.farthest_first(pool(spark, folder), FIELDS, 4, 3)


@query("T8_hash_sample", f"WITH {POOL} SELECT cluster_id FROM pool ORDER BY sha256('8|' || cluster_id), cluster_id LIMIT 40")
def hash_sample(spark, folder):
    return S.hash_sample(pool(spark, folder).select("cluster_id"), 40, 8, "cluster_id")


@query("F24_min_max_scaling", f"WITH {POOL}, {SCALED} SELECT cluster_id, round(balance, 9) AS balance, round(orders, 9) AS orders, round(spend, 9) AS spend FROM sc")
def min_max(spark, folder):
    scaled = S.min_max_scaled(pool(spark, folder).select("cluster_id", *FIELDS), FIELDS)
    return scaled.withColumns({f: F.round(f, 9) for f in FIELDS})


@query("A14_subset_differences", f"""WITH {POOL}, {SELECTED}, p AS (SELECT field, avg(v) AS mu, var_samp(v) AS va FROM ({LONG.format(keys='', src='pool')}) GROUP BY 1),
s AS (SELECT segment, field, avg(v) AS mu, var_samp(v) AS va FROM ({LONG.format(keys='segment,', src='selected')}) GROUP BY ALL)
SELECT segment, field, round(abs(s.mu - p.mu) / sqrt((s.va + p.va) / 2), 8) AS smd FROM s JOIN p USING (field)""")
def subset_differences(spark, folder):
    return S.subset_differences(pool(spark, folder), selected(spark, folder), FIELDS, ["segment"]).withColumn("smd", F.round("smd", 8))


@query("A15_field_profile", f"""WITH {POOL} SELECT field, round(min(v), 6) AS low, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS high FROM ({LONG.format(keys='', src='pool')}) GROUP BY field""")
def profile(spark, folder):
    return S.field_profile(pool(spark, folder), FIELDS).withColumns({c: F.round(c, 6) for c in ("low", "mean", "median", "high")})
