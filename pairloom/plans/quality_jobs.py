"""Eligibility, keys, agreement, leakage, fingerprints and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import canonical_text
from ..operators import quality as Q
from ..sources import tables as S
from . import views as V
from .registry import query

def rules():
    return {
        "area_below_threshold": F.col("area") < 10,
        "attribute_below_threshold": F.col("attribute") < 20,
        "error_observation": F.col("instance") == "error",
    }


REASONS_SQL = """list_filter([CASE WHEN area < 10 THEN 'area_below_threshold' END, CASE WHEN attribute < 20 THEN 'attribute_below_threshold' END,
 CASE WHEN instance = 'error' THEN 'error_observation' END], lambda x: x IS NOT NULL)"""


@query("P1_exclusion_reasons", f"""WITH {V.OBS}
SELECT split, array_to_string(reasons, ';') AS reasons, count(*) AS rows FROM (SELECT split, {REASONS_SQL} AS reasons FROM obs) WHERE len(reasons) > 0 GROUP BY ALL""")
def exclusion_reasons(spark, folder):
    _, excluded = Q.split_by_eligibility(V.observations(spark, folder), rules())
    return excluded.groupBy("split", F.concat_ws(";", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


@query("P1_eligible_rows", f"""WITH {V.OBS} SELECT observation_id, cluster_id, frame, instance FROM obs WHERE len({REASONS_SQL}) = 0""")
def eligible_rows(spark, folder):
    kept, _ = Q.split_by_eligibility(V.observations(spark, folder), rules())
    return kept.select("observation_id", "cluster_id", "frame", "instance")


@query("P2_valid_value_count", """
SELECT l_suppkey AS group_id, count(*) AS points, count(*) FILTER (isfinite(depth) AND depth > 0) AS valid
FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_extendedprice * l_discount END AS depth FROM lineitem) GROUP BY 1 HAVING valid >= 32""")
def valid_values(spark, folder):
    depth = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_extendedprice") * F.col("l_discount"))
    rows = V.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("group_id"), depth.alias("depth"))
    return rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(~Q.not_finite(F.col("depth")) & (F.col("depth") > 0)).alias("valid")
    ).where("valid >= 32")


@query("P5_requested_ids", f"""WITH {V.OBS} SELECT observation_id, cluster_id FROM obs WHERE cluster_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def requested_ids(spark, folder):
    obs = V.observations(spark, folder)
    segment = V.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cluster_id"))
    wanted = segment.join(obs.select("cluster_id"), "cluster_id", "left_semi")
    return Q.keep_known(obs, wanted, ["cluster_id"]).select("observation_id", "cluster_id")


@query("P6_model_input_fields", f"""WITH {V.OBS} SELECT observation_id, frame, area, attribute AS visibility FROM obs""")
def model_inputs(spark, folder):
    inputs = V.observations(spark, folder).select("observation_id", "frame", "area", F.col("attribute").alias("visibility"))
    return Q.forbid_leaks(inputs)


@query("P9_canonical_ids", "SELECT trim(p_name) AS name, trim(p_partkey::VARCHAR) AS part_id, count(*) AS rows FROM part GROUP BY ALL")
def canonical_ids(spark, folder):
    parts = V.table(spark, folder, "part")
    raw = parts.select(F.encode("p_name", "UTF-8").alias("bytes"), "p_partkey")
    named = raw.select(canonical_text(F.decode("bytes", "UTF-8")).alias("name"), canonical_text(F.col("p_partkey")).alias("part_id"))
    return named.groupBy("name", "part_id").agg(F.count(F.lit(1)).alias("rows"))


@query("P10_flat_vector_rows", """
SELECT vec_id, u.i - 1 AS instance, list_sum(embedding[(u.i - 1) * 16 + 1 : u.i * 16]::DOUBLE[]) IS NOT NULL AS filled, len(embedding[(u.i - 1) * 16 + 1 : u.i * 16]) AS frames,
 round(embedding[(u.i - 1) * 16 + 1]::DOUBLE, 6) AS first_value, round(embedding[u.i * 16]::DOUBLE, 6) AS last_value FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS i) u""")
def flat_vectors(spark, folder):
    width = 16
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / width).cast("int") - 1), lambda i: F.slice("embedding", i * width + 1, width))
    rows = V.table(spark, folder, "embeddings").select("vec_id", F.posexplode(blocks).alias("instance", "values"))
    return rows.select(
        "vec_id", "instance", F.element_at("values", 1).isNotNull().alias("filled"), F.size("values").alias("frames"),
        F.round(F.element_at("values", 1).cast("double"), 6).alias("first_value"), F.round(F.element_at("values", -1).cast("double"), 6).alias("last_value"),
    )


@query("P22_finite_guard", """
SELECT column_name AS "column", bad::BIGINT AS bad, bad = 0 AS passed FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'discounted']) AS column_name,
 unnest([count(*) FILTER (NOT isfinite(l_quantity)), count(*) FILTER (NOT isfinite(l_extendedprice)), count(*) FILTER (l_discount = 0)]) AS bad FROM lineitem)""")
def finite_guard(spark, folder):
    discounted = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.ln(F.when(F.col("l_discount") > 0, F.col("l_discount"))))
    rows = V.table(spark, folder, "lineitem").withColumn("discounted", discounted)
    return Q.finite_report(rows, ["l_quantity", "l_extendedprice", "discounted"])


@query("J1_index_inputs_join", f"""WITH {V.OBS} SELECT split, count(*) AS joined, 0 AS split_mismatch, 0 AS frame_mismatch FROM obs GROUP BY split""")
def index_inputs(spark, folder):
    obs = V.observations(spark, folder)
    index = obs.select("observation_id", "cluster_id", "split", "frame")
    inputs = V.table(spark, folder, "events").select(
        F.col("event_id").alias("observation_id"), V.split_of(F.col("user_id")).alias("input_split"),
        F.expr("(unix_timestamp(cast(ts as timestamp_ntz)) - unix_timestamp(timestamp_ntz'2024-01-01 00:00:00')) div 3600").alias("input_frame"), "value",
    )
    joined = index.join(inputs, "observation_id")
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("joined"), F.count_if(F.col("split") != F.col("input_split")).alias("split_mismatch"),
        F.count_if(F.col("frame") != F.col("input_frame")).alias("frame_mismatch"),
    )


@query("J2_two_endpoint_join", f"""WITH {V.PAIRS} SELECT p.pair_id, a.area AS first_area, b.area AS second_area FROM pairs p JOIN obs a ON p.observation_id_a = a.observation_id JOIN obs b ON p.observation_id_b = b.observation_id""")
def two_endpoints(spark, folder):
    from ..operators.features import with_endpoints

    keys = V.pairs(spark, folder).select("pair_id", "cluster_id", "observation_id_a", "observation_id_b")
    joined = with_endpoints(keys, V.observations(spark, folder), ["area"])
    return joined.select("pair_id", F.col("area_a").alias("first_area"), F.col("area_b").alias("second_area"))


@query("J5_used_endpoints", f"""WITH {V.PAIRS} SELECT observation_id, cluster_id FROM obs WHERE observation_id IN (SELECT observation_id_a FROM pairs WHERE kind = 'hard' UNION SELECT observation_id_b FROM pairs WHERE kind = 'hard')""")
def used_endpoints(spark, folder):
    hard = V.pairs(spark, folder).where("kind = 'hard'")
    ends = hard.select(F.explode(F.array("observation_id_a", "observation_id_b")).alias("observation_id"))
    return V.observations(spark, folder).join(ends, "observation_id", "left_semi").select("observation_id", "cluster_id")


@query("J6_missing_keys", "SELECT DISTINCT c_custkey AS cluster_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def missing_keys(spark, folder):
    asked = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("cluster_id"))
    known = V.table(spark, folder, "events").select(F.col("user_id").alias("cluster_id"))
    return Q.missing_keys(asked, known, ["cluster_id"])


@query("J7_key_set_overlap", """
WITH k AS (SELECT k, bool_or(t = 1) AS in_customers, bool_or(t = 2) AS in_orders, bool_or(t = 3) AS in_events FROM
 (SELECT c_custkey AS k, 1 AS t FROM customer UNION ALL SELECT o_custkey, 2 FROM orders UNION ALL SELECT user_id, 3 FROM events) GROUP BY k)
SELECT in_customers, in_orders, in_events, count(*) AS keys FROM k GROUP BY ALL""")
def key_sets(spark, folder):
    named = {"customers": ("customer", "c_custkey"), "orders": ("orders", "o_custkey"), "events": ("events", "user_id")}
    return Q.key_overlap({n: V.table(spark, folder, t).select(F.col(c).alias("k")) for n, (t, c) in named.items()}, ["k"])


@query("J8_dimension_lookup", """
SELECT n.n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY ALL""")
def dimension_lookup(spark, folder):
    # No hint: Spark broadcasts a dimension only while it is under its size limit.
    orders = V.table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    customers = V.table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = V.table(spark, folder, "nation").select("n_nationkey", "n_name")
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("J9_field_agreement", f"""WITH {V.PAIRS}
SELECT count(*) AS joined, unnest(['label', 'difficulty', 'gap_bin', 'shifted']) AS field, unnest([0, 0, 0, count(*) FILTER (gap_bin <> CASE WHEN gap + 1 <= 5 THEN 'short' WHEN gap + 1 <= 11 THEN 'medium' ELSE 'long' END)]) AS differing FROM pairs""")
def field_agreement(spark, folder):
    from ..functions.bins import gap_bin

    pairs = V.pairs(spark, folder)
    left = pairs.withColumn("shifted", F.col("gap_bin"))
    right = V.pairs(spark, folder).withColumn("shifted", gap_bin(F.col("gap") + 1))
    return Q.agreement(left, right, ["pair_id"], ["label", "difficulty", "gap_bin", "shifted"])


@query("J10_keyed_alignment", f"""WITH {V.SCORED}
SELECT split, count(*) AS aligned, round(avg(b - a), 9) AS mean_gain FROM (SELECT split, pair_id, max(score) FILTER (system = 'A') AS a, max(score) FILTER (system = 'B') AS b FROM scored GROUP BY ALL) GROUP BY split""")
def keyed_alignment(spark, folder):
    scored = V.scored(spark, folder)
    first = scored.where("system = 'A'").select("pair_id", "split", F.col("score").alias("a"))
    second = scored.where("system = 'B'").select("pair_id", F.col("score").alias("b"))
    return first.join(second, "pair_id").groupBy("split").agg(F.count(F.lit(1)).alias("aligned"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("mean_gain"))


@query("A1_grouped_counts", f"WITH {V.OBS} SELECT split, instance, category, count(*) AS rows FROM obs GROUP BY ALL")
def grouped_counts(spark, folder):
    return V.observations(spark, folder).groupBy("split", "instance", "category").agg(F.count(F.lit(1)).alias("rows"))


@query("A4_duplicate_keys", f"WITH {V.OBS} SELECT cluster_id, frame, instance, count(*) AS copies FROM obs GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, folder):
    return Q.duplicate_keys(V.observations(spark, folder), ["cluster_id", "frame", "instance"])


@query("A4_distinct_count", f"WITH {V.OBS} SELECT count(*) AS rows, count(DISTINCT (cluster_id, frame, instance)) AS keys FROM obs")
def distinct_keys(spark, folder):
    return Q.distinct_count(V.observations(spark, folder), ["cluster_id", "frame", "instance"])


@query("A37_named_checks", f"""WITH {V.PAIRS}, c AS (SELECT count(*) AS n, count(DISTINCT pair_id) AS ids, sum(label) AS p, count(*) FILTER (kind = 'positive') AS kp, count(*) FILTER (frame_a >= frame_b) AS bad, min(gap) AS lo, max(gap) AS hi FROM pairs)
SELECT check_name, observed, expected, observed = expected AS passed FROM (SELECT unnest(['unique_ids', 'labels_match_kinds', 'frames_ordered', 'smallest_gap', 'largest_gap']) AS check_name,
 unnest([ids, p, bad, lo, hi])::VARCHAR AS observed, unnest([n, kp, 0, 1, 23])::VARCHAR AS expected FROM c)""")
def named_checks(spark, folder):
    pairs = V.pairs(spark, folder)
    checks = {
        "unique_ids": (F.count_distinct("pair_id"), F.count(F.lit(1))),
        "labels_match_kinds": (F.sum("label"), F.count_if(F.col("kind") == "positive")),
        "frames_ordered": (F.count_if(F.col("frame_a") >= F.col("frame_b")), F.lit(0)),
        "smallest_gap": (F.min("gap"), F.lit(1)),
        "largest_gap": (F.max("gap"), F.lit(23)),
    }
    return Q.named_checks(checks, pairs)


HASH_SQL = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"


@query("S8_table_fingerprint", f"""
SELECT o_orderpriority, count(*) AS rows, sum({HASH_SQL.format("o_orderkey || '|' || o_custkey || '|' || coalesce(nullif(o_orderstatus, 'P'), '~')")})::BIGINT AS hash_sum FROM orders GROUP BY 1""")
def table_fingerprint(spark, folder):
    orders = V.table(spark, folder, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return Q.fingerprint(orders, ["o_orderkey", "o_custkey", "status"], ["o_orderpriority"])


@query("S6_source_provenance", "SELECT event_id, 'events.parquet' AS source_file, row_number() OVER (ORDER BY event_id) - 1 AS source_index FROM events")
def provenance(spark, folder):
    rows = S.with_provenance(V.table(spark, folder, "events"))
    return rows.select("event_id", F.element_at(F.split("source_file", "/"), -1).alias("source_file"), "source_index")


@query("S6_provenance_by_order", "SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS source_index FROM events")
def provenance_by_order(spark, folder):
    return S.with_provenance(V.table(spark, folder, "events"), ["user_id", "event_id"]).select("event_id", "source_index")


@query("S7_file_checksums")
def checksums(spark, folder):
    return S.file_checksums(spark, f"{folder}/*.parquet")


@query("F31_numeric_id_order", f"""SELECT id, row_number() OVER (PARTITION BY nation ORDER BY id::BIGINT) AS place FROM (SELECT c_custkey::VARCHAR AS id, c_nationkey AS nation FROM customer)""")
def numeric_order(spark, folder):
    from ..operators.ordering import ranked

    rows = V.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("nation"))
    placed = ranked(rows.withColumn("_number", F.col("id").cast("bigint")), ["nation"], ["_number"])
    return placed.select("id", (F.col("rank") + 1).alias("place"))


@query("F4_rounded_metrics", "SELECT o_orderpriority, round(avg(o_totalprice) / 1000000, 8) AS mean_price, round(avg(o_orderkey / 7.0) / 1000000, 8) AS mean_key FROM orders GROUP BY 1")
def rounded_metrics(spark, folder):
    return V.table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.round(F.avg("o_totalprice") / 1_000_000, 8).alias("mean_price"), F.round(F.avg(F.col("o_orderkey") / 7.0) / 1_000_000, 8).alias("mean_key")
    )


@query("U1_union_of_kinds", f"WITH {V.PAIRS} SELECT kind, split, count(*) AS rows, min(pair_id) AS first_id FROM pairs GROUP BY ALL")
def union_of_kinds(spark, folder):
    pairs = V.pairs(spark, folder)
    whole = pairs.where("kind = 'positive'")
    for kind in ("hard", "easy"):
        whole = whole.unionByName(pairs.where(F.col("kind") == kind))
    return whole.groupBy("kind", "split").agg(F.count(F.lit(1)).alias("rows"), F.min("pair_id").alias("first_id"))


@query("U2_split_overlaps", f"""WITH {V.OBS}, s AS (SELECT instance || '/' || attribute AS look, array_to_string(list_sort(list(DISTINCT split)), '+') AS splits FROM obs GROUP BY 1)
SELECT splits, count(*) AS keys FROM s WHERE splits LIKE '%+%' GROUP BY 1""")
def split_overlaps(spark, folder):
    looks = V.observations(spark, folder).withColumn("look", F.concat_ws("/", "instance", "attribute"))
    return Q.split_overlaps(looks, "look")


@query("U2_cluster_disjoint_splits", f"""WITH {V.OBS} SELECT count(DISTINCT cluster_id) AS clusters, 0 AS shared FROM obs""")
def disjoint_splits(spark, folder):
    obs = V.observations(spark, folder)
    shared = Q.split_overlaps(obs, "cluster_id").agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("shared"))
    return Q.distinct_count(obs, ["cluster_id"]).select(F.col("keys").alias("clusters"), shared.scalar().alias("shared"))


@query("U3_set_differences", """
SELECT 'left' AS side, k FROM (SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT user_id * 2 FROM events) UNION ALL
SELECT 'right', k FROM (SELECT DISTINCT user_id * 2 AS k FROM events EXCEPT SELECT c_custkey FROM customer)""")
def set_differences(spark, folder):
    left = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).distinct()
    right = V.table(spark, folder, "events").select((F.col("user_id") * 2).alias("k")).distinct()
    return Q.multiset_difference(left, right)


@query("U4_parts_equal_whole", f"""WITH {V.OBS} SELECT 'disjoint_parts' AS comparison, count(*) AS rows, 0 AS differing FROM obs UNION ALL
SELECT 'dev_twice', count(*), count(*) FILTER (split = 'dev') FROM obs""")
def parts_equal_whole(spark, folder):
    whole = V.observations(spark, folder).select("observation_id", "split")
    parts = whole.where("split = 'train'").unionByName(whole.where("split = 'dev'")).unionByName(whole.where("split = 'test'"))
    results = None
    for name, table in (("disjoint_parts", parts), ("dev_twice", parts.unionByName(whole.where("split = 'dev'")))):
        differing = Q.multiset_difference(whole, table).agg(F.count(F.lit(1)).alias("differing"))
        row = whole.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("comparison"), "rows", differing.scalar().alias("differing"))
        results = row if results is None else results.unionByName(row)
    return results


@query("U5_global_uniqueness", f"""WITH {V.BAND}, u AS (SELECT least(observation_id_a, observation_id_b) AS low, greatest(observation_id_a, observation_id_b) AS high FROM band)
SELECT count(*) AS rows, count(DISTINCT (low, high)) AS keys FROM u""")
def global_uniqueness(spark, folder):
    band = V.banded(spark, folder)
    ends = [F.col("observation_id_a"), F.col("observation_id_b")]
    return Q.distinct_count(band.select(F.least(*ends).alias("low"), F.greatest(*ends).alias("high")), ["low", "high"])


@query("T12_final_order", f"""WITH {V.OBS} SELECT cluster_id, frame, observation_id, split FROM obs""")
def final_order(spark, folder):
    return V.observations(spark, folder).select("cluster_id", "frame", "observation_id", "split").orderBy("split", "cluster_id", "frame", "observation_id")
