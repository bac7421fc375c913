"""Round trips through every sink, in a fresh path of the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import tables as S
from . import views as V
from .registry import query

COLUMNS = ["pair_id", "split", "kind", "difficulty", "cluster_id", "frame_a", "frame_b", "gap", "label"]
ROWS_SQL = f"WITH {V.PAIRS} SELECT {', '.join(COLUMNS)} FROM pairs"


def rows(spark, folder):
    return V.pairs(spark, folder).select(*COLUMNS)


@query("S1_json_lines_scan", ROWS_SQL)
def json_scan(spark, folder):
    source, path = rows(spark, folder), fresh_path(spark, "json-scan")
    source.write.json(path)
    return S.read_json_lines(spark, path, source.schema)


@query("S2_json_lines_sink", ROWS_SQL)
def json_sink(spark, folder):
    source, path = rows(spark, folder), fresh_path(spark, "json-sink")
    S.write_json_lines(source, path, ["split", "pair_id"])
    return S.read_json_lines(spark, path, source.schema)


@query("S3_csv_sink", f"WITH {V.PAIRS} SELECT split, kind, gap_bin, count(*) AS pairs, round(avg(gap), 9) AS mean_gap FROM pairs GROUP BY ALL")
def csv_sink(spark, folder):
    table = V.pairs(spark, folder).groupBy("split", "kind", "gap_bin").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("gap"), 9).alias("mean_gap"))
    path = fresh_path(spark, "csv")
    S.write_csv(table, path, ["split", "kind", "gap_bin", "pairs", "mean_gap"])
    return spark.read.schema("split string, kind string, gap_bin string, pairs bigint, mean_gap double").option("header", True).option("mode", "FAILFAST").csv(path)


@query("S4_columnar_store", f"WITH {V.PAIRS} SELECT pair_id, split, ratio, gap FROM pairs WHERE split = 'dev'")
def columnar_store(spark, folder):
    path = fresh_path(spark, "features")
    S.write_table(V.pairs(spark, folder).select("pair_id", "split", "ratio", "gap"), path)
    # The filter prunes to one partition folder.
    return spark.read.parquet(path).where("split = 'dev'")


@query("S5_shard_report", "SELECT 5 AS present, 6 AS total, 1 AS totals, false AS complete, count(*) AS rows FROM events")
def shard_report(spark, folder):
    """Six shards promised: the fifth has no rows, the sixth was never written."""
    events = V.table(spark, folder, "events").select("event_id", "user_id")
    path = fresh_path(spark, "shards")
    for index in range(5):
        part = events.where(F.pmod("user_id", F.lit(4)) == index)
        part.write.parquet(f"{path}/part-{index:05d}-of-00006")
    rows = spark.read.schema(events.schema).option("recursiveFileLookup", True).parquet(path)
    return S.shard_report(spark, path).withColumn("rows", rows.agg(F.count(F.lit(1))).scalar())


@query("S9_no_overwrite", f"WITH {V.OBS} SELECT count(*) AS rows, true AS refused FROM obs")
def no_overwrite(spark, folder):
    from pyspark.errors import AnalysisException

    path = fresh_path(spark, "once")
    table = V.observations(spark, folder).select("observation_id", "split")
    S.write_table(table, path)
    refused = False
    try:
        S.write_table(table, path)
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))
