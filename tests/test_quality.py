import hashlib
import base64

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators import quality as Q
from pairloom.session import fresh_path
from pairloom.sources import tables as S


def test_leak_guard_walks_nested_fields(spark):
    df = spark.sql("SELECT 1 AS frame, array(named_struct('gt_position', 1.0)) AS depth, 2 AS Velocity")
    with pytest.raises(ValueError, match="depth.gt_position"):
        Q.forbid_leaks(df)
    assert Q.forbid_leaks(df, allowed=["depth.gt_position", "Velocity"]) is df


def test_all_reasons_are_kept(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (9, 9)], "a int, b int")
    kept, out = Q.split_by_eligibility(df, {"a_low": F.col("a") < 5, "b_low": F.col("b") < 5})
    assert kept.count() == 1 and sorted(r["reasons"] for r in out.collect()) == [["a_low"], ["a_low", "b_low"]]


def test_unknown_ids_fail(spark):
    df, wanted = spark.range(5), spark.range(3, 7)
    with pytest.raises(ValueError):
        Q.keep_known(df, wanted, ["id"])
    assert Q.keep_known(df, spark.range(2), ["id"]).count() == 2


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    a = Q.fingerprint(df, ["id", "s"]).first()
    b = Q.fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "s"]).first()
    assert a == b and Q.fingerprint(df.where("id > 0"), ["id", "s"]).first() != a


def test_split_overlap_and_agreement(spark):
    df = spark.createDataFrame([("v1", "train"), ("v1", "test"), ("v2", "dev")], "v string, split string")
    assert Q.split_overlaps(df, "v").first()[:] == ("test+train", 1)
    left = spark.createDataFrame([(1, None, 2), (2, "x", 3)], "k int, a string, b int")
    right = spark.createDataFrame([(1, None, 2), (2, "y", 3)], "k int, a string, b int")
    assert {r["field"]: r["differing"] for r in Q.agreement(left, right, ["k"], ["a", "b"]).collect()} == {"a": 1, "b": 0}


def test_finite_report(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, float("inf")), (3.0, None)], "a double, b double")
    assert {r["column"]: r["bad"] for r in Q.finite_report(df, ["a", "b"]).collect()} == {"a": 0, "b": 3}


def test_strict_json_and_sinks(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        S.read_json_lines(spark, str(path), "a int").collect()
    df = spark.range(4).withColumnRenamed("id", "a")
    with pytest.raises(ValueError):
        S.write_csv(df, str(tmp_path / "csv"), ["a", "b"])
    S.write_csv(df, str(tmp_path / "csv"), ["a"])
    with pytest.raises(Exception):
        S.write_csv(df, str(tmp_path / "csv"), ["a"])


def test_checksums(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"some bytes")
    row = S.file_checksums(spark, str(tmp_path / "x.bin")).first()
    assert row["sha256"] == hashlib.sha256(b"some bytes").hexdigest()
    assert row["md5_base64"] == base64.b64encode(hashlib.md5(b"some bytes").digest()).decode()


def test_checksum_of_a_large_file_in_constant_memory(tmp_path):
    """Three sparse gigabytes, more than a row can hold, through the function that a task runs."""
    import resource

    path, size = tmp_path / "large file.bin", 3 << 30
    with open(path, "wb") as file:
        file.truncate(size)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = next(S._digests(iter([pd.DataFrame({"path": [f"file:{path}"], "length": [size]})]))).iloc[0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024
    expected, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        expected.update(block)
    assert found["sha256"] == expected.hexdigest() and found["length"] == size


def test_provenance_keeps_files_of_one_name_apart(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for folder, rows in {"one": [5, 3, 9], "two": [4, 8]}.items():
        (tmp_path / folder).mkdir()
        pq.write_table(pa.table({"a": rows}), tmp_path / folder / "same.parquet")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    place = {(r["a"], r["source_file"].split("/")[-2], r["source_index"]) for r in S.with_provenance(df).collect()}
    assert place == {(5, "one", 0), (3, "one", 1), (9, "one", 2), (4, "two", 0), (8, "two", 1)}
    sorted_place = {(r["a"], r["source_index"]) for r in S.with_provenance(df, ["a"]).collect()}
    assert sorted_place == {(3, 0), (5, 1), (9, 2), (4, 0), (8, 1)}


def test_empty_shards_are_present(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i, rows in enumerate(([1, 2], [])):
        pq.write_table(pa.table({"a": pa.array(rows, pa.int64())}), tmp_path / f"data-{i:05d}-of-00003.parquet")
    row = S.shard_report(spark, str(tmp_path)).first()
    assert (row["present"], row["total"], row["complete"]) == (2, 3, False)


def test_shards_must_be_complete(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(3):
        pq.write_table(pa.table({"a": [i]}), tmp_path / f"data-{i:05d}-of-00003.parquet")
    assert S.read_shards(spark, str(tmp_path)).count() == 3
    (tmp_path / "data-00001-of-00003.parquet").unlink()
    with pytest.raises(ValueError):
        S.read_shards(spark, str(tmp_path))
    assert S.read_shards(spark, str(tmp_path), require_complete=False).count() == 2


def test_fresh_paths_differ(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
