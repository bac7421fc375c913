"""From raw documents to a training mix: five stages, each written before the next reads it.

All but the last return the columns of their input, whatever else these hold and however
they are named. A null text counts as empty: no stage rejects it for being null, but of
several empty texts one stays as a near duplicate. Rows without an id are kept by the
stages that go by ids. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from pairloom.llm.common import unused
from pairloom.session import stage


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text; ``n_chars``, where there is one, follows it."""
    kinds = dict(docs.dtypes)
    changed = docs.withColumn("text", text.cast(kinds["text"]))
    return changed.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else changed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier, trained on the labelled ones, rejects."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents that lose all their lines go."""
    added = [unused(docs, name) for name in line_dedup.ADDED]
    kept, _, dropped = (F.col(name) for name in added)
    rows = line_dedup.keep_lines(docs, line_dedup.create(docs), added).where((dropped == 0) | (F.trim(kept) != ""))
    return _with_text(rows, F.when(dropped > 0, kept).otherwise(F.col("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, a similarity of
    0.8 or more, verified) stays, that of the smallest id. SimHash fingerprints link first,
    an exact index what is further apart."""
    return near_copies.keep_one_per_class(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document that is nothing else goes."""
    before = unused(docs, "_text_before")
    cut = decontaminate.remove_passages(docs.withColumn(before, F.col("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    left = cut.where(F.col("text").eqNullSafe(F.col(before)) | F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).drop(before)
    return _with_text(left, F.col("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence of documents in which the sources have their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("source_mixing", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
