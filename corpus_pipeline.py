"""From documents to training shards: five stages, each an operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next one's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, mixing, neardup, quality, shards
from millrace.llm.common import held_out, shared_dir, table, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def with_extras(stage):
    """Further columns of docs pass a stage under names of their own, so that none clashes with the stage's."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        back = {f"extra_{i}": c for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(spark, docs.withColumnsRenamed({c: k for k, c in back.items()}), sf_dir)
        return out.withColumnsRenamed({k: c for k, c in back.items() if c not in out.columns})

    return run_stage


@with_extras
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Features are worked out twice, as texts kept beside them would double the disk."""
    may_teach = quality.with_features(docs.where(~held_out(F.col("doc_id"))), ["doc_id"])
    model = quality.train(may_teach, table(spark, sf_dir, "labels"))
    out = quality.scored(quality.with_features(docs, docs.columns), model)
    return out.where("predicted = 1").select(docs.columns)


@with_extras
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return neardup.one_of_each(docs)


@with_extras
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; lesser passages are cut out of the rest."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), clean_col="clean_text")
    kept = found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words")))
    cut = F.col("n_hit") > 0
    changed = {"text": F.when(cut, F.col("clean_text")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


@with_extras
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy: never, once or twice."""
    out = mixing.mix(docs, keep=docs.columns)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return out.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


@with_extras
def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there."""
    return shards.shard(docs, keep=docs.columns)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shards", to_shards),
]

#: A trained classifier, a forest and a k-d tree aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), path, name)
    return docs
