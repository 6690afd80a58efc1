"""What the operators of this subpackage share: folders, written tables, held-out rule."""

from __future__ import annotations

import math
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The whitespace and word classes that several operators name.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a session on one machine (tests) gets a
    temporary folder as its checkpoint folder, and one on a cluster an error.
    """
    root = spark.sparkContext.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        base = conf
    elif root:
        base = root
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return path


def written(df: DataFrame, path: str, name: str, by: str | None = None) -> DataFrame:
    """The rows of df, written once as Parquet under path (a folder for each value of `by`) and read again: later plans start there."""
    target = f"{path}/{name}"
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's, part of the plan itself; schema names int, long, double and boolean columns."""
    names, kinds = zip(*(x.strip().split(" ") for x in schema.split(",")), strict=True)
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, arrow[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names)))


#: A key with more than this share of the rows is joined by broadcast; so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1024


def join_split(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are distinct and whose column `n` says how many rows of left have the key.

    Keys of more than total / HOT_KEYS rows, fewer than HOT_KEYS by that, go to
    the tasks by broadcast, so that no task gathers a hot key's rows; the others are
    shuffled. `how` is inner or left; keys of `on` are never null.
    """
    bound = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(n) > bound))
    cold = right.where(F.col(n) <= bound)
    few = left.join(F.broadcast(hot.select(on)), on, "left_anti")
    return left.join(hot, on).unionByName(few.join(cold, on, how))


def ranks(values: DataFrame, path: str, name: str) -> tuple[DataFrame, int]:
    """(value, rank from 0 by value, null first) of the distinct values of a one-column table, and their number.

    Sorted by ranges; only a count for each range is put in order in one task.
    """
    sorted_ = values.toDF("value").distinct().sort(F.col("value").asc_nulls_first())
    sorted_ = written(sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), path, name)
    per = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = per.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sorted_.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("at")).alias("rank")), sorted_.count()


def local_path(uri: str):
    """(filesystem, path) of pyarrow for a Hadoop-style URI, for tasks that write or read whole files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def finite_vectors(vectors: DataFrame, keep: list[str], vector_col: str) -> DataFrame:
    """The columns `keep` as k0, k1, ... and `v` as doubles, of rows whose vector isn't null or empty and holds finite components only."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)))


def tree_merge(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Any], both: Callable[[Any, Any], Any]) -> Any:
    """What f makes of each task's Arrow batches (None: nothing), merged by both(a, b); None where there is nothing.

    Four tasks' values are merged in one, and so on, so that the driver gets four at most. Each
    level is a stage of its own, with one Python worker a task.
    """

    def merge(values: Iterator[Any]) -> Any:
        out = None
        for v in values:
            out = v if out is None else both(out, v)
        return out

    def values(batches: Iterator[pa.RecordBatch]) -> Any:
        return merge(pickle.loads(v) for batch in batches for v in batch.column("made").to_pylist())

    def packed(g: Callable[[Iterator[pa.RecordBatch]], Any]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = g(batches)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["made"])

        return run

    made = df.mapInArrow(packed(f), "made binary")
    tasks = made.rdd.getNumPartitions()
    while tasks > 4:
        tasks = -(-tasks // 4)
        made = made.repartition(tasks).mapInArrow(packed(values), "made binary")
    return merge(pickle.loads(r["made"]) for r in made.collect())


def tree_sum(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of the arrays that f makes of each task's Arrow batches, None standing for nothing.

    Merged by treeAggregate, about four arrays in a task, so that the driver gets five at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = f(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["made"])

    def both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return b if a is None else a if b is None else a + b

    made = df.mapInArrow(run, "made binary").rdd
    depth = max(2, math.ceil(math.log(max(2, made.getNumPartitions()), 4)))
    return made.treeAggregate(None, lambda a, r: both(a, pickle.loads(r["made"])), both, depth)
