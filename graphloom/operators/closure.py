"""Hierarchies and transitive closures by semi-naive joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def held(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the folder that driver and executors share, and read it back, to cut its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most `size` for what is run inside: a worker holds several copies of a batch outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """sub, sup, depth of every pair that edges (sub, sup) connect; depth is the shortest way, cycles end.

    Each round joins the pairs found in the last one to the edges and keeps the new ones.
    """
    edges = edges.select("sub", "sup").distinct()
    known = held(edges.where("sub <> sup").withColumn("depth", F.lit(1)), "closure")
    delta, depth = known, 1
    while not delta.isEmpty():
        depth += 1
        step = delta.select("sub", F.col("sup").alias("via")).join(edges.select(F.col("sub").alias("via"), "sup"), "via")
        new = step.where("sub <> sup").select("sub", "sup").distinct().join(known, ["sub", "sup"], "left_anti").withColumn("depth", F.lit(depth))
        delta = held(new, "delta")
        known = known.unionByName(delta)
    if reflexive:
        nodes = edges.select(F.col("sub").alias("n")).union(edges.select("sup")).distinct()
        known = known.unionByName(nodes.select(F.col("n").alias("sub"), F.col("n").alias("sup"), F.lit(0).alias("depth")))
    return known


def descendants(edges: DataFrame) -> DataFrame:
    """cls, descendant of every class."""
    return closure(edges).select(F.col("sup").alias("cls"), F.col("sub").alias("descendant"))


def primary_parent(edges: DataFrame, own: str) -> DataFrame:
    """cls, parent (one in the own namespace first, then by name), others (the rest, sorted)."""
    rank = F.struct((~F.col("sup").startswith(own)).alias("foreign"), "sup")
    per = edges.groupBy(F.col("sub").alias("cls")).agg(F.array_sort(F.collect_set(rank)).alias("r"))
    return per.select("cls", F.col("r")[0]["sup"].alias("parent"), F.array_join(F.array_sort(F.transform(F.slice("r", 2, F.size("r")), lambda x: x["sup"])), ",").alias("others"))
