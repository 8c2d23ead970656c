"""Helpers shared by the text operators: shared-folder tables, sized joins, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of fixed width up to which the smaller side of a join is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    path = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, sizes are exact and a lost executor loses nothing. The shuffles of the write are deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver happens to collect its garbage: what one table took is not on disk any more while the next one is made."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def release(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more (what was made of them is written itself)."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most `size` for what runs inside, so that large rows take little memory outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, held)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among those of gone (one written column; null counts as an id)."""
    name = fresh(docs, "_gone")
    return sized_join(docs, gone.toDF(name), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written right side of fixed-width rows: broadcast if its counted rows are few, else sort-merge."""
    few = right.count() <= rows
    return left.join(right.hint("broadcast" if few else "merge"), on, how)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 1-based rank over all rows without sorting them in one task.

    Rows are range-partitioned and sorted, and written with their partition's number; ranks are the row
    numbers inside a partition plus the counts of the partitions before (one row per partition).
    """
    part = written(
        df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
        .withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    before = (
        part.groupBy("_part")
        .count()
        .select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    )
    return (
        part.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
        .join(before.hint("broadcast"), "_part")
        .withColumn(name, F.col("_row") + F.col("_before"))
        .drop("_part", "_row", "_before")
    )


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts as empty."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(one == "", 0).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) per node, component the smallest id.

    Alternates the large-star and small-star rewirings until no edge changes; each round is two
    aggregations with partial combining and joins that adaptive execution may split, so a hub with
    very many neighbours never meets in one task. Rounds are written to the shared folder.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        rows, starts = now.agg(F.count("*"), F.count_distinct("a")).first()
        how = "broadcast" if 2 * rows <= BROADCAST_ROWS // 2 else "merge"  # fixed-width rows, counted
        if rows == starts and now.join(now.select(F.col("b").alias("a")).distinct().hint(how), "a", "left_semi").isEmpty():
            break  # every node points at the smallest of its component, and at nothing else
        around = both(now)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least.hint(how), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        before, large = now, written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint(how), "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        now = written(small.select("e.*").where("a <> b").distinct(), "edges")
        release(before, large)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
