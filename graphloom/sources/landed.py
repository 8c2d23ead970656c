"""Landed responses and record files: newest value, to-do lists, merged pages, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.chains import final_successor


def newest(responses: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row of each key."""
    return responses.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def missing(requested: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Requested keys that have not landed."""
    return requested.join(landed.select(key), key, "left_anti")


def merge_pages(pages: DataFrame, key: str, number: str, lists: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One record per key from its pages: lists concatenated, the first or the last value that is there."""
    at = F.col(number)
    parts = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(c)))), lambda x: x[c])).alias(c) for c in lists]
    parts += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in first]
    parts += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    return pages.groupBy(key).agg(*parts)


def resolve_aliases(requested: DataFrame, aliases: DataFrame, steps: int = 2) -> DataFrame:
    """title, target: following alias rows (source, target) up to `steps` times."""
    out = requested.withColumn("target", F.col("title"))
    for _ in range(steps):
        out = out.join(aliases.select(F.col("source").alias("target"), F.col("target").alias("_next")), "target", "left").select("title", F.coalesce("_next", "target").alias("target"))
    return out


def resolve_chains(requested: DataFrame, aliases: DataFrame, records: DataFrame) -> DataFrame:
    """title, target and the columns of records (target, ...): alias rows (source, target) followed to the end of the chain; no record gives nulls.

    Of several targets of a source the smallest counts; aliases in a circle end at the first title met twice.
    """
    last = final_successor(aliases.select(F.col("source").alias("node"), F.col("target").alias("successor"))).select(F.col("node").alias("title"), "final")
    found = requested.select("title").distinct().join(last.hint("merge"), "title", "left").select("title", F.coalesce("final", "title").alias("target"))
    return found.join(records.hint("merge"), "target", "left").select("title", *records.columns)


def json_rows(texts: DataFrame, column: str, value: str, key: str = "key") -> DataFrame:
    """One row per entry of a JSON object: the other columns, key, value of the given type."""
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.explode(F.from_json(column, f"map<string,{value}>")).alias(key, "value"))
