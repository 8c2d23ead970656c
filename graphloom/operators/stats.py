"""Data-set statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.inference import TYPE


def class_counts(triples: DataFrame) -> DataFrame:
    """cls, n: distinct members per class."""
    return triples.where(F.col("p") == TYPE).groupBy(F.col("o").alias("cls")).agg(F.count_distinct("s").alias("n"))


def link_counts(triples: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """One row: same-as links per target namespace (column -> prefix)."""
    return triples.where(F.col("p") == "owl:sameAs").agg(*[F.count_if(F.col("o").startswith(ns)).alias(c) for c, ns in namespaces.items()])


def languages(literals: DataFrame) -> DataFrame:
    """One row: the languages of the literals, joined."""
    return literals.where("lang is not null").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


def description(name: str, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Description triples: class partitions (cls, n) and linksets (target, n)."""
    row = lambda df, p, key: df.select(F.lit(name).alias("s"), F.lit(p).alias("p"), F.concat_ws(" ", key, F.col("n").cast("string")).alias("o"))
    return row(classes, "void:classPartition", "cls").unionByName(row(links, "void:linkset", "target"))


def schema_profile(triples: DataFrame, classes: list[str], preferred: str = "en") -> DataFrame:
    """cls, p, n, example: predicates of each class's members, with the smallest value, of the preferred language if any."""
    members = triples.where((F.col("p") == TYPE) & F.col("o").isin(classes)).select("s", F.col("o").alias("cls")).distinct()
    facts = triples.where(F.col("p") != TYPE).join(members, "s")
    best = F.min(F.struct(F.coalesce(F.col("lang") != preferred, F.lit(True)).alias("r"), "o"))
    return facts.groupBy("cls", "p").agg(F.count("*").alias("n"), best.alias("b")).select("cls", "p", "n", F.col("b.o").alias("example"))
