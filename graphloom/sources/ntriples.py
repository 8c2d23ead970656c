"""Triples as N-Triples lines, read and written by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import TERMS

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]++|\\.)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


def _escaped(text: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _plain(text: Column) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    for code, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def write(triples: DataFrame, path: str) -> None:
    """Write triples by part as N-Triples text."""
    triples.select("part", lines_column(triples)).write.partitionBy("part").text(path)


def lines_column(triples: DataFrame) -> Column:
    """The line of a triple as a column."""
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dt").isNotNull(), F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "bnode", F.col("o"))
    return F.concat(s, F.lit(" <"), "p", F.lit("> "), o.otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)), F.lit(" .")).alias("value")


def parse(text: DataFrame) -> DataFrame:
    """Terms of N-Triples lines in column value; other lines give nothing. Keeps the column part, if any."""
    g = lambda k: F.regexp_extract("value", _LINE, k)
    some = lambda k: F.when(g(k) != "", g(k))
    kind = F.when(g(3) != "", "iri").when(g(4) != "", "bnode").otherwise("lit")
    o = F.when(g(3) != "", g(3)).when(g(4) != "", g(4)).otherwise(_plain(g(5)))
    keep = ["part"] if "part" in text.columns else []
    return text.where(F.col("value").rlike(_LINE)).select(*keep, F.regexp_replace(g(1), r"^<|>$", "").alias("s"), g(2).alias("p"), o.alias("o"), kind.alias("o_kind"), some(6).alias("dt"), some(7).alias("lang"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder that write() left: part and terms."""
    return parse(spark.read.text(path)).select("part", *TERMS)


def union_parts(*parts: DataFrame) -> DataFrame:
    """All parts' triples with set semantics; a triple of several parts keeps the smallest part name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*TERMS).agg(F.min("part").alias("part")).select("part", *TERMS)
