"""Queries over the example queries, and cases beside queries that find nothing in the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import quality as Q
from graphloom.operators.mentions import linked_mentions
from graphloom.plans import composite_queries, graph_queries, view_queries  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES, query
from graphloom.sources import landed
from graphloom.sources.tables import graph, iri, table


def _named(first: int, last: int) -> list[str]:
    return sorted(n for n in ORACLES if n[0] == "z" and n[1:3].isdigit() and first <= int(n[1:3]) <= last)


def nonempty(spark, d: str, names: list[str]) -> DataFrame:
    """name, found: whether each of the named queries has a row."""
    one = lambda n: QUERIES[n](spark, d).limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(n).alias("name"), "found")
    return reduce(DataFrame.unionByName, map(one, names))


def _sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) > 0 AS found FROM ({ORACLES[n]})" for n in names)


_EXAMPLES, _SHOTS = _named(1, 9), _named(17, 22)


@query("z40_examples_found", _sql(_EXAMPLES))
def z40(spark, d):
    return nonempty(spark, d, _EXAMPLES)


@query("z41_few_shots_found", _sql(_SHOTS))
def z41(spark, d):
    return nonempty(spark, d, _SHOTS)


@query("s08_keys_without_odd_orders", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 1)")
def s08(spark, d):
    return landed.missing(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").where("o_custkey % 2 = 1").select(F.col("o_custkey").alias("key")), "key")


@query("q08_required_capacities", "SELECT 'error' AS severity, 'required' AS \"check\", 'kg:stadium/' || p_partkey AS subject, 'kg:capacity' AS detail FROM part WHERE p_size <= 10")
def q08(spark, d):
    t = graph(spark, d).where("p in ('rdf:type', 'rdfs:label')").select("s", "p", "o")
    sized = table(spark, d, "part").where("p_size > 10").select(iri("stadium", "p_partkey").alias("s"), F.lit("kg:capacity").alias("p"), F.lit("x").alias("o"))
    return Q.required(t.union(sized), {"kg:Stadium": {"rdfs:label": "error", "kg:capacity": "error"}})


@query("u05_linked_numbered_mentions", "SELECT p_partkey AS qid, 3 AS pos, CAST(len(string_split(p_name, ' ')) + 1 AS INTEGER) AS n, lower(p_name) || ' ' || p_partkey AS text FROM part")
def u05(spark, d):
    name = F.concat_ws(" ", "p_name", "p_partkey")
    p = table(spark, d, "part")
    questions = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Where is "), name, F.lit("?")).alias("text"))
    return linked_mentions(questions, p.select(iri("stadium", "p_partkey").alias("entity"), name.alias("name"))).select("qid", "pos", "n", "text")
