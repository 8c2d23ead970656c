"""Queries that follow chains of successors: units and their groups, aliases, orders of a customer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.chains import final_successor
from graphloom.operators.units import unit_lists, unit_table
from graphloom.plans.registry import ORACLES, QUERIES, query
from graphloom.plans.view_queries import _SUCC
from graphloom.sources import landed
from graphloom.sources.tables import graph, iri, table

_KINDS = ["player", "club", "stadium"]
_MEMBERS = f"{_SUCC}, m AS ({ORACLES['a05_members_by_route']}), g AS (SELECT 'kg:province/' || b AS final, kind, member FROM m JOIN f ON unit = 'kg:province/' || a)"


def _units(spark, d):
    """units, members and successions of the graph; every second former unit has a year of dissolution."""
    t = graph(spark, d)
    year = table(spark, d, "nation").where("n_nationkey % 3 = 2 and n_nationkey % 2 = 0").select(iri("province", "n_nationkey").alias("unit"), (F.col("n_nationkey") + 1990).cast("long").alias("year"))
    units = t.where("p = 'rdf:type' and o in ('kg:Province', 'kg:FormerProvince')").groupBy(F.col("s").alias("unit")).agg(F.bool_or(F.col("o") == "kg:FormerProvince").alias("former")).join(year, "unit", "left")
    succession = t.where("p = 'kg:successor'").select(F.col("s").alias("node"), F.col("o").alias("successor"))
    return units, QUERIES["a05_members_by_route"](spark, d), succession


def _per_kind(rows: str, unit: str, prefix: str) -> str:
    counts = ", ".join(f"count(DISTINCT member) FILTER (kind = '{k}') AS {prefix}{k}" for k in _KINDS)
    return f"SELECT {unit} AS unit, {counts} FROM {rows} GROUP BY 1"


@query(
    "a06_province_table_with_groups",
    f"""{_MEMBERS}, own AS ({_per_kind("m", "unit", "")}), grp AS ({_per_kind("g", "final", "group_")})
SELECT 'kg:province/' || n_nationkey AS unit, n_nationkey % 3 = 2 AS former, CASE WHEN n_nationkey % 6 = 2 THEN n_nationkey + 1990 END AS year, 'kg:province/' || b AS final,
{", ".join(f"coalesce({k}, 0) AS {k}, CASE WHEN n_nationkey % 3 <> 2 THEN coalesce(group_{k}, 0) END AS group_{k}" for k in _KINDS)}
FROM nation JOIN f ON a = n_nationkey LEFT JOIN own ON own.unit = 'kg:province/' || n_nationkey LEFT JOIN grp ON grp.unit = 'kg:province/' || n_nationkey""",
)
def a06(spark, d):
    units, members, succession = _units(spark, d)
    return unit_table(units, members, succession, _KINDS)


@query(
    "a08_member_lists_by_era",
    f"""{_MEMBERS}, e AS (SELECT unit, 'before' AS era, kind, member FROM m UNION SELECT final, 'after', kind, member FROM g),
l AS (SELECT 'kg:player/' || c_custkey AS member, c_name AS label FROM customer UNION ALL SELECT 'kg:club/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'kg:stadium/' || p_partkey, p_name FROM part),
w AS (SELECT 'kg:player/' || o_custkey AS member, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT unit, era, kind, member, count(*) OVER (PARTITION BY unit, era, kind) AS total, row_number() OVER (PARTITION BY unit, era, kind ORDER BY coalesce(n, 0) DESC, label, member) AS place FROM e LEFT JOIN l USING (member) LEFT JOIN w USING (member))
SELECT unit, era, kind, place, member, total FROM k WHERE place <= 12""",
)
def a08(spark, d):
    units, members, succession = _units(spark, d)
    t = graph(spark, d)
    labels = t.where("p = 'rdfs:label'").select(F.col("s").alias("member"), F.col("o").alias("label"))
    stations = t.where("p = 'kg:careerStation'").groupBy(F.col("s").alias("member")).agg(F.count("*").alias("n"))
    return unit_lists(units, members, succession, labels, stations)


@query(
    "a04_final_order_of_every_order",
    """WITH o AS (SELECT *, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nextp,
min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS firstp, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)
SELECT o_orderkey AS node, CASE WHEN nextp IS NOT NULL THEN nextp WHEN o_custkey % 3 = 0 THEN coalesce(firstp, o_orderkey) ELSE last END AS final, o_custkey % 3 = 0 AND firstp IS NULL AS cycle
FROM o WHERE o_orderstatus <> 'P' AND (o_custkey % 3 = 0 OR o_orderkey < last)""",
)
def a04(spark, d):
    """Orders of a customer follow one another, those of every third customer in a circle; a chain stops at a P."""
    o = table(spark, d, "orders")
    per = Window.partitionBy("o_custkey")
    after = F.lead("o_orderkey").over(per.orderBy("o_orderkey"))
    first = F.when(F.expr("o_custkey % 3 = 0"), F.min("o_orderkey").over(per))
    steps = o.select(F.col("o_orderkey").alias("node"), F.coalesce(after, first).alias("successor"))
    return final_successor(steps, o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node")))


@query(
    "s10_alias_chains",
    """SELECT 'Order ' || o_orderkey AS title, 'Order ' || coalesce(max(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) OVER w, min(o_orderkey) OVER w) AS target,
max(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) OVER w AS record FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def s10(spark, d):
    """Every F order is an alias of the customer's order before it; others have a record."""
    title = lambda c: F.concat(F.lit("Order "), F.col(c).cast("string"))
    o = table(spark, d, "orders").withColumn("_before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    alias = o.where("o_orderstatus = 'F' and _before is not null").select(title("o_orderkey").alias("source"), title("_before").alias("target"))
    records = o.where("o_orderstatus <> 'F'").select(title("o_orderkey").alias("target"), F.col("o_orderkey").alias("record"))
    return landed.resolve_chains(o.select(title("o_orderkey").alias("title")), alias, records)
