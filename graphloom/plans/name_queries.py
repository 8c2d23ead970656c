"""Queries that look up names in the written gram index: classes filtered by a text, and cells of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import grams as N
from graphloom.operators.inference import example_ontology
from graphloom.operators.views import name_index
from graphloom.plans.registry import query
from graphloom.sources.tables import TYPE, graph, iri, table

_MAIN = ["kg:Stadium", "kg:FootballClub", "kg:FootballPlayer"]
_NAMES = """n AS (SELECT DISTINCT 'kg:stadium/' || p_partkey AS entity, p_name AS name, 'kg:Stadium' AS cls FROM part UNION ALL SELECT 'kg:club/' || s_suppkey, s_name, 'kg:FootballClub' FROM supplier
UNION ALL SELECT 'kg:player/' || c_custkey, c_name, 'kg:FootballPlayer' FROM customer)"""


@query(
    "c06_classes_filtered_by_name",
    f"""WITH {_NAMES}, q AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS q FROM part UNION SELECT right(s_name, 2) FROM supplier UNION SELECT left(c_name, 1 + c_custkey % 2) FROM customer),
h AS (SELECT lower(q) AS q, cls, entity, name FROM n JOIN q ON contains(lower(name), lower(q))),
s AS (SELECT *, count(*) OVER (PARTITION BY q, cls) AS total, row_number() OVER (PARTITION BY q, cls ORDER BY name, entity) AS place FROM h),
u(cls, sup) AS (VALUES ('kg:Stadium', 'kg:Place'), ('kg:FootballClub', 'kg:Team'), ('kg:FootballClub', 'up:Agent'), ('kg:FootballPlayer', 'kg:Athlete'), ('kg:FootballPlayer', 'kg:Person'), ('kg:FootballPlayer', 'up:Agent'))
SELECT q, cls, total, place, entity, name FROM s WHERE place <= 100 UNION ALL SELECT DISTINCT q, sup, 0, NULL::BIGINT, NULL, NULL FROM h JOIN u USING (cls)""",
)
def c06(spark, d):
    g = graph(spark, d)
    members = g.where((F.col("p") == TYPE) & F.col("o").isin(_MAIN)).select(F.col("s").alias("entity"), F.col("o").alias("cls"))
    second, last, first = F.split_part("p_name", F.lit(" "), F.lit(2)), F.right("s_name", F.lit(2)), F.expr("left(c_name, 1 + c_custkey % 2)")
    texts = table(spark, d, "part").select(second.alias("text")).union(table(spark, d, "supplier").select(last)).union(table(spark, d, "customer").select(first)).distinct()
    return N.filtered_classes(N.gram_index(name_index(g, _MAIN)), members, example_ontology(spark).sub_class, texts)


@query(
    "l07_cells_of_every_kind",
    f"""WITH {_NAMES}, f AS (SELECT lower(name) AS folded, min(entity) AS one FROM n GROUP BY 1 HAVING count(DISTINCT entity) = 1),
c AS (SELECT 'kg:player/' || (o_orderkey % 4000) AS cell FROM orders UNION SELECT 'https://site.example/' || o_orderpriority FROM orders UNION SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END FROM customer
UNION SELECT p_name FROM part UNION SELECT repeat(s_name, 1 + s_suppkey % 3) FROM supplier),
r AS (SELECT cell, one, CASE WHEN starts_with(cell, 'kg:') THEN CASE WHEN cell IN (SELECT entity FROM n) THEN 'own' END WHEN starts_with(cell, 'http') THEN CASE WHEN NOT contains(cell, ' ') THEN 'web' END WHEN one IS NOT NULL AND length(cell) <= 120 THEN 'name' END AS how
FROM c LEFT JOIN f ON folded = lower(cell))
SELECT cell, CASE how WHEN 'name' THEN one WHEN 'own' THEN cell WHEN 'web' THEN cell END AS node, how FROM r""",
)
def l07(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    cells = orders.select(iri("player", F.expr("o_orderkey % 4000")).alias("cell")).union(orders.select(F.concat(F.lit("https://site.example/"), "o_orderpriority")))
    cells = cells.union(customer.select(F.when(F.expr("c_custkey % 2 = 0"), F.col("c_name")).otherwise(F.upper("c_name")))).union(table(spark, d, "part").select("p_name"))
    cells = cells.union(table(spark, d, "supplier").select(F.expr("repeat(s_name, cast(1 + s_suppkey % 3 as int))")))
    g = graph(spark, d)
    members = g.where((F.col("p") == TYPE) & F.col("o").isin(_MAIN)).select(F.col("s").alias("entity"))
    return N.cells_to_entities(cells, name_index(g, _MAIN), members, "kg:", 120)
