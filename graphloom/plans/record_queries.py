"""Queries that turn records into triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import records as M
from graphloom.plans.registry import query
from graphloom.sources.tables import iri, table

_SITE = "https://wiki.example/"


@query("m06_link_iris", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'kg:Club_' || l_suppkey ELSE 'kg:Old_' || l_suppkey END AS iri FROM lineitem")
def m06(spark, d):
    raw = F.concat(F.lit("old_"), "l_suppkey")
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
    even = F.expr("s_suppkey % 2 = 0")
    targets = table(spark, d, "supplier").where(F.expr("s_suppkey % 2 = 0 or s_suppkey % 5 = 0")).select(
        F.concat(F.lit("old_"), "s_suppkey").alias("raw"), F.when(even, F.concat(F.lit("club "), "s_suppkey")).alias("title"), F.expr("s_suppkey % 5 = 0").alias("disambiguation")
    )
    return M.link_iris(links, targets, "kg:").drop("raw")


_E = "'kg:part/' || p_partkey"


@query(
    "m10_core_triples",
    f"""SELECT {_E} AS s, 'rdf:type' AS p, 'kg:Stadium' AS o, 'iri' AS o_kind, NULL AS dt, NULL AS lang FROM part
    UNION ALL SELECT {_E}, 'rdfs:label', p_name, 'lit', NULL, 'vi' FROM part
    UNION ALL SELECT {_E}, 'rdfs:label', p_brand, 'lit', NULL, 'en' FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT {_E}, 'owl:sameAs', 'ext:Q' || p_partkey, 'iri', NULL, NULL FROM part
    UNION ALL SELECT {_E}, 'kg:abstract', p_type || '. More.', 'lit', NULL, 'vi' FROM part
    UNION ALL SELECT {_E}, 'rdfs:comment', p_type || '. More.', 'lit', NULL, 'vi' FROM part
    UNION ALL SELECT {_E}, 'kg:pageId', CAST(p_partkey AS VARCHAR), 'lit', 'xsd:integer', NULL FROM part
    UNION ALL SELECT {_E}, 'kg:revisionId', CAST(p_size AS VARCHAR), 'lit', 'xsd:integer', NULL FROM part WHERE p_size > 10
    UNION ALL SELECT {_E}, 'kg:pageLength', CAST(length(p_name) AS VARCHAR), 'lit', 'xsd:integer', NULL FROM part
    UNION ALL SELECT {_E}, 'kg:page', '{_SITE}' || upper(p_name[1]) || replace(p_name[2:], ' ', '_'), 'iri', NULL, NULL FROM part
    UNION ALL SELECT {_E}, 'kg:derivedFrom', '{_SITE}' || upper(p_name[1]) || replace(p_name[2:], ' ', '_') || '?oldid=' || p_size, 'iri', NULL, NULL FROM part WHERE p_size > 10
    UNION ALL SELECT {_E}, 'kg:image', 'https://img.example/' || p_partkey, 'iri', NULL, NULL FROM part WHERE p_partkey % 3 > 0
    UNION ALL SELECT '{_SITE}' || upper(p_name[1]) || replace(p_name[2:], ' ', '_'), 'kg:topic', {_E}, 'iri', NULL, NULL FROM part""",
)
def m10(spark, d):
    records = table(spark, d, "part").select(
        iri("part", "p_partkey").alias("entity"), F.lit("kg:Stadium").alias("cls"), F.col("p_name").alias("title"), F.when(F.expr("p_size % 2 = 0"), F.col("p_brand")).alias("en_title"),
        F.concat(F.lit("ext:Q"), "p_partkey").alias("qid_iri"), F.concat("p_type", F.lit(". More.")).alias("abstract"), F.col("p_partkey").alias("pageid"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("revid"), F.length("p_name").alias("length"),
        F.concat(F.when(F.expr("p_partkey % 3 = 0"), "no address ").otherwise("https://img.example/"), "p_partkey").alias("image"),
    )
    return M.core(records, _SITE, "vi", "en")


@query(
    "m14_coordinates",
    """WITH c AS (SELECT 'kg:player/' || c_custkey AS s, CAST(c_custkey % 90 AS DOUBLE) AS lat, CASE WHEN c_custkey % 3 = 0 THEN -(c_custkey % 180) / 2.0 ELSE CAST(c_custkey % 180 AS DOUBLE) END AS lon FROM customer WHERE c_custkey % 3 < 2)
    SELECT s, 'geo:lat' AS p, CAST(lat AS VARCHAR) AS o, 'lit' AS o_kind, 'xsd:double' AS dt, NULL AS lang FROM c UNION ALL SELECT s, 'geo:long', replace(CAST(lon AS VARCHAR), '-0.0', '0.0'), 'lit', 'xsd:double', NULL FROM c
    UNION ALL SELECT s, 'geo:point', CAST(lat AS VARCHAR) || ' ' || replace(CAST(lon AS VARCHAR), '-0.0', '0.0'), 'lit', NULL, NULL FROM c""",
)
def m14(spark, d):
    k = F.expr("c_custkey % 3")
    point = F.when(k == 0, F.concat(F.lit("Point("), F.expr("0D - (c_custkey % 180) / 2D"), F.lit(" "), F.expr("c_custkey % 90"), F.lit(")"))).otherwise("nowhere")
    records = table(spark, d, "customer").select(iri("player", "c_custkey").alias("entity"), point.alias("point"), F.when(k != 2, F.expr("c_custkey % 90")).alias("lat"), F.expr("c_custkey % 180").alias("lon"))
    return M.coordinates(records)
