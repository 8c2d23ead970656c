"""Queries of ontology views and of proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import ontology as O
from graphloom.operators import views as V
from graphloom.operators.inference import example_ontology, inferred
from graphloom.plans.record_queries import m10
from graphloom.plans.registry import query
from graphloom.sources.tables import TYPE, graph, iri, table

_CLASSES = """('kg:FootballPlayer', 'kg:Athlete'), ('kg:Athlete', 'kg:Person'), ('kg:Person', 'up:Agent'), ('kg:NationalTeamPlayer', 'kg:FootballPlayer'), ('kg:FootballClub', 'kg:Team'),
 ('kg:NationalTeam', 'kg:Team'), ('kg:Team', 'up:Agent'), ('kg:FormerProvince', 'kg:Province'), ('kg:Province', 'kg:Place'), ('kg:Country', 'kg:Place'), ('kg:Stadium', 'kg:Place'),
 ('kg:ClubStation', 'kg:CareerStation'), ('kg:YouthStation', 'kg:CareerStation'), ('kg:NationalTeamStation', 'kg:CareerStation')"""
_DOMAINS = """('kg:Person', 'kg:birthPlace,kg:birthProvince'), ('kg:Athlete', 'kg:careerStation,kg:playedFor'), ('kg:CareerStation', 'kg:startYear,kg:team'), ('kg:Team', 'kg:ground'),
 ('kg:Stadium', 'kg:capacity'), ('kg:Province', 'kg:successor')"""
_MEMBERS = """SELECT 'kg:Country' AS cls, count(*) AS n FROM region UNION ALL SELECT 'kg:Province', count(*) FROM nation UNION ALL SELECT 'kg:FormerProvince', count(*) FROM nation WHERE n_nationkey % 3 = 2
 UNION ALL SELECT 'kg:FootballPlayer', count(*) FROM customer UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier UNION ALL SELECT 'kg:Stadium', count(*) FROM part
 UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'kg:ClubStation' WHEN 'O' THEN 'kg:YouthStation' ELSE 'kg:NationalTeamStation' END, count(*) FROM orders GROUP BY 1"""
_UP = f"""h(sub, sup) AS (VALUES {_CLASSES}), up AS (SELECT sub, sup, 1 AS depth FROM h UNION SELECT up.sub, h.sup, up.depth + 1 FROM up JOIN h ON up.sup = h.sub)"""


def _members(t):
    return t.where(F.col("p") == TYPE).groupBy(F.col("o").alias("cls")).agg(F.count_distinct("s").alias("n"))


@query("h08_class_rows", f"WITH RECURSIVE {_UP}, c AS (SELECT sub AS cls FROM h UNION SELECT sup FROM h), m AS ({_MEMBERS}) SELECT c.cls, CAST(coalesce((SELECT max(depth) FROM up WHERE sub = c.cls), 0) AS INTEGER) AS depth, coalesce(d.props, '') AS properties, CAST(coalesce(m.n, 0) AS BIGINT) AS members FROM c LEFT JOIN (VALUES {_DOMAINS}) d(cls, props) ON d.cls = c.cls LEFT JOIN m ON m.cls = c.cls")
def h08(spark, d):
    return O.class_rows(example_ontology(spark), _members(graph(spark, d)))


@query("c07_flat_class_rows", f"WITH RECURSIVE h(sub, sup) AS (VALUES {_CLASSES}), r(cls, path, depth) AS (SELECT DISTINCT sup, sup, 0 FROM h WHERE sup NOT IN (SELECT sub FROM h) UNION ALL SELECT h.sub, r.path || '/' || h.sub, r.depth + 1 FROM r JOIN h ON h.sup = r.cls), m AS ({_MEMBERS}) SELECT r.cls, r.path, CAST(r.depth AS INTEGER) AS depth, CAST(coalesce(m.n, 0) AS BIGINT) AS members FROM r LEFT JOIN m ON m.cls = r.cls")
def c07(spark, d):
    rows = O.class_paths(example_ontology(spark).sub_class)
    return rows.join(_members(graph(spark, d)), "cls", "left").select("cls", "path", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("members"))


@query("r01_prepared_axioms", f"SELECT * FROM (SELECT 'sub_class' AS kind, sub AS term, sup AS other FROM (VALUES {_CLASSES}) h(sub, sup) WHERE sub IN (SELECT cls FROM ({_MEMBERS}) WHERE n > 0)) UNION ALL SELECT * FROM (VALUES ('sub_property', 'kg:birthProvince', 'kg:birthPlace'), ('sub_property', 'kg:province', 'kg:locatedIn'), ('domain', 'kg:birthProvince', 'kg:Person'), ('domain', 'kg:careerStation', 'kg:Athlete'), ('domain', 'kg:team', 'kg:CareerStation'), ('domain', 'kg:ground', 'kg:Team'), ('domain', 'kg:capacity', 'kg:Stadium'), ('domain', 'kg:successor', 'kg:Province'), ('domain', 'kg:startYear', 'kg:CareerStation'), ('range', 'kg:birthProvince', 'kg:Province'), ('range', 'kg:careerStation', 'kg:CareerStation'), ('range', 'kg:team', 'kg:Team'), ('range', 'kg:ground', 'kg:Stadium'), ('range', 'kg:capacity', 'xsd:integer'), ('range', 'kg:successor', 'kg:Province'), ('range', 'kg:province', 'kg:Province'), ('range', 'kg:locatedIn', 'kg:Place'), ('range', 'kg:startYear', 'xsd:gYear'), ('inverse', 'kg:successor', 'kg:predecessor'), ('all_values', 'kg:ClubStation', 'kg:team kg:FootballClub'), ('all_values', 'kg:NationalTeamStation', 'kg:team kg:NationalTeam'), ('disjoint', 'kg:FootballClub', '2')) v(kind, term, other)")
def r01(spark, d):
    t = graph(spark, d)
    used = t.select(F.col("p").alias("term")).union(t.where(F.col("p") == TYPE).select("o")).distinct()
    return O.prepared(O.axioms(example_ontology(spark))).join(used, "term", "left_semi").select("kind", "term", "other")


@query("u11_display_classes", "SELECT 'kg:province/' || n_nationkey AS entity, CASE WHEN n_nationkey % 3 = 2 THEN 'kg:FormerProvince,kg:Province' ELSE 'kg:Province' END AS classes FROM nation UNION ALL SELECT 'kg:player/' || c_custkey, 'kg:FootballPlayer' FROM customer UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:Stadium' FROM part")
def u11(spark, d):
    order = spark.createDataFrame([("kg:FormerProvince", 0), ("kg:FootballPlayer", 1), ("kg:Stadium", 2), ("kg:Province", 3)], "cls string, place int")
    types = graph(spark, d).where(F.col("p") == TYPE).select("s", F.col("o").alias("cls"))
    return O.display_classes(types, order)


def _proposals(spark, d):
    """A club for each player by its key, by local name; every other property is unknown to the ontology."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("player/"), "c_custkey").alias("s"),
        F.when(F.expr("c_custkey % 2 = 0"), "kg:playedFor").otherwise("kg:admires").alias("p"), F.concat(F.lit("kg:club/"), "c_custkey").alias("o"),
    )


@query("w01_resolved_proposals", "SELECT c_custkey AS id, CASE WHEN k THEN 'kg:player/' || c_custkey END AS s, CASE WHEN k THEN 'kg:playedFor' END AS p, CASE WHEN k THEN 'kg:club/' || c_custkey END AS o, k AS known FROM (SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier) AS k FROM customer)")
def w01(spark, d):
    t = graph(spark, d)
    return O.resolved(_proposals(spark, d), t.where(F.col("p") == TYPE).select(F.col("s").alias("term")), example_ontology(spark).prop, "kg:")


@query("w02_neighbourhoods", "WITH e AS (SELECT c_custkey AS id FROM customer) SELECT id, 'kg:player/' || id AS s, 'kg:careerStation' AS p, 'kg:station/' || o_orderkey AS o FROM e JOIN orders ON o_custkey = id UNION ALL SELECT id, 'kg:station/' || o_orderkey, 'kg:startYear', CAST(year(o_orderdate) AS VARCHAR) FROM e JOIN orders ON o_custkey = id UNION ALL SELECT DISTINCT id, 'kg:station/' || o_orderkey, 'kg:team', 'kg:club/' || l_suppkey FROM e JOIN orders ON o_custkey = id JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT id, 'kg:player/' || id, 'kg:birthProvince', 'kg:province/' || c_nationkey FROM e JOIN customer ON c_custkey = id UNION ALL SELECT id, 'kg:club/' || s_suppkey, 'kg:province', 'kg:province/' || s_nationkey FROM e JOIN supplier ON s_suppkey = id")
def w02(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), iri("player", "c_custkey").alias("s"), iri("club", "c_custkey").alias("o"))
    t = graph(spark, d).where(F.col("p").isin("kg:careerStation", "kg:startYear", "kg:team", "kg:birthProvince", "kg:province"))
    return O.neighbourhood(p, t, "kg:careerStation")


@query("w03_proposal_clashes", "SELECT s_suppkey AS id, 'kg:club/' || s_suppkey AS s, 'kg:Person' AS a, 'kg:Team' AS b FROM supplier WHERE s_suppkey % 2 = 1")
def w03(spark, d):
    odd = F.expr("s_suppkey % 2 = 1")
    given = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), iri("club", "s_suppkey").alias("s"), F.when(odd, "kg:careerStation").otherwise("kg:ground").alias("p"),
        F.when(odd, iri("station", "s_suppkey")).otherwise(iri("stadium", "s_suppkey")).alias("o"),
    )
    types = graph(spark, d).where((F.col("p") == TYPE) & ~F.col("o").endswith("Station"))
    around = O.neighbourhood(given, types, "kg:careerStation")
    return O.clashes(given.unionByName(around).withColumn("o_kind", F.lit("iri")), example_ontology(spark))


_PLAYED = "(SELECT count(DISTINCT (o_custkey, l_suppkey)) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(
    "h09_axiom_counts",
    f"""SELECT 'chain' AS kind, 'kg:playedFor' AS term, 'kg:careerStation kg:team' AS other, {_PLAYED} AS n UNION ALL SELECT 'inverse', 'kg:playedFor', 'kg:hasPlayer', {_PLAYED}
    UNION ALL SELECT 'inverse', 'kg:hasPlayer', 'kg:playedFor', {_PLAYED} UNION ALL SELECT 'inverse', 'kg:successor', 'kg:predecessor', count(*) FROM nation WHERE n_nationkey % 3 = 2
    UNION ALL SELECT 'inverse', 'kg:predecessor', 'kg:successor', 0 UNION ALL SELECT 'some_values', 'kg:NationalTeamPlayer', 'kg:careerStation kg:NationalTeamStation', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'all_values', 'kg:ClubStation', 'kg:team kg:FootballClub', count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'all_values', 'kg:NationalTeamStation', 'kg:team kg:NationalTeam', count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""",
)
def h09(spark, d):
    o = example_ontology(spark)
    facts = graph(spark, d).where(F.col("p").isin(TYPE, "kg:careerStation", "kg:team", "kg:successor"))
    return O.axiom_counts(O.axioms(o), inferred(facts, o))


@query(
    "g23_described_terms",
    """WITH u AS (SELECT 'kg:careerStation' AS about, count(*) AS n FROM orders UNION ALL SELECT 'kg:team', count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem UNION ALL SELECT 'kg:successor', count(*) FROM nation WHERE n_nationkey % 3 = 2
    UNION ALL SELECT 'kg:NationalTeamStation', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'kg:ClubStation', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier)
    SELECT v.about, v.kind, v.term, v.other, u.n FROM (VALUES ('kg:careerStation', 'chain', 'kg:playedFor', 'kg:careerStation kg:team'), ('kg:team', 'chain', 'kg:playedFor', 'kg:careerStation kg:team'), ('kg:successor', 'inverse', 'kg:successor', 'kg:predecessor'),
    ('kg:careerStation', 'some_values', 'kg:NationalTeamPlayer', 'kg:careerStation kg:NationalTeamStation'), ('kg:NationalTeamStation', 'some_values', 'kg:NationalTeamPlayer', 'kg:careerStation kg:NationalTeamStation'),
    ('kg:ClubStation', 'all_values', 'kg:ClubStation', 'kg:team kg:FootballClub'), ('kg:team', 'all_values', 'kg:ClubStation', 'kg:team kg:FootballClub'), ('kg:FootballClub', 'all_values', 'kg:ClubStation', 'kg:team kg:FootballClub'),
    ('kg:NationalTeamStation', 'all_values', 'kg:NationalTeamStation', 'kg:team kg:NationalTeam'), ('kg:team', 'all_values', 'kg:NationalTeamStation', 'kg:team kg:NationalTeam')) v(about, kind, term, other) JOIN u ON u.about = v.about""",
)
def g23(spark, d):
    used = graph(spark, d).groupBy(F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.col("p")).alias("term")).agg(F.count("*").alias("n"))
    axioms = O.axioms(example_ontology(spark)).where(F.col("kind").isin("chain", "inverse", "some_values", "all_values"))
    return O.described(axioms, used).join(used.withColumnRenamed("term", "about"), "about").select("about", "kind", "term", "other", "n")


_PAGE = "'https://wiki.example/' || upper(p_name[1]) || replace(p_name[2:], ' ', '_')"


@query("b07_linked_data_cards", f"SELECT 'kg:part/' || p_partkey AS entity, 'ext:Q' || p_partkey AS outer_ids, '' AS own_ids, {_PAGE} AS page, CASE WHEN p_size > 10 THEN {_PAGE} || '?oldid=' || p_size END AS derived, CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) END AS revision, CAST(p_partkey % 90 AS DOUBLE) AS lat, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS lon FROM part")
def b07(spark, d):
    part, s = table(spark, d, "part"), F.concat(F.lit("kg:part/"), "p_partkey")
    at = lambda p, v: part.select(s.alias("s"), p.alias("p"), v.cast("string").alias("o"))
    even = F.expr("p_partkey % 2 = 0")
    t = m10(spark, d).select("s", "p", "o").where(F.col("p") != "kg:topic")
    t = t.unionByName(at(F.when(even, "kg:lat").otherwise("geo:lat"), F.expr("p_partkey % 90"))).unionByName(at(F.lit("geo:long"), F.col("p_size")).where("s is not null").where(F.expr("cast(substring_index(s, '/', -1) as int) % 2 = 0")))
    return V.cards(t, {"outer_ids": "ext:", "own_ids": "kg:"}, "kg:page", "kg:derivedFrom", ("kg:lat", "geo:lat"), ("kg:long", "geo:long"))


_NEAR = "SELECT 'kg:club/' || s_suppkey AS s, 'kg:province/' || s_nationkey AS o FROM supplier UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:province/' || (p_partkey % 25) FROM part"


def _places(t):
    """Inferred: what has a province lies in it."""
    return t.where("p = 'kg:province'").withColumn("p", F.lit("kg:locatedIn")).withColumn("part", F.lit("inferred"))


@query("b12_asserted_neighbours", f"WITH e AS ({_NEAR}) SELECT s AS node, 'out' AS side, o AS other, 'kg:province' AS props FROM e UNION ALL SELECT o, 'in', s, 'kg:province' FROM e")
def b12(spark, d):
    t = graph(spark, d).where("p = 'kg:province'")
    return V.asserted_neighbours(t.unionByName(_places(t)))


@query(
    "b13_relation_groups",
    """SELECT 'kg:club/' || s_suppkey AS node, 1 AS place, 'kg:province' AS p, 'out' AS side, 'kg:province/' || s_nationkey AS other FROM supplier
    UNION ALL SELECT 'kg:club/' || s_suppkey, 2, 'kg:locatedIn', 'out', 'kg:country/0' FROM supplier UNION ALL SELECT 'kg:club/' || l_suppkey, 0, 'kg:ground', 'out', 'kg:stadium/' || min(l_partkey) FROM lineitem GROUP BY l_suppkey
    UNION ALL SELECT DISTINCT 'kg:club/' || l_suppkey, 4, 'kg:team', 'in', 'kg:station/' || l_orderkey FROM lineitem
    UNION ALL SELECT 'kg:club/' || c_custkey, 3, 'kg:playedFor', 'in', 'kg:player/' || c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)""",
)
def b13(spark, d):
    t = graph(spark, d).where(F.col("p").isin("kg:province", "kg:ground", "kg:team"))
    clubs = table(spark, d, "supplier").select(iri("club", "s_suppkey").alias("node"))
    doubled = _places(t).withColumn("part", F.lit("asserted"))
    far = clubs.select("node").withColumns({"p": F.lit("kg:locatedIn"), "o": F.lit("kg:country/0"), "o_kind": F.lit("iri"), "part": F.lit("asserted")}).withColumnRenamed("node", "s")
    played = table(spark, d, "customer").select(F.lit("inferred").alias("part"), iri("player", "c_custkey").alias("s"), F.lit("kg:playedFor").alias("p"), iri("club", "c_custkey").alias("o"), F.lit("iri").alias("o_kind"))
    cols = ["part", "s", "p", "o", "o_kind"]
    every = t.select(cols).unionByName(doubled.select(cols)).unionByName(far.select(cols)).unionByName(played)
    return V.relation_groups(every, clubs, ["kg:ground", "kg:province", "kg:locatedIn"], ["kg:playedFor", "kg:team"], ("kg:playedFor",))
