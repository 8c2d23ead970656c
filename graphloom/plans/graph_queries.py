"""Graph-pattern queries, hierarchies and the composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import closure as H
from graphloom.operators import patterns as G
from graphloom.plans.registry import query
from graphloom.sources.tables import LABEL, TYPE, graph, iri, table


@query("g01_triple_pattern", "SELECT 'kg:player/' || c_custkey AS p FROM customer")
def g01(spark, d):
    return G.pattern(graph(spark, d), "?p", TYPE, "kg:FootballPlayer")


@query(
    "g02_basic_graph_pattern",
    "SELECT DISTINCT 'kg:player/' || o_custkey AS p, 'kg:station/' || o_orderkey AS st, 'kg:club/' || l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def g02(spark, d):
    return G.bgp(graph(spark, d), ("?p", "kg:careerStation", "?st"), ("?st", "kg:team", "?t")).select("p", "st", "t")


@query(
    "g03_star_pattern",
    "SELECT 'kg:station/' || o_orderkey AS st, CASE o_orderstatus WHEN 'F' THEN 'kg:ClubStation' WHEN 'O' THEN 'kg:YouthStation' ELSE 'kg:NationalTeamStation' END AS cls, CAST(year(o_orderdate) AS VARCHAR) AS start FROM orders",
)
def g03(spark, d):
    t = graph(spark, d).where("s like 'kg:station/%'")
    return G.star(t, "st", cls=TYPE, start="kg:startYear")


@query(
    "g04_optional_with_filter",
    "SELECT 'kg:province/' || n_nationkey AS p, CASE WHEN n_nationkey % 3 = 2 AND (n_nationkey // 2) < 5 THEN 'kg:province/' || (n_nationkey // 2) END AS s FROM nation",
)
def g04(spark, d):
    t = graph(spark, d)
    early = G.pattern(t, "?p", "kg:successor", "?s").where(F.element_at(F.split("s", "/"), -1).try_cast("int") < 5)
    return G.optional(G.pattern(t, "?p", TYPE, "kg:Province"), early)


@query(
    "g05_union_of_variables",
    "SELECT 'kg:country/' || r_regionkey AS c, NULL::VARCHAR AS f FROM region UNION ALL SELECT NULL, 'kg:province/' || n_nationkey FROM nation WHERE n_nationkey % 3 = 2",
)
def g05(spark, d):
    t = graph(spark, d)
    return G.union(G.pattern(t, "?c", TYPE, "kg:Country"), G.pattern(t, "?f", TYPE, "kg:FormerProvince"))


@query("g06_filter_language", "SELECT 'kg:province/' || n_nationkey AS s, n_name AS o FROM nation WHERE n_name LIKE '%1%'")
def g06(spark, d):
    t = graph(spark, d).where((F.col("lang") == "en") & F.col("s").startswith("kg:province/"))
    return G.pattern(t, "?s", LABEL, "?o").where(F.contains("o", F.lit("1")))


@query("g07_not_exists_current_units", "SELECT 'kg:province/' || n_nationkey AS p FROM nation WHERE n_nationkey % 3 <> 2")
def g07(spark, d):
    t = graph(spark, d)
    return G.not_exists(G.pattern(t, "?p", TYPE, "kg:Province"), G.pattern(t, "?p", TYPE, "kg:FormerProvince"))


@query(
    "g08_values",
    "SELECT 'kg:Country' AS cls, count(*) AS n FROM region UNION ALL SELECT 'kg:Stadium', count(*) FROM part UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier",
)
def g08(spark, d):
    t = graph(spark, d)
    wanted = G.values(t, "cls", "kg:Country", "kg:Stadium", "kg:FootballClub")
    return G.natural(G.pattern(t, "?x", TYPE, "?cls"), F.broadcast(wanted)).groupBy("cls").agg(F.count("*").alias("n"))


@query(
    "g09_bind_coalesce",
    "SELECT 'kg:province/' || n_nationkey AS p, 'kg:province/' || CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey // 2 ELSE n_nationkey END AS unit FROM nation",
)
def g09(spark, d):
    t = graph(spark, d)
    both = G.optional(G.pattern(t, "?p", TYPE, "kg:Province"), G.pattern(t, "?p", "kg:successor", "?new"))
    return both.select("p", F.coalesce("new", "p").alias("unit"))


@query("g10_bind_inside_optional", "SELECT count(*) AS clubs, count(DISTINCT CASE WHEN s_nationkey % 3 = 2 THEN s_suppkey END) AS linked FROM supplier")
def g10(spark, d):
    t = graph(spark, d)
    old = G.bgp(t, ("?c", "kg:province", "?p"), ("?p", TYPE, "kg:FormerProvince")).select("c", F.col("c").alias("hit"))
    return G.optional(G.pattern(t, "?c", TYPE, "kg:FootballClub"), old).agg(F.count("*").alias("clubs"), F.countDistinct("hit").alias("linked"))


@query(
    "g11_path_alternative",
    "SELECT 'kg:club/' || s_suppkey AS c, 'kg:province/' || s_nationkey AS x FROM supplier UNION SELECT 'kg:province/' || n_nationkey, 'kg:country/' || n_regionkey FROM nation UNION SELECT 'kg:stadium/' || p_partkey, 'kg:province/' || (p_partkey % 25) FROM part",
)
def g11(spark, d):
    return G.pattern(graph(spark, d), "?c", ["kg:province", "kg:locatedIn"], "?x")


@query(
    "g12_path_sequence_and_star",
    "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, r.b // 2 FROM r WHERE r.b % 3 = 2) SELECT 'kg:club/' || s_suppkey AS c, 'kg:province/' || b AS unit FROM supplier JOIN r ON a = s_nationkey",
)
def g12(spark, d):
    t = graph(spark, d)
    edges = G.pattern(t, "?sub", "kg:successor", "?sup")
    nodes = G.pattern(t, "?sub", TYPE, "kg:Province").select("sub", F.col("sub").alias("unit"))
    reach = H.closure(edges).select("sub", F.col("sup").alias("unit")).union(nodes)
    return G.pattern(t, "?c", "kg:province", "?sub").where("c like 'kg:club/%'").join(reach, "sub").select("c", "unit")


@query("g13_distinct_subquery", "SELECT p_name AS name, 'kg:stadium/' || p_partkey AS x FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 1)")
def g13(spark, d):
    t = graph(spark, d)
    stadium = t.where("s like 'kg:stadium/%'")
    names = G.bgp(stadium, ("?y", LABEL, "?name"), ("?y", "kg:capacity", "1")).select("name").distinct()
    return G.natural(names, G.pattern(stadium, "?x", LABEL, "?name")).select("name", "x")


@query("g14_group_counts", "SELECT 'kg:province/' || c_nationkey AS prov, count(*) AS n, count(DISTINCT c_name) AS names FROM customer GROUP BY c_nationkey")
def g14(spark, d):
    t = graph(spark, d)
    both = G.bgp(t, ("?p", "kg:birthProvince", "?prov"), ("?p", LABEL, "?name"))
    return both.groupBy("prov").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("g15_global_aggregates", "SELECT count(*) AS players, count(DISTINCT c_nationkey) AS provinces, min(c_name) AS first_name FROM customer")
def g15(spark, d):
    t = graph(spark, d)
    both = G.bgp(t, ("?p", "kg:birthProvince", "?prov"), ("?p", LABEL, "?name"))
    return both.agg(F.count("*").alias("players"), F.countDistinct("prov").alias("provinces"), F.min("name").alias("first_name"))


@query(
    "g16_group_concat",
    "SELECT 'kg:country/' || n_regionkey AS country, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
def g16(spark, d):
    t = graph(spark, d)
    return G.bgp(t, ("?p", "kg:locatedIn", "?country"), ("?p", LABEL, "?name")).groupBy("country").agg(G.group_concat("name").alias("names"))


@query(
    "g17_order_unbound_first",
    "SELECT p, s, CAST(row_number() OVER (ORDER BY s NULLS FIRST, p) AS BIGINT) AS place FROM (SELECT 'kg:province/' || n_nationkey AS p, CASE WHEN n_nationkey % 3 = 2 THEN 'kg:province/' || (n_nationkey // 2) END AS s FROM nation) ORDER BY place LIMIT 20",
)
def g17(spark, d):
    t = graph(spark, d)
    both = G.optional(G.pattern(t, "?p", TYPE, "kg:Province"), G.pattern(t, "?p", "kg:successor", "?s"))
    first = both.orderBy(F.col("s").asc_nulls_first(), "p").limit(20)
    from pyspark.sql.window import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_first(), "p")).cast("long"))


@query("g18_top_k", "SELECT 'kg:stadium/' || p_partkey AS x, p_size AS capacity FROM part ORDER BY p_size DESC, x LIMIT 15")
def g18(spark, d):
    x = G.pattern(graph(spark, d), "?x", "kg:capacity", "?c").select("x", F.col("c").try_cast("int").alias("capacity"))
    return x.orderBy(F.desc("capacity"), "x").limit(15)


@query("g19_select_distinct", "SELECT DISTINCT 'kg:province/' || c_nationkey AS prov FROM customer")
def g19(spark, d):
    return G.pattern(graph(spark, d), "?p", "kg:birthProvince", "?prov").select("prov").distinct()


@query("g20_ask", "SELECT count(*) > 0 AS answer FROM nation WHERE n_nationkey = 23 AND n_nationkey // 2 = 11")
def g20(spark, d):
    return G.ask(graph(spark, d).where("s = 'kg:province/23' and p = 'kg:successor' and o = 'kg:province/11'"))


@query(
    "g21_construct",
    "SELECT DISTINCT 'kg:province/' || c_nationkey AS s, 'kg:birthPlaceOf' AS p, 'kg:player/' || c_custkey AS o FROM customer UNION SELECT DISTINCT 'kg:province/' || c_nationkey, 'rdf:type', 'kg:Birthplace' FROM customer",
)
def g21(spark, d):
    x = G.pattern(graph(spark, d), "?p", "kg:birthProvince", "?prov")
    return G.construct(x, (F.col("prov"), F.lit("kg:birthPlaceOf"), F.col("p")), (F.col("prov"), F.lit(TYPE), F.lit("kg:Birthplace")))


_NATION_OUT = """SELECT 'kg:province/' || n_nationkey AS e, 'rdf:type' AS p, 'kg:Province' AS o FROM nation
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'rdfs:label', n_name FROM nation
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'kg:locatedIn', 'kg:country/' || n_regionkey FROM nation
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'rdf:type', 'kg:FormerProvince' FROM nation WHERE n_nationkey % 3 = 2
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'kg:successor', 'kg:province/' || (n_nationkey // 2) FROM nation WHERE n_nationkey % 3 = 2"""
_NATION_IN = """SELECT 'kg:player/' || c_custkey AS s, 'kg:birthProvince' AS p, 'kg:province/' || c_nationkey AS o FROM customer
 UNION ALL SELECT 'kg:club/' || s_suppkey, 'kg:province', 'kg:province/' || s_nationkey FROM supplier
 UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:province', 'kg:province/' || (p_partkey % 25) FROM part
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'kg:successor', 'kg:province/' || (n_nationkey // 2) FROM nation WHERE n_nationkey % 3 = 2"""


@query(
    "g22_describe",
    f"""WITH o AS ({_NATION_OUT}), i AS ({_NATION_IN})
SELECT e AS entity, 'out' AS direction, e AS s, p, o FROM o UNION ALL
SELECT entity, 'in', s, p, entity FROM (SELECT o AS entity, s, p, row_number() OVER (PARTITION BY o ORDER BY s, p) AS k FROM i) WHERE k <= 20""",
)
def g22(spark, d):
    t = graph(spark, d)
    return G.describe(t, G.pattern(t, "?entity", TYPE, "kg:Province"), 20)


@query(
    "g24_edges_among_nodes",
    """WITH e AS (SELECT DISTINCT 'kg:club/' || s_suppkey AS s, 'kg:province' AS p, 'kg:province/' || s_nationkey AS o FROM supplier
 UNION SELECT 'kg:province/' || n_nationkey, 'kg:successor', 'kg:province/' || (n_nationkey // 2) FROM nation WHERE n_nationkey % 3 = 2)
SELECT s, p, o FROM e WHERE (s IN (SELECT 'kg:club/' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) OR s LIKE 'kg:province/%')""",
)
def g24(spark, d):
    t = graph(spark, d).where("p in ('kg:province', 'kg:successor', 'kg:locatedIn')")
    back = t.where("p = 'kg:successor'").select("part", F.col("o").alias("s"), F.lit("kg:predecessor").alias("p"), F.col("s").alias("o"), "o_kind", "dt", "lang")
    clubs = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(iri("club", "s_suppkey").alias("node"))
    nodes = clubs.union(table(spark, d, "nation").select(iri("province", "n_nationkey")))
    return G.edges_among(t.unionByName(back), nodes, [("kg:successor", "kg:predecessor")])


@query(
    "f01_string_functions",
    "SELECT 'kg:stadium/' || p_partkey AS s, lower(p_name) AS low, contains(lower(p_name), 'a') AS has_a, starts_with(p_name, 'B') AS from_b FROM part",
)
def f01(spark, d):
    x = G.pattern(graph(spark, d).where("s like 'kg:stadium/%'"), "?s", LABEL, "?o")
    return x.select("s", F.lower("o").alias("low"), F.contains(F.lower("o"), F.lit("a")).alias("has_a"), F.col("o").startswith("B").alias("from_b"))


@query("f02_language_tags", "SELECT lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def f02(spark, d):
    x = table(spark, d, "documents").select(iri("document", "doc_id").alias("s"), F.lit("kg:abstract").alias("p"), F.col("text").alias("o"), "lang")
    return x.where("lang = 'en' or lang = 'fr'").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("o").alias("texts"))


@query("f03_in_and_not_in", "SELECT 'kg:province/' || n_nationkey AS s, n_name AS o FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_nationkey IN (1, 3, 5, 7, 9)")
def f03(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?s", "kg:locatedIn", "?c"), ("?s", LABEL, "?o"))
    return x.where(~F.col("c").isin("kg:country/1", "kg:country/2") & F.col("s").isin(*[f"kg:province/{k}" for k in (1, 3, 5, 7, 9)])).select("s", "o")


@query("f04_blank_nodes", "SELECT count(*) AS nodes, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS blank FROM events")
def f04(spark, d):
    x = table(spark, d, "events").select(F.when(F.expr("event_id % 7 = 0"), F.concat(F.lit("_:genid"), "event_id")).otherwise(iri("event", "event_id")).alias("o"))
    return x.agg(F.count("*").alias("nodes"), F.sum(F.col("o").startswith("_:").cast("long")).alias("blank"))


@query(
    "f05_ordered_pairs",
    "SELECT 'kg:province/' || a.n_nationkey AS a, 'kg:province/' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND 'kg:province/' || a.n_nationkey < 'kg:province/' || b.n_nationkey",
)
def f05(spark, d):
    x = G.pattern(graph(spark, d), "?a", "kg:locatedIn", "?c").where("a like 'kg:province/%'")
    return x.join(x.withColumnRenamed("a", "b"), "c").where("a < b").select("a", "b")


@query("f06_typed_read_back", "SELECT event_type, CAST(sum(event_id % 3) AS BIGINT) AS zeros_count_as_values, count(*) AS n FROM events GROUP BY event_type")
def f06(spark, d):
    x = table(spark, d, "events").select("event_type", F.expr("event_id % 3").cast("string").alias("o"))
    return x.groupBy("event_type").agg(F.sum(F.expr("try_cast(o as bigint)")).alias("zeros_count_as_values"), F.count(F.expr("try_cast(o as bigint)")).alias("n"))


# ---- hierarchies

_SUCC = "SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey % 3 = 2"


@query(
    "h01_superclasses",
    "WITH RECURSIVE e(a, b) AS (VALUES ('kg:FootballPlayer','kg:Athlete'),('kg:Athlete','kg:Person'),('kg:Person','up:Agent'),('kg:FootballClub','kg:Team'),('kg:Team','up:Agent'),('kg:Province','kg:Place'),('kg:FormerProvince','kg:Province'),('kg:Country','kg:Place'),('kg:Stadium','kg:Place')), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), n AS (SELECT 'kg:FootballPlayer' AS cls, count(*) AS n FROM customer UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier UNION ALL SELECT 'kg:Province', count(*) FROM nation UNION ALL SELECT 'kg:Country', count(*) FROM region UNION ALL SELECT 'kg:Stadium', count(*) FROM part UNION ALL SELECT 'kg:FormerProvince', count(*) FROM nation WHERE n_nationkey % 3 = 2) SELECT n.cls, b AS sup, n FROM n JOIN c ON c.a = n.cls UNION ALL SELECT cls, cls, n FROM n",
)
def h01(spark, d):
    from graphloom.operators.inference import example_ontology

    anc = H.closure(example_ontology(spark).sub_class, reflexive=True).select(F.col("sub").alias("cls"), "sup")
    used = graph(spark, d).where((F.col("p") == TYPE) & ~F.col("o").endswith("Station")).groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))
    return used.join(F.broadcast(anc), "cls").select("cls", "sup", "n")


@query("h02_reflexive_closure", f"WITH RECURSIVE e AS ({_SUCC}), r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT 'kg:province/' || a AS sub, 'kg:province/' || b AS sup FROM r")
def h02(spark, d):
    t = graph(spark, d)
    edges = G.pattern(t, "?sub", "kg:successor", "?sup")
    self_ = G.pattern(t, "?sub", TYPE, "kg:Province").select("sub", F.col("sub").alias("sup"))
    return H.closure(edges).select("sub", "sup").union(self_)


@query("h03_descendants", f"WITH RECURSIVE e AS ({_SUCC}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT 'kg:province/' || b AS cls, 'kg:province/' || a AS descendant FROM r")
def h03(spark, d):
    return H.descendants(G.pattern(graph(spark, d), "?sub", "kg:successor", "?sup"))


@query(
    "h04_primary_parent",
    "WITH e AS (SELECT DISTINCT 'kg:part/' || l_partkey AS sub, CASE WHEN l_suppkey % 2 = 0 THEN 'kg:' ELSE 'ext:' END || l_suppkey AS sup FROM lineitem), r AS (SELECT sub, sup, row_number() OVER (PARTITION BY sub ORDER BY CASE WHEN sup LIKE 'kg:%' THEN 0 ELSE 1 END, sup) AS k FROM e) SELECT sub AS cls, max(CASE WHEN k = 1 THEN sup END) AS parent, coalesce(string_agg(CASE WHEN k > 1 THEN sup END, ',' ORDER BY sup), '') AS others FROM r GROUP BY sub",
)
def h04(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("kg:part/"), "l_partkey").alias("sub"), F.concat(F.when(F.expr("l_suppkey % 2 = 0"), "kg:").otherwise("ext:"), "l_suppkey").alias("sup")).distinct()
    return H.primary_parent(e, "kg:")


@query("h05_collection_members", "SELECT 'kg:station/' || l_orderkey AS list, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS BIGINT) AS pos, 'kg:club/' || l_suppkey AS member FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def h05(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("items"))
    out = lists.select(iri("station", "l_orderkey").alias("list"), F.posexplode("items").alias("pos", "member"))
    return out.select("list", F.col("pos").cast("long").alias("pos"), iri("club", "member").alias("member"))


@query("h07_property_kinds", "SELECT * FROM (VALUES ('kg:birthProvince','object'),('kg:capacity','datatype'),('kg:careerStation','object'),('kg:ground','object'),('kg:locatedIn','object'),('kg:province','object'),('kg:startYear','datatype'),('kg:successor','object'),('kg:team','object'),('rdf:type','object'),('rdfs:label','datatype')) t(p, kind)")
def h07(spark, d):
    kind = F.when(F.bool_or(F.col("o_kind") == "iri"), "object").otherwise("datatype")
    return graph(spark, d).groupBy("p").agg(kind.alias("kind"))


# ---- composite queries


def birth_provinces(triples, n=15):
    """Birth provinces with most players."""
    x = G.bgp(triples, ("?p", TYPE, "kg:FootballPlayer"), ("?p", "kg:birthProvince", "?prov"), ("?prov", LABEL, "?label"))
    return x.groupBy("label").agg(F.countDistinct("p").alias("n")).orderBy(F.desc("n"), "label").limit(n)


@query("z04_top_birth_provinces", "SELECT n_name AS label, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, label LIMIT 15")
def z04(spark, d):
    return birth_provinces(graph(spark, d))


@query(
    "z02_career_by_name",
    "SELECT DISTINCT c_name AS name, 'kg:station/' || o_orderkey AS st, s_name AS team, CAST(year(o_orderdate) AS BIGINT) AS start FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(c_name), '77')",
)
def z02(spark, d):
    t = graph(spark, d)
    who = G.bgp(t, ("?p", TYPE, "kg:FootballPlayer"), ("?p", LABEL, "?name")).where(F.contains(F.lower("name"), F.lit("77"))).distinct()
    st = G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", "kg:team", "?club"), ("?club", LABEL, "?team"))
    out = G.optional(G.natural(who, st), G.pattern(t, "?st", "kg:startYear", "?start"))
    return out.select("name", "st", "team", F.col("start").try_cast("long").alias("start")).distinct()


_GROUND = "(SELECT l_suppkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_suppkey)"


@query(
    "z03_clubs_by_capacity",
    f"SELECT s_name AS club, p_name AS stadium, p_size AS capacity, n_name AS prov FROM {_GROUND} g JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = pk LEFT JOIN nation ON n_nationkey = p_partkey % 25 ORDER BY capacity DESC, club LIMIT 30",
)
def z03(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?c", "kg:ground", "?s"), ("?c", LABEL, "?club"), ("?s", LABEL, "?stadium"), ("?s", "kg:capacity", "?cap"))
    prov = G.bgp(t, ("?s", "kg:province", "?p"), ("?p", LABEL, "?prov"))
    return G.optional(x, prov).select("club", "stadium", F.col("cap").try_cast("int").alias("capacity"), "prov").orderBy(F.desc("capacity"), "club").limit(30)


@query("z05_clubs_per_province", "SELECT n_name AS label, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name ORDER BY n DESC, label LIMIT 15")
def z05(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?c", TYPE, "kg:FootballClub"), ("?c", "kg:province", "?p"), ("?p", LABEL, "?label"))
    return x.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(15)


@query("z07_shared_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 20")
def z07(spark, d):
    x = G.bgp(graph(spark, d), ("?s", TYPE, "kg:Stadium"), ("?s", LABEL, "?name"))
    return x.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(20)


@query("z12_club_ground_province", f"SELECT s_name AS club, p_name AS stadium, n_name AS prov FROM {_GROUND} JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = pk JOIN nation ON n_nationkey = p_partkey % 25")
def z12(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?c", "kg:ground", "?s"), ("?s", "kg:province", "?p"), ("?c", LABEL, "?club"), ("?s", LABEL, "?stadium"), ("?p", LABEL, "?prov"))
    return x.select("club", "stadium", "prov")


@query("z13_province_counts", "SELECT 'kg:province/' || c_nationkey AS prov, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, prov LIMIT 10")
def z13(spark, d):
    x = G.pattern(graph(spark, d), "?p", "kg:birthProvince", "?prov")
    return x.groupBy("prov").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prov").limit(10)


@query(
    "z14_counts_folded_into_successors",
    "SELECT 'kg:province/' || u AS unit, count(DISTINCT c_custkey) AS n, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM (SELECT c_custkey, n_name, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey // 2 ELSE n_nationkey END AS u FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY u ORDER BY n DESC, unit LIMIT 20",
)
def z14(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?p", "kg:birthProvince", "?old"), ("?old", LABEL, "?name"))
    x = G.optional(x, G.pattern(t, "?old", "kg:successor", "?new")).withColumn("unit", F.coalesce("new", "old"))
    return x.groupBy("unit").agg(F.countDistinct("p").alias("n"), G.group_concat("name").alias("names")).orderBy(F.desc("n"), "unit").limit(20)


@query("z18_clubs_in_province", f"SELECT s_name AS club FROM {_GROUND} JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = pk JOIN nation ON n_nationkey = p_partkey % 25 WHERE n_name = 'NATION_1'")
def z18(spark, d):
    t = graph(spark, d)
    where = G.pattern(t, "?p", LABEL, "NATION_1").distinct()
    return G.natural(where, G.bgp(t, ("?s", "kg:province", "?p"), ("?c", "kg:ground", "?s"), ("?c", LABEL, "?club"))).select("club")


@query("z19_top_provinces_with_id", "SELECT 'kg:province/' || c_nationkey AS prov, n_name AS label, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey, n_name ORDER BY n DESC, prov LIMIT 10")
def z19(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?p", "kg:birthProvince", "?prov"), ("?prov", LABEL, "?label"))
    return x.groupBy("prov", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prov").limit(10)


@query("z21_current_provinces", "SELECT count(*) AS n FROM nation WHERE n_nationkey % 3 <> 2")
def z21(spark, d):
    return g07(spark, d).agg(F.count("*").alias("n"))


@query(
    "z25_careers_of_a_shared_name",
    "SELECT DISTINCT p_name AS name, 'kg:stadium/' || p_partkey AS s, 'kg:club/' || l_suppkey AS club FROM part JOIN (SELECT l_suppkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_suppkey) ON pk = p_partkey",
)
def z25(spark, d):
    t = graph(spark, d)
    return G.bgp(t, ("?s", TYPE, "kg:Stadium"), ("?s", LABEL, "?name"), ("?club", "kg:ground", "?s")).select("name", "s", "club").distinct()


@query("z28_successor_of_former", "SELECT n_name AS name, 'kg:province/' || (n_nationkey // 2) AS successor FROM nation WHERE n_nationkey % 3 = 2")
def z28(spark, d):
    t = graph(spark, d)
    return G.bgp(t, ("?p", TYPE, "kg:FormerProvince"), ("?p", LABEL, "?name"), ("?p", "kg:successor", "?successor")).select("name", "successor")


@query("z31_teams_by_start_year", "SELECT DISTINCT 'kg:player/' || o_custkey AS p, CAST(year(o_orderdate) AS BIGINT) AS start, 'kg:club/' || l_suppkey AS team FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 100 = 1")
def z31(spark, d):
    t = graph(spark, d)
    who = G.pattern(t, "?p", TYPE, "kg:FootballPlayer").where(F.element_at(F.split("p", "/"), -1).try_cast("long") % 100 == 1)
    x = G.natural(who, G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", "kg:startYear", "?y"), ("?st", "kg:team", "?team")))
    return x.select("p", F.col("y").try_cast("long").alias("start"), "team").distinct()


@query("z31_teams_by_start_year_of_every_player", "SELECT DISTINCT 'kg:player/' || o_custkey AS p, CAST(year(o_orderdate) AS BIGINT) AS start, 'kg:club/' || l_suppkey AS team FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def z31_all(spark, d):
    t = graph(spark, d)
    who = G.pattern(t, "?p", TYPE, "kg:FootballPlayer")
    x = G.natural(who, G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", "kg:startYear", "?y"), ("?st", "kg:team", "?team")))
    return x.select("p", F.col("y").try_cast("long").alias("start"), "team").distinct()


@query("z33_grounds_in_known_provinces", f"SELECT count(*) AS n FROM {_GROUND} JOIN part ON p_partkey = pk JOIN nation ON n_nationkey = p_partkey % 25")
def z33(spark, d):
    t = graph(spark, d)
    return G.bgp(t, ("?c", "kg:ground", "?s"), ("?s", "kg:province", "?p"), ("?p", TYPE, "kg:Province")).agg(F.count("*").alias("n"))


@query("z35_three_counts", "SELECT count(CASE WHEN s_nationkey = 1 THEN 1 END) AS here, count(CASE WHEN s_nationkey % 3 = 2 THEN 1 END) AS linked, count(*) AS every FROM supplier")
def z35(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?c", TYPE, "kg:FootballClub"), ("?c", "kg:province", "?p"))
    x = G.optional(x, G.pattern(t, "?p", "kg:successor", "?new"))
    return x.agg(F.count(F.when(F.col("p") == "kg:province/1", 1)).alias("here"), F.count("new").alias("linked"), F.count("*").alias("every"))
