"""Search, entity views, class browser, geography, linking and what-if queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.terms import fold, token_key
from graphloom.operators import views as V
from graphloom.operators.chains import final_successor
from graphloom.operators.inference import example_ontology
from graphloom.operators.mentions import linked_mentions
from graphloom.plans.registry import query
from graphloom.sources.tables import LABEL, TYPE, dealt, graph, iri, table

_SUCC = "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, r.b // 2 FROM r WHERE r.b % 3 = 2), f AS (SELECT a, b FROM r WHERE b % 3 <> 2)"


@query("l01_preferred_labels", "SELECT 'kg:source/' || source AS s, coalesce(min(CASE WHEN lang = 'fr' THEN left(text, 30) END), min(CASE WHEN lang = 'en' THEN left(text, 30) END), min(left(text, 30))) AS label FROM documents GROUP BY source")
def l01(spark, d):
    x = table(spark, d, "documents").select(iri("source", "source").alias("s"), F.substring("text", 1, 30).alias("o"), "lang")
    return V.preferred_labels(x, ["fr", "en"])


@query("l02_display_class", "SELECT 'kg:province/' || n_nationkey AS s, CASE WHEN n_nationkey % 3 = 2 THEN 'kg:FormerProvince' ELSE 'kg:Province' END AS cls FROM nation UNION ALL SELECT 'kg:country/' || r_regionkey, 'kg:Country' FROM region")
def l02(spark, d):
    return V.display_class(graph(spark, d).where(F.col("p") == TYPE), ["kg:FormerProvince", "kg:Province", "kg:Country"])


@query("l03_node_kind", "SELECT 'kg:station/' || o_orderkey AS s, CASE o_orderstatus WHEN 'P' THEN 'team' ELSE 'station' END AS kind FROM orders")
def l03(spark, d):
    x = V.display_class(graph(spark, d).where(F.col("p") == TYPE), ["kg:NationalTeamStation", "kg:ClubStation", "kg:YouthStation"])
    return x.select("s", F.when(F.col("cls") == "kg:NationalTeamStation", "team").otherwise("station").alias("kind"))


@query("l04_name_index", "SELECT 'kg:stadium/' || p_partkey AS entity, p_name AS name, lower(p_name) AS folded FROM part UNION ALL SELECT 'kg:club/' || s_suppkey, s_name, lower(replace(s_name, '_', ' ')) FROM supplier")
def l04(spark, d):
    return V.name_index(graph(spark, d), ["kg:Stadium", "kg:FootballClub"])


@query(
    "l05_ranked_search",
    """WITH q AS (SELECT row_number() OVER (ORDER BY p_name) AS qid, lower(string_split(p_name, ' ')[1]) AS q FROM (SELECT DISTINCT p_name FROM part)),
n AS (SELECT DISTINCT 'kg:stadium/' || p_partkey AS entity, p_name AS name, lower(p_name) AS folded FROM part),
h AS (SELECT qid, entity, name, CASE WHEN folded = q THEN 0 WHEN starts_with(folded, q) THEN 1 WHEN contains(' ' || folded, ' ' || q) THEN 2 ELSE 3 END AS r FROM n JOIN q ON contains(folded, q) WHERE length(q) >= 3)
SELECT CAST(qid AS BIGINT) AS qid, entity, name, place FROM (SELECT qid, entity, name, row_number() OVER (PARTITION BY qid ORDER BY r, length(name), name, entity) AS place FROM h) WHERE place <= 8""",
)
def l05(spark, d):
    t = graph(spark, d).where("s like 'kg:stadium/%'")
    distinct = V.counted(table(spark, d, "part").select("p_name").distinct(), "p_name", "qid")
    queries = distinct.select(F.col("qid").cast("long"), F.split("p_name", " ")[0].alias("text"))
    return V.search(V.name_index(t, ["kg:Stadium"]), queries.where(F.length("text") >= 3), 8)  # as the SQL; l05_ranked_search_short asks for less


@query(
    "l05_ranked_search_short",
    """WITH q AS (SELECT DISTINCT lower(p_name[1:k]) AS qid, lower(p_name[1:k]) AS q FROM part, (VALUES (1), (2)) t(k)),
n AS (SELECT DISTINCT 'kg:stadium/' || p_partkey AS entity, p_name AS name, lower(p_name) AS folded FROM part),
h AS (SELECT qid, entity, name, CASE WHEN folded = q THEN 0 WHEN starts_with(folded, q) THEN 1 WHEN contains(' ' || folded, ' ' || q) THEN 2 ELSE 3 END AS r FROM n JOIN q ON contains(folded, q))
SELECT qid, entity, name, place FROM (SELECT qid, entity, name, row_number() OVER (PARTITION BY qid ORDER BY r, length(name), name, entity) AS place FROM h) WHERE place <= 8""",
)
def l05_short(spark, d):
    t = graph(spark, d).where("s like 'kg:stadium/%'")
    text = F.lower(F.expr("substring(p_name, 1, k)"))
    queries = table(spark, d, "part").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(text.alias("qid"), text.alias("text")).distinct()
    return V.search(V.name_index(t, ["kg:Stadium"]), queries, 8)


@query("l06_folded_names", "SELECT lower(p_name) AS folded, count(*) AS n FROM part GROUP BY 1")
def l06(spark, d):
    x = V.name_index(graph(spark, d), ["kg:Stadium"])
    return x.groupBy("folded").agg(F.count_distinct("entity").alias("n"))


@query("l07_cells_to_entities", "SELECT s_name AS cell, 'kg:club/' || s_suppkey AS entity FROM supplier UNION ALL SELECT p_name, CASE WHEN count(*) = 1 THEN min('kg:stadium/' || p_partkey) END FROM part GROUP BY p_name")
def l07(spark, d):
    t = graph(spark, d).where("p = 'rdfs:label' and (s like 'kg:stadium/%' or s like 'kg:club/%')")
    cells = t.select(F.col("o").alias("cell")).distinct()
    unique = t.groupBy(F.col("o").alias("cell")).agg(F.count_distinct("s").alias("n"), F.min("s").alias("e")).where("n = 1")
    return cells.join(unique, "cell", "left").select("cell", F.col("e").alias("entity"))


@query("l08_evidence_nodes", "SELECT DISTINCT 'kg:province/' || c_nationkey AS node FROM customer WHERE c_custkey % 2 = 0 ORDER BY node LIMIT 60")
def l08(spark, d):
    x = graph(spark, d).where("p = 'kg:birthProvince'").where(F.element_at(F.split("s", "/"), -1).try_cast("long") % 2 == 0)
    return x.select(F.col("o").alias("node")).distinct().orderBy("node").limit(60)


@query("l08_evidence_nodes_of_every_player", "SELECT DISTINCT 'kg:province/' || c_nationkey AS node FROM customer ORDER BY node LIMIT 60")
def l08_all(spark, d):
    x = graph(spark, d).where("p = 'kg:birthProvince'")
    return x.select(F.col("o").alias("node")).distinct().orderBy("node").limit(60)


@query("l09_alternative_names", "SELECT o.n_name AS alternative, n.n_name AS name FROM nation o JOIN nation n ON o.n_nationkey % 3 = 2 AND n.n_nationkey = o.n_nationkey // 2")
def l09(spark, d):
    t = graph(spark, d)
    label = t.where("p = 'rdfs:label'").select("s", "o")
    x = t.where("p = 'kg:successor'").select("s", F.col("o").alias("new"))
    x = x.join(label.withColumnRenamed("o", "alternative"), "s")
    return x.join(label.select(F.col("s").alias("new"), F.col("o").alias("name")), "new").select("alternative", "name")


@query("l10_node_classification", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'schema' ELSE 'external' END AS kind FROM pages")
def l10(spark, d):
    node = F.element_at(F.array(F.lit("kg:page/"), F.lit("rdfs:"), F.lit("https://")), (F.col("page_id") % 3 + 1).cast("int"))
    x = table(spark, d, "pages").select("page_id", F.concat(node, "page_id").alias("n"))
    return x.select("page_id", F.when(F.col("n").startswith("kg:"), "entity").when(F.col("n").rlike("^(rdfs?|owl|skos):"), "schema").otherwise("external").alias("kind"))


_ALL_STADIUM = "SELECT 'kg:stadium/' || p_partkey AS s, 'rdf:type' AS p, 'kg:Stadium' AS o, 0 AS l FROM part UNION ALL SELECT 'kg:stadium/' || p_partkey, 'rdfs:label', p_name, 1 FROM part UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:capacity', CAST(p_size AS VARCHAR), 1 FROM part UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:province', 'kg:province/' || (p_partkey % 25), 0 FROM part"


@query("b01_property_table", "SELECT s, p, o, place, total FROM (SELECT s, p, o, row_number() OVER (PARTITION BY s, p ORDER BY o) AS place, count(*) OVER (PARTITION BY s, p) AS total FROM (SELECT DISTINCT 'kg:station/' || l_orderkey AS s, 'kg:team' AS p, 'kg:club/' || l_suppkey AS o FROM lineitem)) WHERE place <= 3")
def b01(spark, d):
    return V.property_table(graph(spark, d).where("p = 'kg:team'"), 3)


@query("b02_property_namespace", f"SELECT CASE WHEN p LIKE 'kg:%' THEN 'own' WHEN p LIKE 'rdf%' THEN 'core' ELSE 'other' END AS grp, count(*) AS n FROM ({_ALL_STADIUM}) GROUP BY 1")
def b02(spark, d):
    grp = F.when(F.col("p").startswith("kg:"), "own").when(F.col("p").startswith("rdf"), "core").otherwise("other")
    return graph(spark, d).where("s like 'kg:stadium/%'").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))


@query("b05_asserted_classes", "SELECT 'kg:province/' || n_nationkey AS s, CASE WHEN n_nationkey % 3 = 2 THEN 'kg:FormerProvince,kg:Province' ELSE 'kg:Province' END AS classes FROM nation")
def b05(spark, d):
    t = graph(spark, d).where("p = 'rdf:type' and s like 'kg:province/%'")
    return t.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), ",").alias("classes"))


@query("b08_neighbours", "SELECT node, other, CASE WHEN min(side) = 0 THEN 'out' ELSE 'in' END AS side, string_agg(DISTINCT p, ',' ORDER BY p) AS props FROM (SELECT 'kg:club/' || s_suppkey AS node, 'kg:province/' || s_nationkey AS other, 0 AS side, 'kg:province' AS p FROM supplier UNION ALL SELECT 'kg:province/' || s_nationkey, 'kg:club/' || s_suppkey, 1, 'kg:province' FROM supplier UNION ALL SELECT 'kg:club/' || l_suppkey, 'kg:stadium/' || min(l_partkey), 0, 'kg:ground' FROM lineitem GROUP BY l_suppkey) GROUP BY node, other")
def b08(spark, d):
    t = graph(spark, d).where("s like 'kg:club/%' and p in ('kg:province', 'kg:ground')")
    return V.neighbours(t, ["kg:province", "kg:ground"], ["kg:ground"])


@query("b09_round_robin", "WITH n AS (SELECT 'kg:club/' || s_suppkey AS node, 'out' AS side, 'kg:province/' || s_nationkey AS other, 'kg:province' AS lead FROM supplier UNION ALL SELECT 'kg:club/' || l_suppkey, 'out', 'kg:stadium/' || l_partkey, 'kg:x' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), t AS (SELECT *, row_number() OVER (PARTITION BY node, side, lead ORDER BY other) AS turn FROM n) SELECT node, side, other, place FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY turn, lead) AS place FROM t) WHERE place <= 5")
def b09(spark, d):
    a = table(spark, d, "supplier").select(iri("club", "s_suppkey").alias("node"), iri("province", "s_nationkey").alias("other"), F.lit("out").alias("side"), F.lit("kg:province").alias("props"))
    b = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().select(iri("club", "l_suppkey").alias("node"), iri("stadium", "l_partkey").alias("other"), F.lit("out").alias("side"), F.lit("kg:x").alias("props"))
    return V.round_robin(a.unionByName(b), 5)


@query("b11_inferred_edges", "SELECT o_custkey AS s, o_orderstatus AS o, bool_and(o_orderkey % 5 <> 0) AS inferred FROM orders GROUP BY o_custkey, o_orderstatus")
def b11(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s"), F.col("o_orderstatus").alias("o")).agg(F.bool_and(F.expr("o_orderkey % 5 <> 0")).alias("inferred"))


@query(
    "b14_relation_tree",
    """WITH e AS (SELECT 'kg:country/' || n_regionkey AS s, 'kg:province/' || n_nationkey AS o FROM nation UNION SELECT 'kg:province/' || s_nationkey, 'kg:club/' || s_suppkey FROM supplier UNION SELECT 'kg:club/' || l_suppkey, 'kg:stadium/' || min(l_partkey) FROM lineitem GROUP BY l_suppkey),
a AS (SELECT s AS root, o AS node, s || '>' || o AS path, row_number() OVER (PARTITION BY s ORDER BY o) AS k FROM e WHERE s LIKE 'kg:country/%'),
b AS (SELECT root, o AS node, path || '>' || o AS path, row_number() OVER (PARTITION BY root, path ORDER BY o) AS k FROM a JOIN e ON e.s = node WHERE k <= 15),
c AS (SELECT root, o AS node, path || '>' || o AS path, row_number() OVER (PARTITION BY root, path ORDER BY o) AS k FROM b JOIN e ON e.s = node WHERE k <= 8)
SELECT root, depth, node, path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS n FROM (SELECT root, 1 AS depth, node, path FROM a WHERE k <= 15 UNION ALL SELECT root, 2, node, path FROM b WHERE k <= 8 UNION ALL SELECT root, 3, node, path FROM c WHERE k <= 6)) WHERE n <= 300""",
)
def b14(spark, d):
    t = graph(spark, d)
    e = t.where("p = 'kg:locatedIn'").select(F.col("o").alias("s"), F.col("s").alias("o"))
    e = e.union(t.where("p = 'kg:province' and s like 'kg:club/%'").select(F.col("o"), F.col("s"))).union(t.where("p = 'kg:ground'").select("s", "o"))
    return V.relation_tree(e, table(spark, d, "region").select(iri("country", "r_regionkey").alias("root")))


@query("b15_node_budget", "SELECT root, count(*) AS nodes FROM (SELECT 'kg:province/' || c_nationkey AS root, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'kg:player/' || c_custkey) AS k FROM customer) WHERE k <= 5 GROUP BY root")
def b15(spark, d):
    e = graph(spark, d).where("p = 'kg:birthProvince'").select(F.col("o").alias("s"), F.col("s").alias("o"))
    roots = e.select(F.col("s").alias("root")).distinct()
    return V.relation_tree(e, roots, (8,), 5).groupBy("root").agg(F.count("*").alias("nodes"))


@query("b16_career_list", "SELECT 'kg:player/' || o_custkey AS player, 'kg:station/' || o_orderkey AS station, CAST(year(o_orderdate) AS BIGINT) AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, 'kg:station/' || o_orderkey) AS place FROM orders")
def b16(spark, d):
    t = graph(spark, d)
    st = t.where("s like 'kg:station/%' and p in ('rdf:type', 'kg:startYear')").groupBy(F.col("s").alias("station")).agg(
        F.max(F.when(F.col("p") == "kg:startYear", F.col("o"))).try_cast("long").alias("start"), F.max(F.when(F.col("p") == TYPE, F.col("o"))).alias("cls"))
    x = t.where("p = 'kg:careerStation'").select(F.col("s").alias("player"), F.col("o").alias("station")).join(st, "station")
    rank = F.when(F.col("cls") == "kg:YouthStation", 1).when(F.col("cls") == "kg:ClubStation", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("player").orderBy(F.col("start").asc_nulls_last(), rank, "station"))
    return x.select("player", "station", "start", place.cast("long").alias("place"))


@query("b18_station_notes", "SELECT o_orderkey, concat_ws(', ', 'from ' || year(o_orderdate), CASE WHEN o_orderkey % 2 = 0 THEN 'on loan' END) AS note FROM orders")
def b18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(", ", F.concat(F.lit("from "), F.year("o_orderdate")), F.when(F.expr("o_orderkey % 2 = 0"), "on loan")).alias("note"))


@query("b19_career_lanes", "SELECT o_custkey, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS INTEGER) AS lane FROM orders")
def b19(spark, d):
    y = F.year("o_orderdate")
    return V.lanes(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), y.alias("start"), (y + 1).alias("end")), ["o_custkey"]).drop("beside")


@query("b20_career_span", "SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS first, CAST(max(CASE WHEN o_orderstatus = 'O' THEN 2026 ELSE year(o_orderdate) END) AS INTEGER) AS last FROM orders GROUP BY o_custkey")
def b20(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(y).alias("first"), F.max(F.coalesce(F.when(F.col("o_orderstatus") != "O", y), F.lit(2026))).alias("last"))


@query("b21_key_facts", "SELECT 'kg:stadium/' || p_partkey AS s, 'kg:capacity' AS p FROM part UNION ALL SELECT 'kg:stadium/' || p_partkey, 'kg:province' FROM part")
def b21(spark, d):
    t = graph(spark, d).where("s like 'kg:stadium/%' and p like 'kg:%'").groupBy("s", "p").agg(F.count("*").alias("n")).where("n <= 3")
    return t.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("p"))).where("k <= 6").select("s", "p")


@query("b22_entity_summary", "SELECT source, min(CASE WHEN lang = 'fr' THEN doc_id END) AS abstract, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source")
def b22(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy("source").agg(F.min(F.when(F.col("lang") == "fr", F.col("doc_id"))).alias("abstract"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query("c01_members", "SELECT 'kg:Province' AS cls, count(*) AS n FROM nation UNION ALL SELECT 'kg:FormerProvince', count(*) FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 'kg:Country', count(*) FROM region")
def c01(spark, d):
    t = graph(spark, d).where("p = 'rdf:type' and (s like 'kg:province/%' or s like 'kg:country/%')")
    return t.groupBy(F.col("o").alias("cls")).agg(F.count_distinct("s").alias("n"))


@query("c02_direct_members", "SELECT 'kg:province/' || n_nationkey AS s, CASE WHEN n_nationkey % 3 = 2 THEN 'kg:FormerProvince' ELSE 'kg:Province' END AS cls FROM nation")
def c02(spark, d):
    t = graph(spark, d).where("p = 'rdf:type' and s like 'kg:province/%'").select("s", F.col("o").alias("cls"))
    return V.direct_members(t, example_ontology(spark).sub_class)


@query("c04_label_only_resources", "SELECT 'kg:stadium/' || p_partkey AS s FROM part WHERE p_size < 10")
def c04(spark, d):
    t = graph(spark, d).where("s like 'kg:stadium/%'")
    big = table(spark, d, "part").where("p_size >= 10").select(iri("stadium", "p_partkey").alias("s"))
    typed = t.where(F.col("p") == TYPE).join(big, "s", "left_semi").select("s")
    return t.where(F.col("p") == LABEL).select("s").distinct().join(typed, "s", "left_anti")


@query("c05_total_resources", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM part) AS n")
def c05(spark, d):
    t = graph(spark, d).where("p = 'rdf:type' and o in ('kg:Province', 'kg:FormerProvince', 'kg:Country', 'kg:Stadium')")
    return t.select("s").distinct().agg(F.count("*").alias("n"))


@query("c06_name_filter", "SELECT entity, name, total FROM (SELECT 'kg:stadium/' || p_partkey AS entity, p_name AS name, count(*) OVER () AS total, row_number() OVER (ORDER BY p_name, 'kg:stadium/' || p_partkey) AS k FROM part WHERE contains(lower(p_name), 'e')) WHERE k <= 100")
def c06(spark, d):
    x = V.name_index(graph(spark, d), ["kg:Stadium"]).where(F.contains("folded", F.lit("e")))
    n = x.agg(F.count("*").alias("total"))
    return x.orderBy("name", "entity").limit(100).crossJoin(F.broadcast(n)).select("entity", "name", "total")  # one row


@query("a02_succession_pairs", "SELECT 'kg:province/' || n_nationkey AS a, 'kg:province/' || (n_nationkey // 2) AS b, true AS asserted FROM nation WHERE n_nationkey % 3 = 2")
def a02(spark, d):
    t = graph(spark, d).where("p = 'kg:successor'").select(F.col("s").alias("a"), F.col("o").alias("b"), F.lit(True).alias("x"))
    back = t.select("a", "b", F.lit(False).alias("x"))
    return t.union(back).groupBy("a", "b").agg(F.bool_or("x").alias("asserted"))


@query("a04_final_successor", f"{_SUCC} SELECT 'kg:province/' || a AS node, 'kg:province/' || b AS final FROM f WHERE a % 3 = 2")
def a04(spark, d):
    t = graph(spark, d)
    going = t.where("p = 'rdf:type' and o = 'kg:FormerProvince'").select(F.col("s").alias("node"))
    return final_successor(t.where("p = 'kg:successor'").select(F.col("s").alias("node"), F.col("o").alias("successor")), going).drop("cycle")


@query("a05_members_by_route", "SELECT 'kg:province/' || c_nationkey AS unit, 'player' AS kind, 'kg:player/' || c_custkey AS member FROM customer UNION SELECT 'kg:province/' || s_nationkey, 'club', 'kg:club/' || s_suppkey FROM supplier UNION SELECT 'kg:province/' || (min(l_partkey) % 25), 'club', 'kg:club/' || l_suppkey FROM lineitem GROUP BY l_suppkey UNION SELECT 'kg:province/' || (p_partkey % 25), 'stadium', 'kg:stadium/' || p_partkey FROM part")
def a05(spark, d):
    t = graph(spark, d)
    own = t.where("p = 'kg:province'").select(F.col("o").alias("unit"), F.when(F.col("s").startswith("kg:club/"), "club").otherwise("stadium").alias("kind"), F.col("s").alias("member"))
    born = t.where("p = 'kg:birthProvince'").select(F.col("o").alias("unit"), F.lit("player").alias("kind"), F.col("s").alias("member"))
    ground = t.where("p = 'kg:ground'").select(F.col("s").alias("member"), F.col("o").alias("st"))
    where = t.where("p = 'kg:province'").select(F.col("s").alias("st"), F.col("o").alias("unit"))
    return born.union(own).union(ground.join(where, "st").select("unit", F.lit("club").alias("kind"), "member")).distinct()


@query("a06_province_table", "SELECT 'kg:province/' || n_nationkey AS unit, n_nationkey % 3 = 2 AS former, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS players, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS clubs FROM nation")
def a06(spark, d):
    t = graph(spark, d)
    unit = t.where("p = 'rdf:type' and s like 'kg:province/%'").groupBy(F.col("s").alias("unit")).agg(F.bool_or(F.col("o") == "kg:FormerProvince").alias("former"))
    m = t.where("p = 'kg:birthProvince' or (p = 'kg:province' and s like 'kg:club/%')").groupBy(F.col("o").alias("unit")).agg(
        F.count_if(F.col("p") == "kg:birthProvince").alias("players"), F.count_if(F.col("p") == "kg:province").alias("clubs"))
    return unit.join(m, "unit", "left").select("unit", "former", F.coalesce("players", F.lit(0)).alias("players"), F.coalesce("clubs", F.lit(0)).alias("clubs"))


@query("a07_folded_counts", f"{_SUCC} SELECT 'kg:province/' || b AS unit, count(DISTINCT c_custkey) AS n FROM customer JOIN f ON a = c_nationkey GROUP BY b")
def a07(spark, d):
    t = graph(spark, d)
    members = t.where("p = 'kg:birthProvince'").select(F.col("o").alias("unit"), F.col("s").alias("member"))
    return V.folded_counts(members, t.where("p = 'kg:successor'").select(F.col("s").alias("node"), F.col("o").alias("successor")))


@query("a08_top_players_per_unit", "SELECT unit, player, n FROM (SELECT 'kg:province/' || c_nationkey AS unit, 'kg:player/' || c_custkey AS player, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, 'kg:player/' || c_custkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) WHERE k <= 12")
def a08(spark, d):
    t = graph(spark, d)
    n = t.where("p = 'kg:careerStation'").groupBy(F.col("s").alias("player")).agg(F.count("*").alias("n"))
    x = t.where("p = 'kg:birthProvince'").select(F.col("o").alias("unit"), F.col("s").alias("player")).join(n, "player")
    k = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("n"), "player"))
    return x.withColumn("k", k).where("k <= 12").select("unit", "player", "n")


@query("a09_boundary_match", "SELECT n_name AS shape, 'kg:province/' || n_nationkey AS unit FROM nation")
def a09(spark, d):
    key = lambda c: token_key(F.regexp_replace(F.regexp_replace(c, r"\s*\(.*?\)", ""), r"(?i)^province of ", ""))
    shapes = table(spark, d, "nation").select(F.col("n_name").alias("shape"), key(F.concat(F.lit("Province of "), "n_name", F.lit(" (map)"))).alias("key"))
    t = graph(spark, d).where("s like 'kg:province/%'")
    former = t.where("o = 'kg:FormerProvince'").select("s", F.lit(True).alias("f"))
    units = t.where("p = 'rdfs:label'").join(former, "s", "left").groupBy(key(F.col("o")).alias("key")).agg(F.min(F.struct(F.coalesce("f", F.lit(False)).alias("f"), "s")).alias("b"))
    return shapes.join(units, "key", "left").select("shape", F.col("b.s").alias("unit"))


@query("a10_quantile_breaks", "WITH v AS (SELECT list_sort(list(n)) AS l FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) SELECT array_to_string(list_sort(list_distinct([l[CAST(floor(0.2 * len(l)) AS INTEGER) + 1], l[CAST(floor(0.4 * len(l)) AS INTEGER) + 1], l[CAST(floor(0.6 * len(l)) AS INTEGER) + 1], l[CAST(floor(0.8 * len(l)) AS INTEGER) + 1]])), ',') AS breaks FROM v")
def a10(spark, d):
    v = graph(spark, d).where("p = 'kg:careerStation'").groupBy("s").agg(F.count("*").alias("v"))
    return V.quantile_breaks(v).select(F.array_join(F.transform("breaks", lambda x: x.cast("string")), ",").alias("breaks"))


@query("a11_units_per_final", f"{_SUCC} SELECT 'kg:province/' || b AS final, string_agg('kg:province/' || a, ',' ORDER BY 'kg:province/' || a) AS units FROM f WHERE a % 3 = 2 GROUP BY b")
def a11(spark, d):
    return a04(spark, d).groupBy("final").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("units"))


@query("u01_exact_name_index", "SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1")
def u01(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.array(token_key(F.concat("p_name", F.lit(" (x)"))), token_key(F.col("p_name"))))).alias("key"))
    return x.where(~F.col("key").endswith(" x")).groupBy("key").agg(F.count_distinct("p_partkey").alias("n"))


@query("u02_tail_index", "SELECT 'kg:stadium/' || p_partkey AS entity, array_to_string(string_split(lower(p_name) || ' of the north', ' ')[-n:], ' ') AS tail FROM part, (VALUES (2), (3), (4)) t(n) WHERE n < len(string_split(p_name, ' ')) + 3")
def u02(spark, d):
    w = F.split(token_key(F.concat("p_name", F.lit(" of the north"))), " ")
    x = table(spark, d, "part").select(iri("stadium", "p_partkey").alias("entity"), w.alias("w")).withColumn("n", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return x.where("n < size(w)").select("entity", F.array_join(F.expr("slice(w, size(w) - n + 1, n)"), " ").alias("tail"))


@query("u03_word_ngrams", "SELECT doc_id, CAST(sum(greatest(len(w) - n + 1, 0)) AS BIGINT) AS spans FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents WHERE lang = 'en'), (VALUES (1), (2), (3)) t(n) GROUP BY doc_id")
def u03(spark, d):
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")
    x = table(spark, d, "documents").where("lang = 'en'").select("doc_id", w.alias("w")).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return x.groupBy("doc_id").agg(F.sum(F.greatest(F.size("w") - F.col("n") + 1, F.lit(0))).alias("spans"))


@query(
    "u03_every_word_ngram",
    r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, range(1, 9) t(n))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM s""",
)
def u03_all(spark, d):
    w = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    x = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", w.alias("w"))
    # a text is exploded once, to its positions with the words from there on; the longer grams of a position grow from the shorter ones
    ahead = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, 8))
    x = x.where(F.size("w") > 0).select("doc_id", F.posexplode(ahead).alias("pos", "a"))
    x = x.select("doc_id", (F.col("pos") + 1).alias("pos"), "a", F.col("a")[0].alias("g1"))
    for n in range(2, 9):
        x = x.withColumn(f"g{n}", F.concat(f"g{n - 1}", F.lit(" "), F.get("a", F.lit(n - 1))))
    return x.select("doc_id", "pos", F.posexplode(F.array(*[f"g{n}" for n in range(1, 9)])).alias("n", "gram")).where("gram is not null").select("doc_id", "pos", (F.col("n") + 1).alias("n"), "gram")


@query("u05_linked_mentions", "SELECT p_partkey AS qid, CAST(pos AS INTEGER) AS pos, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, lower(p_name) AS text FROM (SELECT p_partkey, p_name, 3 AS pos FROM part) WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) <= 6)")
def u05(spark, d):
    p = table(spark, d, "part")
    questions = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Where is "), "p_name", F.lit("?")).alias("text"))
    return linked_mentions(questions, p.select(iri("stadium", "p_partkey").alias("entity"), F.col("p_name").alias("name"))).select("qid", "pos", "n", "text")


@query("u07_unknown_references", "SELECT DISTINCT 'kg:club/' || user_id AS ref FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def u07(spark, d):
    t = graph(spark, d).where("s like 'kg:club/%'")
    refs = table(spark, d, "events").select(iri("club", "user_id").alias("ref")).distinct()
    return refs.join(t.select(F.col("s").alias("ref")).distinct(), "ref", "left_anti")


@query("u08_class_mismatches", "SELECT event_type AS request, string_agg(DISTINCT 'kg:Province', ',') AS classes FROM events WHERE event_type <> 'click' GROUP BY event_type")
def u08(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("request"), F.when(F.col("event_type") == "click", "kg:Country").otherwise("kg:Province").alias("cls"))
    per = e.groupBy("request").agg(F.bool_or(F.col("cls") == "kg:Country").alias("fits"), F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"))
    return per.where("not fits").select("request", "classes")


@query("u09_all_words_match", "SELECT 'kg:stadium/' || a.p_partkey AS entity, a.p_name AS name FROM part a WHERE contains(lower(a.p_name), 'a') AND contains(lower(a.p_name), 'e')")
def u09(spark, d):
    words = spark.createDataFrame([("a",), ("e",)], "word string")
    x = V.name_index(graph(spark, d), ["kg:Stadium"]).join(F.broadcast(words), F.contains(F.col("folded"), F.col("word")))
    return x.groupBy("entity", "name").agg(F.count_distinct("word").alias("n")).where("n = 2").select("entity", "name")


@query("u10_linking_properties", "SELECT 'kg:province/' || k AS entity, p, example FROM (SELECT c_nationkey AS k, 'kg:birthProvince' AS p, min('kg:player/' || c_custkey) AS example FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'kg:clubProvince', min('kg:club/' || s_suppkey) FROM supplier GROUP BY 1)")
def u10(spark, d):
    t = graph(spark, d).where("p = 'kg:birthProvince' or (p = 'kg:province' and s like 'kg:club/%')")
    x = t.groupBy(F.col("o").alias("entity"), F.when(F.col("p") == "kg:province", "kg:clubProvince").otherwise(F.col("p")).alias("p")).agg(F.min("s").alias("example"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("p"))).where("k <= 3").select("entity", "p", "example")


@query("u12_question_language", "SELECT doc_id, CASE WHEN e >= f THEN 'en' ELSE 'fr' END AS guess FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'in'))) AS e, len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'de'))) AS f FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents))")
def u12(spark, d):
    w = F.split(F.lower("text"), " ")
    n = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
    x = table(spark, d, "documents").select("doc_id", n(["the", "of", "and", "in"]).alias("e"), n(["le", "la", "les", "de"]).alias("f"))
    return x.select("doc_id", F.when(F.col("e") >= F.col("f"), "en").otherwise("fr").alias("guess"))


@query("u13_shared_names", "SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def u13(spark, d):
    x = V.name_index(graph(spark, d), ["kg:Stadium"]).groupBy(F.col("folded").alias("key")).agg(F.count_distinct("entity").alias("n"))
    return x.where("n > 1")


@query("u15_stored_questions", "SELECT p_partkey AS qid, lower(p_name) || ' where' AS key FROM part")
def u15(spark, d):
    p = table(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("qid"), token_key(F.concat("p_name", F.lit(", WHERE?!"))).alias("key"))
    stored = p.select(token_key(F.concat("p_name", F.lit(" where"))).alias("key")).distinct()
    return asked.join(stored, "key").select("qid", "key")


_PROPOSED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'kg:province/' || c_nationkey ELSE 'kg:club/1' END AS o FROM customer"


@query("w04_conflicts", "SELECT c_custkey AS id, 'range' AS side, 'kg:Team' AS known, 'kg:Place' AS new FROM customer WHERE c_custkey % 2 = 1")
def w04(spark, d):
    o = example_ontology(spark)
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), iri("player", "c_custkey").alias("s"), F.lit("kg:birthPlace").alias("p"), F.when(F.expr("c_custkey % 2 = 0"), iri("province", "c_nationkey")).otherwise("kg:club/1").alias("o"))
    types = graph(spark, d).where(F.col("p") == TYPE).select("s", F.col("o").alias("cls"))
    return V.conflicts(p, types, o.prop, o.sub_class, o.disjoint)
