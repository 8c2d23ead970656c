"""More composite graph queries, producers of triples, and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import terms as N
from graphloom.operators import fusion as M
from graphloom.operators import patterns as G
from graphloom.operators.closure import closure
from graphloom.operators.inference import example_ontology
from graphloom.plans.registry import query
from graphloom.sources.tables import LABEL, TYPE, graph, iri, table

_GROUND = "(SELECT l_suppkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_suppkey)"


@query("z06_main_of_alternative_name", "SELECT 'NATION_5' AS alternative, n_name AS name FROM nation WHERE n_nationkey = 2")
def z06(spark, d):
    t = graph(spark, d)
    old = G.pattern(t, "?p", LABEL, "NATION_5").distinct()
    x = G.natural(old, G.bgp(t, ("?p", "kg:successor", "?q"), ("?q", LABEL, "?name")))
    return x.select(F.lit("NATION_5").alias("alternative"), "name")


@query("z08_clubs_with_links", "SELECT 'kg:page/' || page_id AS page, url FROM pages WHERE url LIKE 'https:%' ORDER BY page LIMIT 20")
def z08(spark, d):
    t = table(spark, d, "pages").select(iri("page", "page_id").alias("s"), F.lit("owl:sameAs").alias("p"), F.col("url").alias("o"))
    return G.pattern(t, "?page", "owl:sameAs", "?url").where(F.col("url").startswith("https:")).orderBy("page").limit(20)


@query("z09_facts_of_one_subject", "SELECT 'rdf:type' AS p, 'kg:Province' AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'rdfs:label', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'kg:locatedIn', 'kg:country/' || n_regionkey FROM nation WHERE n_nationkey = 3")
def z09(spark, d):
    return G.pattern(graph(spark, d), "kg:province/3", "?p", "?o")


@query("z10_labelled_own_facts", "SELECT 'kg:locatedIn' AS p, r_name AS label FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3")
def z10(spark, d):
    t = graph(spark, d)
    x = G.pattern(t, "kg:province/3", "?p", "?o").where(F.col("p").startswith("kg:") & ~F.col("p").isin("kg:successor", "kg:predecessor"))
    return G.natural(x, G.pattern(t, "?o", LABEL, "?label")).select("p", "label")


@query("z11_career_with_subclasses", "SELECT 'kg:station/' || o_orderkey AS st, CAST(year(o_orderdate) AS BIGINT) AS start FROM orders WHERE o_custkey = 7")
def z11(spark, d):
    t = graph(spark, d)
    under = closure(example_ontology(spark).sub_class).where("sup = 'kg:CareerStation'").select(F.col("sub").alias("cls"))
    st = G.natural(G.bgp(t, ("kg:player/7", "kg:careerStation", "?st"), ("?st", TYPE, "?cls")), F.broadcast(under))
    return G.optional(st, G.pattern(t, "?st", "kg:startYear", "?y")).select("st", F.col("y").try_cast("long").alias("start"))


@query("z17_club_career_by_name", "SELECT DISTINCT c_name AS name, s_name AS club FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' AND c_custkey % 50 = 3")
def z17(spark, d):
    t = graph(spark, d)
    who = G.pattern(t, "?p", LABEL, "?name").where(F.col("p").startswith("kg:player/") & (F.element_at(F.split("p", "/"), -1).try_cast("long") % 50 == 3)).distinct()
    x = G.natural(who, G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", TYPE, "kg:ClubStation"), ("?st", "kg:team", "?c"), ("?c", LABEL, "?club")))
    return x.select("name", "club").distinct()


@query("z17_club_career_of_every_player", "SELECT DISTINCT 'kg:player/' || c_custkey AS p, c_name AS name, s_name AS club FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F'")
def z17_all(spark, d):
    t = graph(spark, d)
    who = G.pattern(t, "?p", LABEL, "?name").where(F.col("p").startswith("kg:player/")).distinct()
    x = G.natural(who, G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", TYPE, "kg:ClubStation"), ("?st", "kg:team", "?c"), ("?c", LABEL, "?club")))
    return x.select("p", "name", "club").distinct()


@query("z22_facts_of_one_entity", "SELECT s_name AS name, n_name AS prov, p_name AS ground FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN " + _GROUND + " ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = pk WHERE s_suppkey = 3")
def z22(spark, d):
    t = graph(spark, d)
    one = G.pattern(t, "?c", LABEL, "?name").where("c = 'kg:club/3'").distinct()
    x = G.natural(one, G.bgp(t, ("?c", "kg:province", "?p"), ("?p", LABEL, "?prov")))
    return G.optional(x, G.bgp(t, ("?c", "kg:ground", "?g"), ("?g", LABEL, "?ground"))).select("name", "prov", "ground")


_EVER = "SELECT DISTINCT c_name AS player FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = {}"


def _ever_played(spark, d, club):
    t = graph(spark, d)
    clubs = G.pattern(t, "?c", [LABEL, "skos:altLabel"], "?n").where(F.col("c").startswith("kg:club/"))
    clubs = clubs.where(club).select("c").distinct()
    x = G.natural(clubs, G.bgp(t, ("?st", "kg:team", "?c"), ("?p", "kg:careerStation", "?st"), ("?p", LABEL, "?player")))
    return x.select("player").distinct()


@query("z23_ever_played_for_exact", _EVER.format("(SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1)"))
def z23(spark, d):
    first = table(spark, d, "supplier").orderBy("s_suppkey").first()["s_name"]  # one name
    return _ever_played(spark, d, F.col("n") == first)


@query("z24_ever_played_for_contained", "SELECT DISTINCT c_name AS player FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '5')")
def z24(spark, d):
    return _ever_played(spark, d, F.contains(F.lower("n"), F.lit("5")))


@query("z26_clubs_with_ground_in", f"SELECT DISTINCT s_name AS club FROM {_GROUND} JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = pk WHERE p_partkey % 25 < 12")
def z26(spark, d):
    t = graph(spark, d)
    where = G.pattern(t, "?p", TYPE, "kg:Province").where(F.element_at(F.split("p", "/"), -1).try_cast("int") < 12).distinct()
    return G.natural(where, G.bgp(t, ("?s", "kg:province", "?p"), ("?c", "kg:ground", "?s"), ("?c", LABEL, "?club"))).select("club").distinct()


@query("z27_earliest_in_province", "SELECT 'kg:province/' || c_nationkey AS prov, 'kg:player/' || c_custkey AS first FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s, 'kg:player/' || c_custkey) AS k FROM (SELECT c_nationkey, c_custkey, min(year(o_orderdate)) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE k = 1")
def z27(spark, d):
    t = graph(spark, d)
    x = G.bgp(t, ("?p", "kg:careerStation", "?st"), ("?st", "kg:startYear", "?y"), ("?p", "kg:birthProvince", "?prov"))
    return x.groupBy("prov").agg(F.min(F.struct(F.col("y").try_cast("int"), "p")).alias("b")).select("prov", F.col("b.p").alias("first"))


@query("z29_links_in_two_namespaces", "SELECT page_id, CASE WHEN url LIKE 'http:%' THEN url END AS plain, CASE WHEN url LIKE 'https:%' THEN url END AS secure FROM pages")
def z29(spark, d):
    t = table(spark, d, "pages").select("page_id", F.lit("owl:sameAs").alias("p"), F.col("url").alias("o"))
    one = lambda ns, c: t.where(F.col("o").startswith(ns)).select("page_id", F.col("o").alias(c))
    return G.optional(G.optional(t.select("page_id"), one("http:", "plain")), one("https:", "secure"))


@query("z30_types_by_union", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def z30(spark, d):
    t = graph(spark, d)
    return G.union(G.pattern(t, "?a", TYPE, "kg:FootballPlayer"), G.pattern(t, "?b", TYPE, "kg:FootballClub")).agg(F.count("*").alias("n"))


@query("z34_top_five_birth_provinces", "SELECT n_name AS label, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, label LIMIT 5")
def z34(spark, d):
    from graphloom.plans.graph_queries import birth_provinces

    return birth_provinces(graph(spark, d), 5)


@query("z37_current_and_one_successor", "SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 3 <> 2) AS n, true AS answer FROM region LIMIT 1")
def z37(spark, d):
    t = graph(spark, d)
    n = G.not_exists(G.pattern(t, "?p", TYPE, "kg:Province"), G.pattern(t, "?p", TYPE, "kg:FormerProvince")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(G.ask(t.where("s = 'kg:province/5' and p = 'kg:successor' and o = 'kg:province/2'"))))  # one row each


@query("z38_redirect_exists", "SELECT count(*) > 0 AS answer FROM nation WHERE n_nationkey = 8")
def z38(spark, d):
    t = graph(spark, d)
    return G.ask(G.bgp(t, ("?p", LABEL, "NATION_8"), ("?p", "kg:successor", "?q"), ("?q", LABEL, "NATION_4")))


@query("z39_link_and_count", "SELECT count(*) AS clubs, bool_or(s_suppkey = 1) AS known FROM supplier")
def z39(spark, d):
    return G.pattern(graph(spark, d), "?c", TYPE, "kg:FootballClub").agg(F.count("*").alias("clubs"), F.bool_or(F.col("c") == "kg:club/1").alias("known"))


# ---- producers


@query("m08_provinces_of_places", "SELECT DISTINCT 'kg:stadium/' || p_partkey AS place, 'kg:province/' || (p_partkey % 25) AS province FROM part WHERE p_partkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def m08(spark, d):
    edges = table(spark, d, "part").select(iri("stadium", "p_partkey").alias("place"), iri("province", F.expr("p_partkey % 25")).alias("province"))
    seeds = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(iri("province", "n_nationkey").alias("province"))
    return edges.join(seeds, "province").select("place", "province").distinct()


@query("m11_category_triples", "SELECT DISTINCT 'kg:stadium/' || p_partkey AS s, 'dct:subject' AS p, 'kg:category/' || p_brand AS o FROM part UNION SELECT DISTINCT 'kg:category/' || p_brand, 'rdf:type', 'skos:Concept' FROM part UNION SELECT DISTINCT 'kg:category/' || p_brand, 'rdfs:label', p_brand FROM part")
def m11(spark, d):
    p = table(spark, d, "part").select(iri("stadium", "p_partkey").alias("s"), iri("category", "p_brand").alias("c"), "p_brand")
    return G.construct(p, (F.col("s"), F.lit("dct:subject"), F.col("c")), (F.col("c"), F.lit(TYPE), F.lit("skos:Concept")), (F.col("c"), F.lit(LABEL), F.col("p_brand")))


@query("m12_redirect_triples", "SELECT 'kg:' || n_name AS s, 'kg:redirectsTo' AS p, 'kg:NATION_' || (n_nationkey // 2) AS o FROM nation WHERE n_nationkey <> n_nationkey // 2")
def m12(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("kg:"), "n_name").alias("s"), F.concat(F.lit("kg:NATION_"), F.expr("n_nationkey div 2")).alias("o"))
    return G.construct(n.where("s <> o"), (F.col("s"), F.lit("kg:redirectsTo"), F.col("o")))


@query("m13_external_links", "SELECT user_id AS s, 'https://x.example/' || event_id AS o FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 30 AND event_id % 5 <> 0")
def m13(spark, d):
    url = lambda e: F.when(e % 5 == 0, F.concat(F.lit("bad url "), e)).otherwise(F.concat(F.lit("https://x.example/"), e))
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("s")).agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 30).alias("e"))
    return per.select("s", F.explode("e").alias("e")).select("s", N.safe_iri(url(F.col("e"))).alias("o")).where("o is not null")


@query("m15_country_links", "SELECT 'kg:stadium/' || p_partkey AS s, 'kg:country' AS p, 'kg:country/0' AS o FROM part UNION ALL SELECT 'kg:club/' || s_suppkey, 'kg:country', 'kg:country/0' FROM supplier")
def m15(spark, d):
    t = graph(spark, d).where("p = 'rdf:type' and o in ('kg:Stadium', 'kg:FootballClub', 'kg:FootballPlayer', 'kg:Province')")
    return G.construct(t.where(~F.col("o").isin("kg:FootballPlayer", "kg:Province")), (F.col("s"), F.lit("kg:country"), F.lit("kg:country/0")))


@query("m16_founding", "SELECT o_orderkey AS s, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS founded, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def m16(spark, d):
    raw = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    v = N.time_value(raw, F.when(F.expr("o_orderkey % 2 = 0"), "11").otherwise("9"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("s"), F.when(v["precision"] == "date", v["value"]).alias("founded"), N.leading_year(v["value"]).alias("year"))


@query("m17_homepage", "SELECT page_id AS s, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://own.example/' || page_id END AS o FROM pages")
def m17(spark, d):
    box = F.when(F.expr("page_id % 2 = 1"), F.concat(F.lit("https://own.example/"), "page_id"))
    return table(spark, d, "pages").select(F.col("page_id").alias("s"), N.safe_iri(M.pick(box, F.col("url"), F.lit(True))).alias("o"))


@query("m18_location_split", "SELECT 'kg:club/' || s_suppkey AS s, CASE WHEN s_nationkey % 3 = 0 THEN 'kg:province' ELSE 'kg:locatedIn' END AS p, 'kg:province/' || s_nationkey AS o FROM supplier")
def m18(spark, d):
    known = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(iri("province", "n_nationkey").alias("o"), F.lit(True).alias("hit"))
    x = table(spark, d, "supplier").select(iri("club", "s_suppkey").alias("s"), iri("province", "s_nationkey").alias("o")).join(known, "o", "left")
    return x.select("s", F.when(F.col("hit"), "kg:province").otherwise("kg:locatedIn").alias("p"), "o")


@query("m19_quantities", "SELECT s_suppkey AS s, CAST(round_even(s_acctbal / 2, 0) AS BIGINT) AS value FROM supplier WHERE round_even(s_acctbal / 2, 0) >= 0")
def m19(spark, d):
    v = F.bround(F.col("s_acctbal") / 2, 0).cast("long")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), v.alias("value")).where("value >= 0")


@query("m24_station_triples", "SELECT 'kg:station/' || o_orderkey AS s, 'rdfs:label' AS p, c_name || ' (' || year(o_orderdate) || ')' AS o FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'kg:station/' || o_orderkey, 'kg:onLoan', 'true' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 = 0")
def m24(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.select(iri("station", "o_orderkey").alias("s"), F.format_string("%s (%d)", "c_name", F.year("o_orderdate")).alias("l"), F.when(F.expr("o_orderkey % 4 = 0"), "true").alias("loan"))
    return G.construct(x, (F.col("s"), F.lit(LABEL), F.col("l")), (F.col("s"), F.lit("kg:onLoan"), F.col("loan")))


# ---- views and requests


@query("a01_located_entities", "SELECT 'kg:player/' || c_custkey AS s, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 END, c_nationkey)::BIGINT AS lat, c_nationkey % 3 = 2 AS former FROM customer")
def a01(spark, d):
    c = table(spark, d, "customer")
    own = c.where("c_custkey % 3 = 0").select("c_custkey", F.expr("c_custkey % 90").alias("own"))
    former = table(spark, d, "nation").where("n_nationkey % 3 = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("f"))
    x = c.join(own, "c_custkey", "left").join(former, "c_nationkey", "left")
    return x.select(iri("player", "c_custkey").alias("s"), F.coalesce("own", "c_nationkey").cast("long").alias("lat"), F.coalesce("f", F.lit(False)).alias("former"))


@query("a03_successions_on_the_map", "SELECT 'kg:province/' || n_nationkey AS a, 'kg:province/' || (n_nationkey // 2) AS b, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 2) AS total FROM nation WHERE n_nationkey % 3 = 2 AND n_nationkey // 2 < 6")
def a03(spark, d):
    t = graph(spark, d).where("p = 'kg:successor'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    on_map = table(spark, d, "nation").where("n_nationkey < 6").select(iri("province", "n_nationkey").alias("b"))
    return t.join(on_map, "b", "left_semi").crossJoin(F.broadcast(t.agg(F.count("*").alias("total")))).select("a", "b", "total")  # one row


@query("b10_side_quota", "SELECT o_custkey AS node, least(o, greatest(6 - i, 3)) AS shown_out, least(i, greatest(6 - o, 3)) AS shown_in, o + i - least(o, greatest(6 - i, 3)) - least(i, greatest(6 - o, 3)) AS hidden FROM (SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS o, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS i FROM orders GROUP BY o_custkey)")
def b10(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("o"), F.count_if(F.col("o_orderstatus") != "F").alias("i"))
    out, into = F.least("o", F.greatest(6 - F.col("i"), F.lit(3))), F.least("i", F.greatest(6 - F.col("o"), F.lit(3)))
    return per.select("node", out.alias("shown_out"), into.alias("shown_in"), (F.col("o") + F.col("i") - out - into).alias("hidden"))


@query("b17_tree_station_order", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, year(o_orderdate), o_orderkey) AS stations FROM orders GROUP BY o_custkey")
def b17(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    items = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.year("o_orderdate").alias("y"), "o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["o_orderkey"].cast("string")), ",").alias("stations"))


@query("u04_span_guards", "SELECT p_name AS name, count(*) AS candidates FROM part WHERE length(p_name) >= 3 GROUP BY p_name HAVING count(*) <= 6")
def u04(spark, d):
    return table(spark, d, "part").where(F.length("p_name") >= 3).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("candidates")).where("candidates <= 6")


@query("u06_exact_before_tail", "SELECT p_partkey AS qid, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'tail' END AS source FROM part")
def u06(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("qid"))
    exact = p.where("qid % 2 = 0").withColumn("e", F.lit("exact"))
    return p.join(exact, "qid", "left").join(p.withColumn("t", F.lit("tail")), "qid", "left").select("qid", F.coalesce("e", "t").alias("source"))


@query("u14_all_words_condition", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words FROM part")
def u14(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.explode(F.split(N.token_key(F.col("p_name")), " ")).alias("w"))
    return x.groupBy("p_partkey").agg(F.count("*").alias("words"))


@query("n07_resolved_names", "SELECT p_partkey, 'kg:stadium/' || p_partkey AS iri FROM part WHERE p_partkey % 2 = 0")
def n07(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.concat(F.when(F.expr("p_partkey % 2 = 0"), "kg:stadium/").otherwise("kg:none/"), "p_partkey").alias("c")), F.struct(F.lit(1).alias("r"), F.concat(F.lit("x:"), "p_partkey").alias("c")))).alias("k")).select("p_partkey", "k.*")
    known = graph(spark, d).where("s like 'kg:stadium/%'").select(F.col("s").alias("c")).distinct()
    return names.join(known, "c", "left_semi").groupBy("p_partkey").agg(F.min_by("c", "r").alias("iri"))


@query("h06_property_dictionary", "SELECT * FROM (VALUES ('kg:capacity', true, 'kg:Stadium'), ('kg:birthProvince', true, 'kg:Person'), ('kg:team', false, 'kg:CareerStation'), ('kg:ground', false, 'kg:Team'), ('kg:careerStation', false, 'kg:Athlete'), ('kg:startYear', true, 'kg:CareerStation'), ('kg:successor', false, 'kg:Province'), ('kg:province', false, NULL), ('kg:locatedIn', false, NULL)) t(p, functional, domain)")
def h06(spark, d):
    used = graph(spark, d).select("p").distinct()
    return used.join(F.broadcast(example_ontology(spark).prop), "p").select("p", "functional", "domain")
