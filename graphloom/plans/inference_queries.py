"""Inference, data-quality and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import inference as R
from graphloom.operators import quality as Q
from graphloom.operators import stats as D
from graphloom.operators.closure import closure, held
from graphloom.operators.goals import Rules, ask_edges, ask_members
from graphloom.plans.registry import query
from graphloom.sources.tables import LABEL, TYPE, graph, iri, table


def _facts(spark, d):
    return R.skeleton(graph(spark, d), "kg:")


def _given(spark, d):
    """The asserted triples; a goal's filter on p leaves only the branches that it needs."""
    return graph(spark, d).select(*R.FACT)


def _rules(spark):
    return Rules(R.example_ontology(spark))


def _all(spark, d, semantics="owl"):
    return R.inferred(_facts(spark, d), R.example_ontology(spark), semantics=semantics)


_STATION = "CASE o_orderstatus WHEN 'F' THEN 'kg:ClubStation' WHEN 'O' THEN 'kg:YouthStation' ELSE 'kg:NationalTeamStation' END"
_CLUB = "(SELECT DISTINCT l_suppkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"
_NAT = "(SELECT DISTINCT l_suppkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')"
_NATP = "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')"
_PLAYED = "(SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_TEAM = "(SELECT DISTINCT l_suppkey FROM lineitem)"
#: All inferred facts of the derived graph, written out rule by rule.
INFERRED = f"""
WITH f AS (
 SELECT 'kg:player/' || o_custkey AS s, 'kg:playedFor' AS p, 'kg:club/' || l_suppkey AS o FROM {_PLAYED}
 UNION SELECT 'kg:club/' || l_suppkey, 'kg:hasPlayer', 'kg:player/' || o_custkey FROM {_PLAYED}
 UNION SELECT 'kg:province/' || (n_nationkey // 2), 'kg:predecessor', 'kg:province/' || n_nationkey FROM nation WHERE n_nationkey % 3 = 2
 UNION SELECT 'kg:player/' || c_custkey, 'kg:birthPlace', 'kg:province/' || c_nationkey FROM customer
 UNION SELECT 'kg:club/' || s_suppkey, 'kg:locatedIn', 'kg:province/' || s_nationkey FROM supplier
 UNION SELECT 'kg:stadium/' || p_partkey, 'kg:locatedIn', 'kg:province/' || (p_partkey % 25) FROM part
 UNION SELECT 'kg:player/' || c_custkey, 'rdf:type', c FROM customer, (VALUES ('kg:Athlete'), ('kg:Person'), ('up:Agent')) t(c)
 UNION SELECT 'kg:player/' || k, 'rdf:type', 'kg:NationalTeamPlayer' FROM {_NATP}
 UNION SELECT 'kg:club/' || s_suppkey, 'rdf:type', c FROM supplier, (VALUES ('kg:Team'), ('up:Agent')) t(c)
 UNION SELECT 'kg:club/' || k, 'rdf:type', 'kg:NationalTeam' FROM {_NAT}
 UNION SELECT 'kg:station/' || o_orderkey, 'rdf:type', 'kg:CareerStation' FROM orders
 UNION SELECT 'kg:province/' || n_nationkey, 'rdf:type', 'kg:Place' FROM nation
 UNION SELECT 'kg:country/' || r_regionkey, 'rdf:type', 'kg:Place' FROM region
 UNION SELECT 'kg:stadium/' || p_partkey, 'rdf:type', 'kg:Place' FROM part)
"""


@query("r02_skeleton", "SELECT count(*) AS n, count(DISTINCT p) AS props FROM (SELECT 'rdf:type' AS p FROM region UNION ALL SELECT 'rdf:type' FROM nation UNION ALL SELECT 'kg:locatedIn' FROM nation UNION ALL SELECT unnest(['rdf:type', 'kg:successor']) FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT unnest(['rdf:type', 'kg:birthProvince']) FROM customer UNION ALL SELECT unnest(['kg:careerStation', 'rdf:type', 'kg:startYear']) FROM orders UNION ALL SELECT 'kg:team' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT unnest(['rdf:type', 'kg:province']) FROM supplier UNION ALL SELECT 'kg:ground' FROM (SELECT DISTINCT l_suppkey FROM lineitem) UNION ALL SELECT unnest(['rdf:type', 'kg:capacity', 'kg:province']) FROM part)")
def r02(spark, d):
    return _facts(spark, d).agg(F.count("*").alias("n"), F.countDistinct("p").alias("props"))


@query("r03_sub_class", "SELECT 'kg:player/' || c_custkey AS s, c AS o FROM customer, (VALUES ('kg:Athlete'), ('kg:Person'), ('up:Agent')) t(c)")
def r03(spark, d):
    f = _facts(spark, d).where("p = 'rdf:type' and o = 'kg:FootballPlayer'")
    return R.rule_sub_class(f, closure(R.example_ontology(spark).sub_class)).select("s", "o")


@query("r04_sub_property", "SELECT 'kg:player/' || c_custkey AS s, 'kg:birthPlace' AS p, 'kg:province/' || c_nationkey AS o FROM customer")
def r04(spark, d):
    f = _facts(spark, d).where("p = 'kg:birthProvince'")
    return R.rule_sub_property(f, closure(R.example_ontology(spark).sub_prop)).select("s", "p", "o")


@query("r05_domain", "SELECT DISTINCT 'kg:player/' || o_custkey AS s, 'kg:Athlete' AS o FROM orders")
def r05(spark, d):
    return R.rule_domain(_facts(spark, d).where("p = 'kg:careerStation'"), R.example_ontology(spark).prop).select("s", "o").distinct()


@query("r06_range", "SELECT DISTINCT 'kg:club/' || l_suppkey AS s, 'kg:Team' AS o FROM lineitem")
def r06(spark, d):
    return R.rule_range(_facts(spark, d).where("p in ('kg:team', 'kg:capacity')"), R.example_ontology(spark).prop).select("s", "o").distinct()


@query("r07_inverse", "SELECT 'kg:province/' || (n_nationkey // 2) AS s, 'kg:predecessor' AS p, 'kg:province/' || n_nationkey AS o FROM nation WHERE n_nationkey % 3 = 2")
def r07(spark, d):
    return R.rule_inverse(_facts(spark, d).where("p = 'kg:successor'"), R.example_ontology(spark).inverse).select("s", "p", "o")


@query("r08_chain_played_for", f"SELECT 'kg:player/' || o_custkey AS s, 'kg:club/' || l_suppkey AS o FROM {_PLAYED}")
def r08(spark, d):
    f = _facts(spark, d).where("p in ('kg:careerStation', 'kg:team')")
    return R.rule_chain(f, f, R.example_ontology(spark).chain).select("s", "o").distinct()


@query("r09_some_values", f"SELECT 'kg:player/' || k AS s FROM {_NATP}")
def r09(spark, d):
    f = _facts(spark, d).where("p in ('kg:careerStation', 'rdf:type')")
    return R.rule_some_values(f, f, R.example_ontology(spark).some_values).select("s").distinct()


@query("r10_all_values", f"SELECT 'kg:club/' || k AS s, 'kg:FootballClub' AS o FROM {_CLUB} UNION SELECT 'kg:club/' || k, 'kg:NationalTeam' FROM {_NAT}")
def r10(spark, d):
    f = _facts(spark, d).where("p in ('kg:team', 'rdf:type')")
    return R.rule_all_values(f, f, R.example_ontology(spark).all_values).select("s", "o").distinct()


@query("r11_disjointness", f"SELECT 'kg:club/' || k AS s, 'kg:FootballClub' AS a, 'kg:NationalTeam' AS b FROM {_NAT}")
def r11(spark, d):
    o = R.example_ontology(spark)
    f = _facts(spark, d).where("p in ('kg:team', 'rdf:type')")
    return R.disjointness(f.unionByName(R.rule_all_values(f, f, o.all_values)), o.disjoint)


@query("r14_rdfs_only", f"{INFERRED} SELECT p, count(*) AS n FROM f WHERE p NOT IN ('kg:playedFor', 'kg:hasPlayer', 'kg:predecessor') AND o NOT IN ('kg:NationalTeamPlayer', 'kg:NationalTeam') GROUP BY p")
def r14(spark, d):
    return _all(spark, d, "rdfs").groupBy("p").agg(F.count("*").alias("n"))


@query("r15_without_inference", "SELECT 0::BIGINT AS n")
def r15(spark, d):
    return _all(spark, d, "none").agg(F.count("*").alias("n"))


@query("r18_with_and_without_inference", f"SELECT count(*) AS full_rows, 0::BIGINT AS asserted_rows FROM {_PLAYED}")
def r18(spark, d):
    f = _facts(spark, d)
    asserted = f.where("p = 'kg:playedFor'").agg(F.count("*").alias("asserted_rows"))
    full = R.materialise(f.where("p in ('kg:careerStation', 'kg:team')"), R.example_ontology(spark)).where("p = 'kg:playedFor'").agg(F.count("*").alias("full_rows"))
    return full.crossJoin(F.broadcast(asserted))  # one row each


# ---- composite queries that need inference


@query("z01_entities_per_aligned_class", "SELECT 'up:Agent' AS cls, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'kg:Place', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM part)")
def z01(spark, d):
    return ask_members(_given(spark, d), _rules(spark), ["up:Agent", "kg:Place"]).groupBy("cls").agg(F.count("*").alias("n"))


@query("z15_who_played_for", f"SELECT 'kg:player/' || o_custkey AS player FROM {_PLAYED} WHERE l_suppkey = 3")
def z15(spark, d):
    return ask_edges(_given(spark, d), _rules(spark), "kg:playedFor", o=["kg:club/3"]).select(F.col("s").alias("player"))


@query("z16_in_two_disjoint_classes", f"SELECT 'kg:FootballClub' AS a, 'kg:NationalTeam' AS b, count(*) AS n FROM {_NAT}")
def z16(spark, d):
    o = R.example_ontology(spark)
    held = ask_members(_given(spark, d), _rules(spark), [r["cls"] for r in o.disjoint.select("cls").distinct().collect()])
    types = held.select("s", F.lit(TYPE).alias("p"), F.col("cls").alias("o"), F.lit("iri").alias("o_kind"))
    return R.disjointness(types, o.disjoint).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("z20_national_players_born_in", f"SELECT c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_4' AND c_custkey IN (SELECT k FROM {_NATP})")
def z20(spark, d):
    t = graph(spark, d)
    nat = r09(spark, d)
    born = t.where("p = 'kg:birthProvince'").select("s", F.col("o").alias("prov"))
    here = t.where("p = 'rdfs:label' and o = 'NATION_4'").select(F.col("s").alias("prov"))
    names = t.where("p = 'rdfs:label'").select("s", F.col("o").alias("name"))
    return nat.join(born, "s").join(here, "prov").join(names, "s").select("name")


@query("z32_inverse_of_chain_holds", f"SELECT count(*) > 0 AS answer FROM {_PLAYED} WHERE l_suppkey = 1")
def z32(spark, d):
    t, rules = _given(spark, d), _rules(spark)
    chain = ask_edges(t, rules, "kg:playedFor", o=["kg:club/1"]).select(F.col("s").alias("who"))
    back = ask_edges(t, rules, "kg:hasPlayer", s=["kg:club/1"]).select(F.col("o").alias("who"))
    return chain.join(back, "who", "full").agg((F.count("*") > 0).alias("answer"))


@query("z36_size_of_defined_class", f"SELECT count(*) AS n FROM {_NATP}")
def z36(spark, d):
    return ask_members(_given(spark, d), _rules(spark), ["kg:NationalTeamPlayer"]).agg(F.count("*").alias("n"))


# ---- quality


@query("q01_super_property_kind", "SELECT 'error' AS severity, 'super_property_kind' AS \"check\", 'kg:capacity' AS subject, 'kg:locatedIn' AS detail WHERE (SELECT count(*) FROM part) > 0")
def q01(spark, d):
    o = R.example_ontology(spark)
    bad = o.sub_prop.union(spark.createDataFrame([("kg:capacity", "kg:locatedIn")], "sub string, sup string"))
    used = graph(spark, d).select("p").distinct()
    return Q.super_property_kind(bad, o.prop).join(used.select(F.col("p").alias("subject")), "subject", "left_semi").select(*Q.ISSUE)


@query("q02_without_aligned_ancestor", "SELECT 'error' AS severity, 'no_aligned_ancestor' AS \"check\", c AS subject, '' AS detail FROM (VALUES ('kg:Country'), ('kg:Province'), ('kg:FormerProvince'), ('kg:Stadium'), ('kg:ClubStation'), ('kg:YouthStation'), ('kg:NationalTeamStation')) t(c) WHERE (SELECT count(*) FROM orders) > 0")
def q02(spark, d):
    used = graph(spark, d).where(F.col("p") == TYPE).select(F.col("o").alias("cls")).distinct()
    return Q.without_aligned_ancestor(used, R.example_ontology(spark).sub_class, "up:")


@query("q03_missing_labels", "SELECT 'error' AS severity, 'missing_label' AS \"check\", 'kg:document/' || doc_id AS subject, CASE WHEN lang = 'en' THEN 'fr' WHEN lang = 'fr' THEN 'en' ELSE 'en,fr' END AS detail FROM documents")
def q03(spark, d):
    labels = table(spark, d, "documents").select(iri("document", "doc_id").alias("term"), "lang")
    return Q.missing_labels(labels, ["en", "fr"])


@query("q04_property_kinds", "SELECT 'error' AS severity, 'property_kind' AS \"check\", 'kg:stadium/' || p_partkey AS subject, 'kg:capacity' AS detail FROM part WHERE p_partkey % 10 = 0")
def q04(spark, d):
    t = graph(spark, d).where("p = 'kg:capacity'")
    bad = t.withColumn("o_kind", F.when(F.expr("try_cast(split_part(s, '/', 2) as bigint) % 10 = 0"), "iri").otherwise(F.col("o_kind")))
    return Q.property_kinds(bad, R.example_ontology(spark).prop)


@query("q05_ill_typed_literals", "SELECT 'error' AS severity, 'ill_typed' AS \"check\", 'kg:order/' || o_orderkey AS subject, 'x' || CAST(year(o_orderdate) AS VARCHAR) AS detail FROM orders WHERE o_orderkey % 7 = 0")
def q05(spark, d):
    o = table(spark, d, "orders")
    t = o.select(iri("order", "o_orderkey").alias("s"), F.concat(F.when(F.expr("o_orderkey % 7 = 0"), "x").otherwise(""), F.year("o_orderdate")).alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:gYear").alias("dt"))
    return Q.ill_typed(t)


@query("q06_datatype_against_range", "SELECT 'error' AS severity, 'datatype_range' AS \"check\", 'kg:stadium/' || p_partkey AS subject, 'kg:capacity xsd:string' AS detail FROM part WHERE p_partkey % 9 = 0")
def q06(spark, d):
    t = graph(spark, d).where("p = 'kg:capacity'")
    t = t.withColumn("dt", F.when(F.expr("try_cast(split_part(s, '/', 2) as bigint) % 9 = 0"), "xsd:string").otherwise(F.col("dt")))
    return Q.datatype_range(t, R.example_ontology(spark).prop)


@query("q07_one_main_class", "SELECT 'error' AS severity, 'main_class' AS \"check\", 'kg:province/' || n_nationkey AS subject, '2' AS detail FROM nation WHERE n_nationkey % 3 = 2")
def q07(spark, d):
    return Q.one_main_class(graph(spark, d), ["kg:Province", "kg:FormerProvince", "kg:FootballPlayer", "kg:FootballClub", "kg:Stadium", "kg:Country"])


@query("q08_required_properties", "SELECT 'error' AS severity, 'required' AS \"check\", 'kg:club/' || s_suppkey AS subject, 'kg:ground' AS detail FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1)")
def q08(spark, d):
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select(iri("club", "l_suppkey").alias("s"), F.lit("kg:ground").alias("p"), F.lit("x").alias("o"))
    t = graph(spark, d).where("p in ('rdf:type', 'rdfs:label')").select("s", "p", "o").union(lines)
    return Q.required(t, {"kg:FootballClub": {"rdfs:label": "error", "kg:ground": "error"}})


@query("q09_functional_properties", "SELECT 'error' AS severity, 'functional' AS \"check\", 'kg:player/' || o_custkey AS subject, 'kg:startYear ' || array_to_string(list_sort(list(DISTINCT CAST(year(o_orderdate) AS VARCHAR)))[1:3], ',') AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) > 1")
def q09(spark, d):
    t = table(spark, d, "orders").select(iri("player", "o_custkey").alias("s"), F.lit("kg:startYear").alias("p"), F.year("o_orderdate").cast("string").alias("o"))
    return Q.functional(t, R.example_ontology(spark).prop)


@query("q10_object_ranges", "SELECT 'error' AS severity, 'object_range' AS \"check\", 'kg:player/' || c_custkey AS subject, 'kg:birthProvince kg:country/' || (c_custkey % 5) AS detail FROM customer WHERE c_custkey % 11 = 0")
def q10(spark, d):
    t = graph(spark, d).where("p in ('rdf:type', 'kg:birthProvince')").select("s", "p", "o", "o_kind")
    wrong = F.expr("p = 'kg:birthProvince' and try_cast(split_part(s, '/', 2) as bigint) % 11 = 0")
    t = t.withColumn("o", F.when(wrong, F.expr("concat('kg:country/', try_cast(split_part(s, '/', 2) as bigint) % 5)")).otherwise(F.col("o")))
    return Q.object_ranges(t, R.example_ontology(spark))


@query("q11_same_as_lists", "SELECT 'error' AS severity, 'same_as_list' AS \"check\", 'kg:page/' || page_id AS subject, 'List_of_' || url AS detail FROM pages WHERE page_id % 5 = 0")
def q11(spark, d):
    t = table(spark, d, "pages").select(iri("page", "page_id").alias("s"), F.lit("owl:sameAs").alias("p"), F.concat(F.when(F.expr("page_id % 5 = 0"), "List_of_").otherwise(""), "url").alias("o"))
    return Q.same_as_lists(t, ["List_of_", "(disambiguation)"])


@query("q12_shared_same_as", "SELECT 'error' AS severity, 'same_as_shared' AS \"check\", p_name AS subject, CAST(count(*) AS VARCHAR) AS detail FROM part GROUP BY p_name HAVING count(*) > 1")
def q12(spark, d):
    t = table(spark, d, "part").select(iri("stadium", "p_partkey").alias("s"), F.lit("owl:sameAs").alias("p"), F.col("p_name").alias("o"))
    return Q.same_as_shared(t)


@query("q13_bounding_box", "SELECT 'warning' AS severity, 'coordinates' AS \"check\", 'kg:player/' || c_custkey AS subject, CAST(c_custkey % 40 AS VARCHAR) || ',' || CAST(95 + c_custkey % 30 AS VARCHAR) AS detail FROM customer WHERE NOT (c_custkey % 40 BETWEEN 8 AND 24 AND 95 + c_custkey % 30 BETWEEN 102 AND 118)")
def q13(spark, d):
    p = table(spark, d, "customer").select(iri("player", "c_custkey").alias("s"), F.expr("c_custkey % 40").alias("lat"), F.expr("95 + c_custkey % 30").alias("lon"))
    return Q.bounding_box(p, (8, 24), (102, 118))


@query("q14_plausible_years", "SELECT 'warning' AS severity, 'year' AS \"check\", 'kg:station/' || o_orderkey AS subject, CAST(year(o_orderdate) AS VARCHAR) AS detail FROM orders WHERE NOT year(o_orderdate) BETWEEN 1993 AND 1997")
def q14(spark, d):
    t = graph(spark, d).where("p = 'kg:startYear'")
    return Q.plausible_years(t, 1993, 1997)


@query("q15_value_ranges", "SELECT 'warning' AS severity, 'value_range' AS \"check\", 'kg:stadium/' || p_partkey AS subject, 'kg:capacity ' || p_size AS detail FROM part WHERE NOT p_size BETWEEN 5 AND 45")
def q15(spark, d):
    return Q.value_ranges(graph(spark, d).where("p = 'kg:capacity'"), spark.createDataFrame([("kg:capacity", 5.0, 45.0)], "p string, lo double, hi double"))


@query("q16_summary", "WITH i AS (SELECT 'warning' AS severity, 'value_range' AS c FROM part WHERE NOT p_size BETWEEN 5 AND 45 UNION ALL SELECT 'warning', 'year' FROM orders WHERE NOT year(o_orderdate) BETWEEN 1993 AND 1997 UNION ALL SELECT 'error', 'main_class' FROM nation WHERE n_nationkey % 3 = 2) SELECT severity, c AS \"check\", count(*) AS n FROM i GROUP BY ROLLUP(severity, c)")
def q16(spark, d):
    return Q.summary(q15(spark, d), q14(spark, d), q07(spark, d))


@query("q17_inconsistency_issues", f"SELECT 'error' AS severity, 'disjoint' AS \"check\", 'kg:club/' || k AS subject, 'kg:FootballClub kg:NationalTeam' AS detail FROM {_NAT}")
def q17(spark, d):
    return Q.disjoint_issues(r11(spark, d))


# ---- statistics


@query("d01_members_per_class", f"SELECT 'kg:FootballPlayer' AS cls, count(*) AS n FROM customer UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier UNION ALL SELECT 'kg:Province', count(*) FROM nation UNION ALL SELECT 'kg:FormerProvince', count(*) FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 'kg:Country', count(*) FROM region UNION ALL SELECT 'kg:Stadium', count(*) FROM part UNION ALL SELECT {_STATION}, count(*) FROM orders GROUP BY o_orderstatus")
def d01(spark, d):
    return D.class_counts(graph(spark, d))


@query("d02_links_by_namespace", "SELECT count(CASE WHEN url LIKE 'https:%' THEN 1 END) AS secure, count(CASE WHEN url LIKE 'http:%' THEN 1 END) AS plain FROM pages")
def d02(spark, d):
    t = table(spark, d, "pages").select(F.lit("owl:sameAs").alias("p"), F.col("url").alias("o"))
    return D.link_counts(t, {"secure": "https:", "plain": "http:"})


@query("d04_stations", "SELECT count(*) AS stations FROM orders")
def d04(spark, d):
    return graph(spark, d).where((F.col("p") == TYPE) & F.col("o").endswith("Station")).agg(F.countDistinct("s").alias("stations"))


@query("d05_languages", "SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents")
def d05(spark, d):
    return D.languages(table(spark, d, "documents"))


@query("d06_data_set_description", "SELECT 'kg:dataset' AS s, 'void:classPartition' AS p, c || ' ' || n AS o FROM (SELECT 'kg:FootballPlayer' AS c, count(*) AS n FROM customer UNION ALL SELECT 'kg:FootballClub', count(*) FROM supplier UNION ALL SELECT 'kg:Country', count(*) FROM region UNION ALL SELECT 'kg:Stadium', count(*) FROM part) UNION ALL SELECT 'kg:dataset', 'void:linkset', 'https: ' || count(*) FROM pages WHERE url LIKE 'https:%'")
def d06(spark, d):
    counts = d01(spark, d).where("cls in ('kg:FootballPlayer', 'kg:FootballClub', 'kg:Country', 'kg:Stadium')")
    return D.description("kg:dataset", counts, table(spark, d, "pages").where("url like 'https:%'").agg(F.lit("https:").alias("target"), F.count("*").alias("n")))


@query("d07_schema_profile", "SELECT 'kg:Stadium' AS cls, 'kg:capacity' AS p, count(*) AS n, min(CAST(p_size AS VARCHAR)) AS example FROM part UNION ALL SELECT 'kg:Stadium', 'kg:province', count(*), min('kg:province/' || (p_partkey % 25)) FROM part UNION ALL SELECT 'kg:Stadium', 'rdfs:label', count(*), min(p_name) FROM part UNION ALL SELECT 'kg:FootballPlayer', 'rdfs:label', count(*), min(c_name) FROM customer UNION ALL SELECT 'kg:FootballPlayer', 'kg:birthProvince', count(*), min('kg:province/' || c_nationkey) FROM customer UNION ALL SELECT 'kg:FootballPlayer', 'kg:careerStation', count(*), min('kg:station/' || o_orderkey) FROM orders")
def d07(spark, d):
    return D.schema_profile(graph(spark, d), ["kg:Stadium", "kg:FootballPlayer"])


@query("d08_overview", "SELECT (SELECT count(*) FROM customer) AS players, (SELECT count(*) FROM supplier) AS clubs, (SELECT count(*) FROM orders) AS stations, (SELECT count(DISTINCT lang) FROM documents) AS languages")
def d08(spark, d):
    t = graph(spark, d).where(F.col("p") == TYPE)
    one = t.agg(F.count_if(F.col("o") == "kg:FootballPlayer").alias("players"), F.count_if(F.col("o") == "kg:FootballClub").alias("clubs"), F.count_if(F.col("o").endswith("Station")).alias("stations"))
    return one.crossJoin(F.broadcast(table(spark, d, "documents").agg(F.countDistinct("lang").alias("languages"))))  # one row each
