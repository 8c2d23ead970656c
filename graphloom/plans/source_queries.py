"""Sources, sinks, entity selection and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import fusion as M
from graphloom.operators.closure import _folder, held
from graphloom.plans.registry import query
from graphloom.sources import landed, ntriples
from graphloom.sources.tables import TERMS, graph, iri, table


def _path(spark, name):
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _places(spark, d):
    return graph(spark, d).where("s like 'kg:province/%' or s like 'kg:country/%'")


_PLACES = """SELECT 'kg:country/' || r_regionkey AS s, 'rdf:type' AS p, 'kg:Country' AS o FROM region UNION ALL SELECT 'kg:country/' || r_regionkey, 'rdfs:label', r_name FROM region
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'rdf:type', 'kg:Province' FROM nation UNION ALL SELECT 'kg:province/' || n_nationkey, 'rdfs:label', n_name FROM nation
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'kg:locatedIn', 'kg:country/' || n_regionkey FROM nation
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'rdf:type', 'kg:FormerProvince' FROM nation WHERE n_nationkey % 3 = 2
 UNION ALL SELECT 'kg:province/' || n_nationkey, 'kg:successor', 'kg:province/' || (n_nationkey // 2) FROM nation WHERE n_nationkey % 3 = 2"""


@query("s01_json_object_rows", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s01(spark, d):
    return landed.json_rows(table(spark, d, "events").select("event_id", "props"), "props", "bigint")


@query("s02_json_lines_records", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n FROM pages")
def s02(spark, d):
    path = _path(spark, "records")
    table(spark, d, "pages").select("page_id", "url", F.struct("html").alias("body")).write.json(path)
    return spark.read.schema("page_id bigint, url string, body struct<html: string>").json(path).select("page_id", "url", F.length("body.html").cast("long").alias("n"))


@query("s03_ntriples_scan", "SELECT 'kg:document/' || doc_id AS s, sha256(text) AS digest, lang FROM documents")
def s03(spark, d):
    t = table(spark, d, "documents").select(F.lit("asserted").alias("part"), iri("document", "doc_id").alias("s"), F.lit("kg:abstract").alias("p"), F.col("text").alias("o"), F.lit("lit").alias("o_kind"), F.lit(None).cast("string").alias("dt"), "lang")
    path = _path(spark, "dump")
    ntriples.write(t, path)
    return ntriples.read(spark, path).select("s", F.sha2("o", 256).alias("digest"), "lang")


@query("s04_union_of_parts", f"SELECT count(*) AS n, count(DISTINCT s) AS subjects FROM ({_PLACES})")
def s04(spark, d):
    t = _places(spark, d)
    again = t.withColumn("part", F.lit("ontology"))
    return ntriples.union_parts(t, again).agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


@query("s07_newest_response", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def s07(spark, d):
    return landed.newest(table(spark, d, "events"), ["event_type", "user_id"], F.desc("ts"), F.desc("event_id")).select("event_type", "user_id", "event_id", "value")


@query("s08_missing_keys", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s08(spark, d):
    return landed.missing(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("s09_merged_pages", "SELECT o_orderkey AS title, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < 3 GROUP BY o_orderkey HAVING count(DISTINCT l_linenumber) = count(*)")
def s09(spark, d):
    pages = table(spark, d, "lineitem").where("l_linenumber < 3").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"), F.array(F.min("l_partkey")).alias("parts"))
    merged = landed.merge_pages(pages, "l_orderkey", "l_linenumber", ["parts"], [], ["c"])
    clean = pages.groupBy("l_orderkey").agg(F.max("c").alias("m")).where("m = 1")
    return merged.join(clean, "l_orderkey").select(F.col("l_orderkey").alias("title"), F.array_join("parts", ",").alias("parts"), F.size("parts").cast("long").alias("n"))


@query("s10_alias_resolution", "SELECT n_name AS title, 'NATION_' || CASE WHEN n_nationkey % 3 <> 2 THEN n_nationkey WHEN (n_nationkey // 2) % 3 <> 2 THEN n_nationkey // 2 ELSE n_nationkey // 4 END AS target FROM nation")
def s10(spark, d):
    n = table(spark, d, "nation")
    alias = n.where("n_nationkey % 3 = 2").select(F.col("n_name").alias("source"), F.expr("concat('NATION_', n_nationkey div 2)").alias("target"))
    return landed.resolve_aliases(n.select(F.col("n_name").alias("title")), alias)


@query("k01_ntriples_by_part", f"SELECT s, p, o FROM ({_PLACES})")
def k01(spark, d):
    path = _path(spark, "dump")
    ntriples.write(_places(spark, d), path)
    return ntriples.read(spark, path).where("part = 'asserted'").select("s", "p", "o")


@query("k02_files_by_group", "SELECT CASE WHEN n_nationkey % 3 = 2 THEN 'former' ELSE 'current' END AS grp, n_name FROM nation")
def k02(spark, d):
    path = _path(spark, "groups")
    table(spark, d, "nation").withColumn("grp", F.when(F.expr("n_nationkey % 3 = 2"), "former").otherwise("current")).write.partitionBy("grp").parquet(path)
    return spark.read.parquet(path).select("grp", "n_name")


@query("k03_round_trip_count", f"SELECT 'ok' AS state, count(*) AS written, count(*) AS read_back FROM ({_PLACES})")
def k03(spark, d):
    t, path = _places(spark, d), _path(spark, "dump")
    ntriples.write(t, path)
    both = t.agg(F.count("*").alias("written")).crossJoin(ntriples.read(spark, path).agg(F.count("*").alias("read_back")))  # one row each
    return both.select(F.when(F.col("written") == F.col("read_back"), "ok").otherwise("error").alias("state"), "written", "read_back")


@query("k04_statistics_json", "SELECT (SELECT count(*) FROM customer) AS players, (SELECT count(*) FROM supplier) AS clubs")
def k04(spark, d):
    path = _path(spark, "stats")
    one = table(spark, d, "customer").agg(F.count("*").alias("players")).crossJoin(table(spark, d, "supplier").agg(F.count("*").alias("clubs")))  # one row each
    one.write.json(path)
    return spark.read.schema("players bigint, clubs bigint").json(path)


@query("k05_report_json", "SELECT 'error' AS severity, 'main_class' AS \"check\", 'kg:province/' || n_nationkey AS subject FROM nation WHERE n_nationkey % 3 = 2")
def k05(spark, d):
    from graphloom.operators.quality import one_main_class

    path = _path(spark, "report")
    one_main_class(graph(spark, d), ["kg:Province", "kg:FormerProvince"]).write.json(path)
    return spark.read.schema("severity string, `check` string, subject string").json(path)


@query("k06_json_lines", "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def k06(spark, d):
    path = _path(spark, "lines")
    table(spark, d, "conversations").write.json(path)
    return spark.read.schema("conv_id bigint, turn bigint, role string, text string").json(path).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@query("k07_tabular_csv", "SELECT p_partkey, p_name, p_size FROM part")
def k07(spark, d):
    path = _path(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_size int").csv(path)


@query("k08_capped_with_total", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 100")
def k08(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey").orderBy("c_custkey").limit(100).crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))  # one row


@query("k09_cell_format", "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS cell FROM documents")
def k09(spark, d):
    raw = F.replace(F.replace("text", F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    cell = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.when(F.length(cell) > 40, F.concat(F.substring(cell, 1, 37), F.lit("..."))).otherwise(cell).alias("cell"))


_PREFIX = [("kg:", "https://kg.example/"), ("kgp:", "https://kg.example/prop/"), ("ext:", "https://ext.example/")]


@query("k10_prefixed_names", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'kgp:' || c_custkey WHEN 1 THEN 'kg:' || c_custkey ELSE 'https://other.example/' || c_custkey END AS name FROM customer")
def k10(spark, d):
    base = F.element_at(F.array(*[F.lit(x) for x in ("https://kg.example/prop/", "https://kg.example/", "https://other.example/")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    x = table(spark, d, "customer").select("c_custkey", F.concat(base, "c_custkey").alias("iri"))
    prefixes = spark.createDataFrame(_PREFIX, "prefix string, ns string")
    hit = x.join(F.broadcast(prefixes), F.col("iri").startswith(F.col("ns")), "left")
    best = hit.groupBy("c_custkey", "iri").agg(F.max(F.struct(F.length("ns").alias("n"), "prefix", "ns")).alias("b"))
    return best.select("c_custkey", F.when(F.col("b.ns").isNotNull(), F.concat("b.prefix", F.expr("substring(iri, length(b.ns) + 1)"))).otherwise(F.col("iri")).alias("name"))


@query("k11_expanded_names", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'https://kg.example/prop/' || c_custkey END AS iri FROM customer")
def k11(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.expr("c_custkey % 2 = 0"), "kgp:").otherwise("zz:"), "c_custkey").alias("name"))
    prefixes = spark.createDataFrame(_PREFIX, "prefix string, ns string")
    out = x.withColumn("prefix", F.concat(F.split_part("name", F.lit(":"), F.lit(1)), F.lit(":"))).join(F.broadcast(prefixes), "prefix", "left")
    return out.select("c_custkey", F.concat("ns", F.split_part("name", F.lit(":"), F.lit(2))).alias("iri"))


# ---- entity selection


@query("e01_by_class_or_subclass", "SELECT 'kg:station/' || o_orderkey AS s FROM orders WHERE o_orderpriority = '1-URGENT'")
def e01(spark, d):
    from graphloom.operators.closure import closure
    from graphloom.operators.inference import example_ontology

    under = closure(example_ontology(spark).sub_class, reflexive=True).where("sup = 'kg:CareerStation'").select(F.col("sub").alias("o"))
    typed = graph(spark, d).where("p = 'rdf:type'").join(F.broadcast(under), "o").select("s")
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(iri("station", "o_orderkey").alias("s"))
    return typed.join(urgent, "s")


@query("e02_without_excluded_types", "SELECT 'kg:province/' || n_nationkey AS s FROM nation WHERE n_nationkey % 3 <> 2")
def e02(spark, d):
    t = graph(spark, d).where("p = 'rdf:type'")
    return t.where("o = 'kg:Province'").select("s").join(t.where("o = 'kg:FormerProvince'").select("s"), "s", "left_anti")


@query("e03_required_and_optional_titles", "SELECT c_custkey, c_name AS title, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS english FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def e03(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    local = o.select(F.col("o_custkey").alias("c_custkey")).distinct()
    english = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("english"))
    return c.join(local, "c_custkey").join(english, "c_custkey", "left").select("c_custkey", F.col("c_name").alias("title"), "english")


@query("e04_titles_by_prefix", "SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 'a')")
def e04(spark, d):
    return table(spark, d, "part").where(~F.col("p_name").startswith("a")).select("p_partkey")


_RANKED = "SELECT DISTINCT l_suppkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query("e05_one_class_per_entity", f"SELECT l_suppkey, max(CASE WHEN k = 1 THEN o_orderstatus END) AS cls, CAST(count(*) - 1 AS BIGINT) AS conflicts FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY r) AS k FROM ({_RANKED})) GROUP BY l_suppkey")
def e05(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_suppkey", "o_orderstatus").distinct()
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return both.groupBy("l_suppkey").agg(F.min_by("o_orderstatus", rank).alias("cls"), (F.count("*") - 1).alias("conflicts"))


@query("e06_dated_facts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS value FROM orders WHERE o_orderpriority <> '5-LOW'")
def e06(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW' and o_orderdate is not null").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("value"))


@query("e07_quantities", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_quantity * 1000 ELSE l_quantity END AS value, CASE WHEN l_linestatus = 'O' THEN CAST(year(l_shipdate) AS BIGINT) END AS pit FROM lineitem")
def e07(spark, d):
    value = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"), F.when(F.col("l_linestatus") == "O", F.year("l_shipdate").cast("long")).alias("pit"))


@query("e08_qualifiers", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS q1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS q2 FROM lineitem GROUP BY l_orderkey")
def e08(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2]).agg(F.max("l_quantity"))
    return q.select("l_orderkey", F.col("1").alias("q1"), F.col("2").alias("q2"))


@query("e09_property_whitelist", "SELECT event_id, event_type FROM events WHERE (event_type = 'click' AND user_id % 2 = 0) OR (event_type = 'view')")
def e09(spark, d):
    allowed = spark.createDataFrame([("even", "click"), ("even", "view"), ("odd", "view")], "cls string, event_type string")
    e = table(spark, d, "events").withColumn("cls", F.when(F.expr("user_id % 2 = 0"), "even").otherwise("odd"))
    return e.join(F.broadcast(allowed), ["cls", "event_type"]).select("event_id", "event_type")


@query("e10_nested_statements", "SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS statements FROM events GROUP BY user_id, event_type")
def e10(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    nested = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return nested.select("user_id", F.explode("m").alias("event_type", "v")).select("user_id", "event_type", F.array_join("v", ",").alias("statements"))


@query("e11_referenced_ids", "SELECT DISTINCT 'Q' || user_id AS ref FROM events WHERE event_id % 2 = 0")
def e11(spark, d):
    raw = F.when(F.expr("event_id % 2 = 0"), F.concat(F.lit("http://x/Q"), "user_id")).otherwise(F.concat(F.lit("text "), "user_id"))
    return table(spark, d, "events").select(raw.alias("v")).where(F.col("v").startswith("http://x/Q")).select(F.regexp_extract("v", r"(Q\d+)$", 1).alias("ref")).distinct()


@query("e12_places_to_resolve", "SELECT 'kg:province/' || c_nationkey AS place FROM customer UNION SELECT 'kg:province/' || s_nationkey FROM supplier UNION SELECT 'kg:country/' || r_regionkey FROM region")
def e12(spark, d):
    t = graph(spark, d)
    a = t.where("p in ('kg:birthProvince', 'kg:province') and s not like 'kg:stadium/%'").select(F.col("o").alias("place"))
    return a.union(t.where("p = 'rdf:type' and o = 'kg:Country'").select("s")).distinct()


@query("e13_containing_provinces", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, r.b // 2 FROM r WHERE r.b % 3 = 2) SELECT 'kg:province/' || a AS place, string_agg('kg:province/' || b, ',' ORDER BY 'kg:province/' || b) AS provinces FROM r GROUP BY a")
def e13(spark, d):
    from graphloom.plans.graph_queries import h02

    return h02(spark, d).groupBy(F.col("sub").alias("place")).agg(F.array_join(F.array_sort(F.collect_set("sup")), ",").alias("provinces"))


@query("e14_sitelinks_and_labels", "SELECT doc_id, max(CASE WHEN lang = 'fr' THEN n_chars END) AS fr, max(CASE WHEN lang = 'en' THEN n_chars END) AS en FROM documents GROUP BY doc_id")
def e14(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    one = lambda lang: x.where(F.col("lang") == lang).select("doc_id", F.col("n_chars").alias(lang))
    return x.select("doc_id").distinct().join(one("fr"), "doc_id", "left").join(one("en"), "doc_id", "left")


@query("e15_seed_counts", "SELECT c_mktsegment AS cls, count(*) AS n, CAST(100 * count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) // greatest(count(*), 1) AS BIGINT) AS percent FROM customer GROUP BY c_mktsegment")
def e15(spark, d):
    x = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cls"))
    return x.agg(F.count("*").alias("n"), F.expr("100 * count_if(c_custkey % 3 = 0) div greatest(count(*), 1)").alias("percent"))


@query("e16_assembled_records", "SELECT doc_id, quality, CASE WHEN page_id IS NOT NULL THEN url END AS url, coalesce(item_id, -1) AS item FROM documents LEFT JOIN (SELECT doc_id AS k, max(quality) AS quality FROM labels GROUP BY doc_id) ON k = doc_id LEFT JOIN pages ON page_id = doc_id LEFT JOIN benchmark ON item_id = doc_id")
def e16(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    x = x.join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    x = x.join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return x.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("item")), "doc_id", "left").withColumn("item", F.coalesce("item", F.lit(-1).cast("long")))


@query("e17_missing_and_disagreeing", "SELECT count(CASE WHEN page_id IS NULL THEN 1 END) AS missing, count(CASE WHEN page_id % 7 <> doc_id % 5 THEN 1 END) AS disagree FROM documents LEFT JOIN pages ON page_id = doc_id")
def e17(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "pages"), F.col("page_id") == F.col("doc_id"), "left")
    return x.agg(F.count_if(F.col("page_id").isNull()).alias("missing"), F.count_if(F.expr("page_id % 7 <> doc_id % 5")).alias("disagree"))


@query("e18_alias_table", "SELECT c_mktsegment AS family, string_agg(DISTINCT n, ',' ORDER BY n) AS names FROM (SELECT c_mktsegment, c_mktsegment AS n FROM customer UNION SELECT c_mktsegment, lower(c_mktsegment) || c_nationkey FROM customer) GROUP BY c_mktsegment")
def e18(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_mktsegment").alias("family"), F.col("c_mktsegment").alias("n")).union(c.select("c_mktsegment", F.concat(F.lower("c_mktsegment"), "c_nationkey"))).distinct()
    return names.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("names"))


@query("e19_link_targets", "SELECT DISTINCT 'Club ' || (c_custkey % 10) AS title, CASE WHEN c_custkey % 10 < 8 THEN 'kg:club/' || (c_custkey % 10) END AS target FROM customer")
def e19(spark, d):
    from graphloom.functions import wikitext as X
    from graphloom.plans.text_queries import _boxes

    titles = _boxes(spark, d).select(F.explode(X.links(F.col("page"))).alias("title")).distinct()
    known = table(spark, d, "part").where("p_partkey < 8").select(F.concat(F.lit("Club "), "p_partkey").alias("title"), iri("club", "p_partkey").alias("target"))
    return titles.join(known, "title", "left")


@query("e20_coverage_per_class", "SELECT source AS cls, count(*) AS pages, count(CASE WHEN quality IS NOT NULL THEN 1 END) AS labelled, count(CASE WHEN n_chars > 1000 THEN 1 END) AS abstracts FROM documents LEFT JOIN (SELECT doc_id AS k, max(quality) AS quality FROM labels GROUP BY doc_id) ON k = doc_id GROUP BY source")
def e20(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    return x.groupBy(F.col("source").alias("cls")).agg(F.count("*").alias("pages"), F.count("quality").alias("labelled"), F.count_if(F.col("n_chars") > 1000).alias("abstracts"))


@query("e21_link_report", "SELECT count(*) AS titles, count(CASE WHEN k < 8 THEN 1 END) AS existing FROM (SELECT DISTINCT c_custkey % 10 AS k FROM customer)")
def e21(spark, d):
    return e19(spark, d).agg(F.count("*").alias("titles"), F.count("target").alias("existing"))


# ---- fusion


@query("m01_mapped_fields", "SELECT c_custkey AS entity, 'name' AS property, c_name AS raw FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def m01(spark, d):
    c = table(spark, d, "customer")
    fields = c.select(F.col("c_custkey").alias("entity"), F.explode(F.create_map(F.lit("Name"), "c_name", F.lit("FULLNAME"), F.lower("c_name"), F.lit("seg"), "c_mktsegment", F.lit("other"), "c_name")).alias("key", "raw"))
    mapping = spark.createDataFrame([("name", "name", 1), ("fullname", "name", 2), ("seg", "segment", 1)], "key string, property string, prio int")
    return M.mapped(fields, mapping)


@query("m02_mapping_coverage", "SELECT CASE WHEN event_type = 'view' THEN 'unmapped' WHEN event_id % 2 = 0 THEN 'parsed' ELSE 'failed' END AS status, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def m02(spark, d):
    e = table(spark, d, "events")
    fields = e.select(F.col("event_type").alias("key"), F.when(F.expr("event_id % 2 = 0"), F.col("event_id").cast("string")).otherwise("?").alias("raw"))
    mapping = e.select(F.col("event_type").alias("key")).distinct().where("key <> 'view'").withColumn("property", F.col("key"))
    return M.coverage(fields, held(mapping, "mapping"), F.col("raw").try_cast("bigint").isNotNull())


@query("m03_preferred_statements", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS u, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS a FROM orders) WHERE u OR a = 0")
def m03(spark, d):
    return M.best(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey")


@query("m04_source_precedence", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN coalesce(t, o_totalprice) ELSE o_totalprice END, 2) AS price FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS t FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def m04(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("t"))
    x = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.select("o_orderkey", F.round(M.pick(F.col("t"), F.col("o_totalprice"), F.expr("o_orderkey % 2 = 0")), 2).alias("price"))


@query("m05_references", "SELECT DISTINCT l_suppkey AS ref, CASE WHEN l_suppkey % 3 = 0 THEN 'kg:club/' || l_suppkey WHEN l_suppkey % 3 = 1 THEN 'kg:article/S' || l_suppkey ELSE 'ext:' || l_suppkey END AS iri FROM lineitem")
def m05(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref")).distinct()
    s = table(spark, d, "supplier")
    own = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("ref"), iri("club", "s_suppkey").alias("iri"))
    titles = s.where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("S"), "s_suppkey").alias("title"))
    return M.references(refs, own, titles)


@query("m07_allowed_classes", "SELECT DISTINCT 'kg:station/' || l_orderkey AS s, 'kg:club/' || l_suppkey AS o FROM lineitem WHERE l_suppkey % 4 <> 1")
def m07(spark, d):
    links = graph(spark, d).where("p = 'kg:team'").select("s", "o")
    cls = table(spark, d, "supplier").where("s_suppkey % 4 < 3").select(iri("club", "s_suppkey").alias("o"), F.when(F.expr("s_suppkey % 4 = 1"), "kg:Stadium").otherwise("kg:FootballClub").alias("cls"))
    return M.allowed(links, cls, ["kg:FootballClub"])


@query("m09_first_labels", "SELECT l_partkey AS target, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS label FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey")
def m09(spark, d):
    small = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("target"))
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), "l_orderkey", "l_linenumber").join(small, "target", "left_anti")
    return x.groupBy("target").agg(F.min_by("l_orderkey", F.struct("l_orderkey", "l_linenumber")).alias("label"))


@query("m21_career_series", "SELECT o_custkey AS entity, CAST(k AS INTEGER) AS n, CAST(year(o_orderdate) AS VARCHAR) AS years, CAST(o_orderkey AS VARCHAR) AS clubs FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)")
def m21(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, d, "orders").withColumn("k", k)
    pairs = F.array(F.struct(F.concat(F.lit("years"), "k").alias("key"), F.year("o_orderdate").cast("string").alias("raw")), F.struct(F.concat(F.lit("clubs"), "k").alias("key"), F.col("o_orderkey").cast("string").alias("raw")))
    return M.series(o.select(F.col("o_custkey").alias("entity"), F.inline(pairs)), {"years": "years", "clubs": "clubs"})


@query("m22_station_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS idx FROM orders")
def m22(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return M.numbered(table(spark, d, "orders"), "o_custkey", rank, F.col("o_orderkey")).select("o_orderkey", "idx")


@query("m23_fallback_membership", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def m23(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return M.with_fallback(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("m25_current_club", "SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS current FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def m25(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("current"))


@query("m31_latest_population", "SELECT user_id, value, year FROM (SELECT user_id, event_id AS value, CASE WHEN event_id % 4 <> 0 THEN CAST(year(ts) AS INTEGER) END AS year, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def m31(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("value"), F.when(F.expr("event_id % 4 <> 0"), F.date_format("ts", "yyyy-MM-dd")).alias("pit"))
    return M.latest(e, "user_id", "value", "pit")


@query("m33_former_flag", "SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS former FROM orders GROUP BY o_custkey")
def m33(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((~F.bool_or(F.col("o_orderstatus") == "O")).alias("former"))
