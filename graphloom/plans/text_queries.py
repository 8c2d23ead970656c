"""Column-expression jobs over whole tables: names, typed values, article markup. Their inputs are written from typed columns, which are what comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms as N
from graphloom.functions import wikitext as X
from graphloom.operators import markup as M
from graphloom.plans.registry import query
from graphloom.sources.tables import dealt, table


@query("n01_norm_title", "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title FROM part")
def n01(spark, d):
    raw = F.concat(F.lit(" "), F.lower(F.substring("p_name", 1, 1)), F.translate(F.expr("substring(p_name, 2)"), " ", "_"), F.lit("__"))
    return table(spark, d, "part").select("p_partkey", N.norm_title(raw).alias("title"))


@query("n02_iri_local", "SELECT p_partkey, replace(upper(p_name[1]) || p_name[2:], ' ', '_') || '%3F_(100%25)' AS local FROM part")
def n02(spark, d):
    return table(spark, d, "part").select("p_partkey", N.iri_local(F.concat("p_name", F.lit("? (100%)"))).alias("local"))


@query("n03_resource_iri", "SELECT p_partkey, 'kg:r/' || replace(upper(p_name[1]) || p_name[2:], ' ', '_') AS iri FROM part")
def n03(spark, d):
    return table(spark, d, "part").select("p_partkey", N.resource_iri(F.concat(F.lit("Category:"), "p_name"), "kg:r/").alias("iri"))


@query("n04_last_segment", "SELECT page_id, list_last(string_split(url, '/')) AS last FROM pages")
def n04(spark, d):
    return table(spark, d, "pages").select("page_id", N.last_segment(F.col("url")).alias("last"))


@query("n05_page_url", "SELECT p_partkey, 'https://en.example.org/wiki/' || replace(upper(p_name[1]) || p_name[2:], ' ', '_') || '_(a/b)%26c' AS url FROM part")
def n05(spark, d):
    return table(spark, d, "part").select("p_partkey", N.page_url(F.concat("p_name", F.lit(" (a/b)&c")), "https://en.example.org/wiki/").alias("url"))


@query("n06_safe_iri", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS url FROM pages")
def n06(spark, d):
    raw = F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("ftp://x y"), "url")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", N.safe_iri(raw).alias("url"))


@query("n08_property_name", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '_' || o_orderkey || 'KeyNAME' ELSE 'rawKey' || o_orderkey END AS name FROM orders")
def n08(spark, d):
    raw = F.when(F.expr("o_orderkey % 2 = 0"), F.concat("o_orderkey", F.lit(" key_NAME!"))).otherwise(F.concat(F.lit("Raw key"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", N.property_name(raw).alias("name"))


_FOLD = "replace(replace(strip_accents(lower(text)), 'đ', 'd'), '_', ' ')"


@query("n09_fold", f"SELECT doc_id, sha256({_FOLD}) AS digest FROM (SELECT doc_id, replace(text, 'ß', 'ss') || ' Đà Nẵng' AS text FROM documents)")
def n09(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat(F.replace("text", F.lit("ß"), F.lit("ss")), F.lit(" Đà Nẵng")).alias("text"))
    return x.select("doc_id", F.sha2(N.fold(F.col("text")), 256).alias("digest"))


@query("n10_token_key", "SELECT p_partkey, lower(p_name) || ' da nang 7' AS key FROM part")
def n10(spark, d):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(", Đà_Nẵng: (7)"))
    return table(spark, d, "part").select("p_partkey", N.token_key(raw).alias("key"))


@query("n11_short_abstract", "WITH s AS (SELECT s_suppkey, 'Sentence of ' || s_suppkey || '.' AS one FROM supplier) SELECT s_suppkey, rtrim(repeat(one || ' ', least(60, 399 // (length(one) + 1) + CASE WHEN 399 % (length(one) + 1) >= length(one) THEN 1 ELSE 0 END))) AS abstract FROM s")
def n11(spark, d):
    one = F.concat(F.lit("Sentence of "), "s_suppkey", F.lit("."))
    text = F.concat(F.array_join(F.array_repeat(one, 60), " "), F.lit("\nSecond paragraph."))
    return table(spark, d, "supplier").select("s_suppkey", N.short_abstract(text).alias("abstract"))


@query("v01_integer", "SELECT o_orderkey, o_orderkey * 1234567 AS n FROM orders")
def v01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.integer(F.concat(F.lit("about "), F.format_number(F.col("o_orderkey") * 1234567, 0), F.lit(" people"))).alias("n"))


@query("v02_decimal", "SELECT p_partkey, round(p_retailprice * 100) / 100 AS x FROM part")
def v02(spark, d):
    english = F.format_number("p_retailprice", 2)
    other = F.translate(english, ",.", ".,")
    return table(spark, d, "part").select("p_partkey", N.decimal(F.when(F.expr("p_partkey % 2 = 0"), english).otherwise(other)).alias("x"))


@query("v03_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 5 = 3 THEN 'gYearMonth' WHEN o_orderkey % 5 = 4 THEN 'gYear' ELSE 'date' END AS precision FROM orders")
def v03(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.expr("o_orderkey % 5")
    raw = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("d/M/yyyy")).when(k == 2, f("d MMMM yyyy")).when(k == 3, f("MMMM yyyy")).otherwise(F.concat(F.lit("in "), f("yyyy")))
    return table(spark, d, "orders").select("o_orderkey", N.date(raw).alias("v")).select("o_orderkey", "v.*")


@query("v04_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def v04(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.year(F.concat(F.lit("no 12345, season "), F.year("o_orderdate"), F.lit("/x"))).alias("y"))


@query("v05_year_range", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS \"start\", CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) + 2 WHEN 1 THEN NULL ELSE year(o_orderdate) END AS INTEGER) AS \"end\" FROM orders")
def v05(spark, d):
    y = F.year("o_orderdate")
    raw = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(y, F.lit("–"), y + 2)).when(F.expr("o_orderkey % 3 = 1"), F.concat(y, F.lit("–"))).otherwise(y.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", N.year_range(raw).alias("r")).select("o_orderkey", "r.*")


@query("v06_height", "SELECT c_custkey, CASE WHEN 130 + c_custkey % 100 BETWEEN 140 AND 220 THEN (130 + c_custkey % 100) / 100.0 END AS m FROM customer")
def v06(spark, d):
    cm = F.expr("130 + c_custkey % 100")
    raw = F.when(F.expr("c_custkey % 2 = 0"), F.concat(cm, F.lit(" cm"))).otherwise(F.concat(F.format_number(cm / 100, 2), F.lit(" m")))
    return table(spark, d, "customer").select("c_custkey", N.height(raw).alias("m"))


@query("v07_on_loan", "SELECT o_orderkey, o_orderkey % 4 = 0 AS loan FROM orders")
def v07(spark, d):
    raw = F.concat(F.lit("Club "), "o_custkey", F.when(F.expr("o_orderkey % 4 = 0"), " (loan)").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", N.on_loan(raw).alias("loan"))


@query("v08_link_or_text", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS v FROM part")
def v08(spark, d):
    raw = F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("[["), "p_name", F.lit("|label]]"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.when(F.size(X.links(raw)) > 0, F.array_join(X.links(raw), ", ")).otherwise(X.render(raw)).alias("v"))


@query("v09_time_value", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE '-' || strftime(o_orderdate, '%Y') END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'gYearMonth' ELSE 'gYear' END AS precision FROM orders")
def v09(spark, d):
    k = F.expr("o_orderkey % 3")
    raw = F.concat(F.when(k == 2, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return table(spark, d, "orders").select("o_orderkey", N.time_value(raw, (F.lit(11) - k).cast("string")).alias("v")).select("o_orderkey", "v.*")


@query("v10_leading_year", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -year(o_orderdate) ELSE year(o_orderdate) END AS INTEGER) AS y FROM orders")
def v10(spark, d):
    raw = F.concat(F.when(F.expr("o_orderkey % 2 = 0"), "-").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", N.leading_year(raw).alias("y"))


@query("v11_point", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 5 <> 0 THEN -(c_custkey % 180) / 2.0 END AS lon FROM customer")
def v11(spark, d):
    raw = F.when(F.expr("c_custkey % 5 = 0"), "Point(x)").otherwise(F.concat(F.lit("Point(-"), F.expr("(c_custkey % 180) / 2D"), F.lit(" "), F.expr("c_custkey % 90"), F.lit(")")))
    return table(spark, d, "customer").select("c_custkey", N.point(raw).alias("v")).select("c_custkey", "v.*")


@query("v12_sum_of_parts", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE t END AS BIGINT) AS total FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS t FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 OR t IS NOT NULL")
def v12(spark, d):
    from graphloom.operators.fusion import totals

    o = table(spark, d, "orders")
    given = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("value"))
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_quantity").cast("long").alias("value"))
    return totals(given, parts).join(o.select(F.col("o_orderkey").alias("entity")), "entity", "left_semi").select(F.col("entity").alias("o_orderkey"), F.col("value").alias("total"))


@query("v13_read_integer", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id - 500 END AS n FROM events")
def v13(spark, d):
    raw = F.when(F.expr("event_id % 3 = 0"), "unknown").otherwise((F.col("event_id") - 500).cast("string"))
    return table(spark, d, "events").select("event_id", N.read_integer(raw).alias("n"))


def _boxes(spark, d):
    """A page of markup per customer: nested templates, links, references."""
    c = dealt(table(spark, d, "customer"), "c_custkey").withColumn("y", F.expr("1950 + c_custkey % 50"))
    return c.select(
        "c_custkey",
        F.concat(
            F.lit("{{short|x}} text {{Infobox football biography\n| name = "), "c_name", F.lit("<ref>{{cite|a=b}}</ref>\n| birth_date = {{birth date|df=y|"), "y",
            F.lit("|3|7}}\n| club = [[Club "), F.expr("c_custkey % 10"), F.lit("|the '''club''']]\n| height = {{height|m=1.80}}\n| caption = {{small|{{nowrap|"), "c_mktsegment",
            F.lit("}}}} ( )\n| empty = \n| name2 = a<br/>b\n}} more [[File:x.jpg]]\n== External links ==\n* [https://a.example/"), "c_custkey", F.lit(" A]\n* https://b.example/x\n== Notes ==\nhttps://c.example"),
        ).alias("page"),
    )


def _fields(spark, d):
    """c_custkey, p: the parameters of each page's infobox; a shuffle-free step of its own, so that no field splits the page again."""
    return _boxes(spark, d).select("c_custkey", F.explode(F.array(X.params(X.infobox(F.col("page"))))).alias("p"))


@query("x01_infobox", "SELECT c_custkey, CAST(length(c_name) + 4 AS BIGINT) > 0 AS found, 'Infobox football biography' AS name FROM customer")
def x01(spark, d):
    box = X.infobox(F.col("page"))
    return _boxes(spark, d).select("c_custkey", (box != "").alias("found"), X.strip(F.element_at(F.split(box, r"\|"), 1)).alias("name"))


def _shapes(spark, d):
    """A page per customer in four shapes: nested values, a brace that is never closed, a known family after another infobox, a file link of many bars."""
    c, shape = dealt(table(spark, d, "customer"), "c_custkey"), F.expr("c_custkey % 4")
    lead = F.when(shape == 1, "{{never closed | a = ").when(shape == 2, "{{Infobox other|k=1}} ").otherwise("{{short|x}} ")
    name = F.when(shape == 2, "Known_family").otherwise("Infobox person")
    image = F.when(shape == 3, "[[File:a.jpg|thumb|left|x=1|alt|link|{{small|b|c=d}}]]").otherwise("")
    club = F.concat(F.lit("[[Club "), F.expr("c_custkey % 10"), F.lit("|one|two|three|four|five|six]]"))
    text = F.concat(
        lead, F.lit("text {{"), name, F.lit("\n| name = "), "c_name", F.lit("<!-- | no = x -->\n| club = "), club, F.lit("\n| image = "), image,
        F.lit("\n| born = {{birth date|1990|{{mo|1=2}}}}\n| name = "), "c_mktsegment", F.lit(" &amp; ( , ) [[wikipedia:w]]\n| plain\n}} end ]]"), F.when(shape == 1, "").otherwise(" }}"),
    )
    return c.select(F.col("c_custkey").alias("page"), text.alias("text"))


_NAMES = "CASE c_custkey % 4 WHEN 2 THEN 'Known_family' ELSE 'Infobox person' END"
_CLUB = "'[[Club ' || (c_custkey % 10) || '|one|two|three|four|five|six]]'"


@query("x01_infobox_of_every_shape", f"SELECT c_custkey AS page, {_NAMES} AS name FROM customer")
def x01_shapes(spark, d):
    return M.infobox_parameters(_shapes(spark, d), ("Known family",)).select("page", "name").distinct()


@query("x03_params_of_every_shape", f"SELECT c_custkey AS page, unnest(['name', 'club', 'born'] || CASE WHEN c_custkey % 4 = 3 THEN ['image'] ELSE [] END) AS key, unnest([c_mktsegment || ' &amp; ( , ) [[wikipedia:w]]', {_CLUB}, '{{{{birth date|1990|{{{{mo|1=2}}}}}}}}'] || CASE WHEN c_custkey % 4 = 3 THEN ['[[File:a.jpg|thumb|left|x=1|alt|link|{{{{small|b|c=d}}}}]]'] ELSE [] END) AS value FROM customer")
def x03_shapes(spark, d):
    return M.infobox_parameters(_shapes(spark, d), ("Known family",)).select("page", "key", "value")


@query("x04_render_of_every_shape", "SELECT c_custkey AS page, c_mktsegment || ' &' AS name, 'one|two|three|four|five|six' AS club FROM customer")
def x04_shapes(spark, d):
    p = M.infobox_parameters(_shapes(spark, d), ("Known family",)).groupBy("page").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("name", "club")])
    return p.select("page", *[X.render(F.col(k)).alias(k) for k in ("name", "club")])


@query("x06_page_links", f"SELECT c_custkey AS page, unnest(['Club ' || (c_custkey % 10), 'wikipedia:w'] || CASE WHEN c_custkey % 4 = 3 THEN ['File:a.jpg'] ELSE [] END) AS target, unnest(['one|two|three|four|five|six', 'wikipedia:w'] || CASE WHEN c_custkey % 4 = 3 THEN ['thumb|left|x=1|alt|link|{{{{small|b|c=d}}}}'] ELSE [] END) AS label FROM customer")
def x06_pages(spark, d):
    return M.page_links(_shapes(spark, d)).select("page", "target", "label")


@query("x02_template_name", "SELECT p_partkey, 'infobox ' || lower(p_name) AS name FROM part")
def x02(spark, d):
    raw = F.concat(F.lit(" Template: Infobox_"), F.replace("p_name", F.lit(" "), F.lit("  ")))
    return table(spark, d, "part").select("p_partkey", X.template_name(raw).alias("name"))


@query("x03_params", "SELECT c_custkey, unnest(['name', 'birth_date', 'club', 'height', 'caption', 'name2']) AS key FROM customer")
def x03(spark, d):
    return _boxes(spark, d).select("c_custkey", F.explode(F.map_keys(X.params(X.infobox(F.col("page"))))).alias("key"))


@query("x04_render", "SELECT c_custkey, c_name AS name, 'the club' AS club, 'a; b' AS name2 FROM customer")
def x04(spark, d):
    return _fields(spark, d).select("c_custkey", *[X.render(F.col("p")[k]).alias(k) for k in ("name", "club", "name2")])


@query("x05_nested_templates", "SELECT c_custkey, (1950 + c_custkey % 50) || '-03-07' AS birth_date, '1.80 m' AS height, c_mktsegment AS caption FROM customer")
def x05(spark, d):
    return _fields(spark, d).select("c_custkey", *[X.render(F.col("p")[k]).alias(k) for k in ("birth_date", "height", "caption")])


@query("x06_links", "SELECT c_custkey, 'Club ' || (c_custkey % 10) AS links FROM customer")
def x06(spark, d):
    return _boxes(spark, d).select("c_custkey", F.array_join(X.links(F.col("page")), ",").alias("links"))


@query("x07_external_links", "SELECT c_custkey, 'https://a.example/' || c_custkey || ' https://b.example/x' AS links FROM customer")
def x07(spark, d):
    return _boxes(spark, d).select("c_custkey", F.array_join(X.external_links(F.col("page")), " ").alias("links"))


@query("x08_first_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'http://site' || page_id || '.example.org/a' END AS url FROM pages WHERE NOT contains(url, '|')")
def x08(spark, d):
    raw = F.when(F.expr("page_id % 2 = 0"), F.concat(F.lit("see ["), "url", F.lit(" here]"))).otherwise(F.concat(F.lit("at site"), "page_id", F.lit(".example.org/a today")))
    return table(spark, d, "pages").where(~F.contains("url", F.lit("|"))).select("page_id", X.first_url(raw).alias("url"))


@query("x09_raw_key_filter", "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def x09(spark, d):
    key = F.when(F.expr("event_id % 4 = 0"), F.concat(F.lit("Kit_"), "event_type")).otherwise(F.col("event_type"))
    return table(spark, d, "events").withColumn("key", key).where(~X.skipped(F.col("key"))).select("event_id", "event_type")


@query("x10_raw_property_rows", "SELECT 'kg:player/' || c_custkey AS s, 'club' AS p, 'Club ' || (c_custkey % 10) AS o, 'iri' AS o_kind FROM customer UNION ALL SELECT 'kg:player/' || c_custkey, 'name', c_name, 'lit' FROM customer UNION ALL SELECT 'kg:player/' || c_custkey, 'height', '1.80 m', 'lit' FROM customer")
def x10(spark, d):
    from graphloom.operators.fusion import raw_properties

    rows = _boxes(spark, d).select(F.concat(F.lit("kg:player/"), "c_custkey").alias("s"), F.explode(X.params(X.infobox(F.col("page")))).alias("key", "raw"))
    return raw_properties(rows.where("key in ('club', 'name', 'height')")).drop("dt")


@query("x10_raw_property_rows_all_keys", "SELECT 'kg:player/' || c_custkey AS s, unnest(['birth_date', 'club', 'height', 'name', 'name2', 'caps', 'edge']) AS p, unnest([(1950 + c_custkey % 50) || '-03-07', 'Club ' || (c_custkey % 10), '1.80 m', c_name, 'a; b', c_custkey::VARCHAR, repeat('x', 500)]) AS o, unnest(['lit', 'iri', 'lit', 'lit', 'lit', 'lit', 'lit']) AS o_kind, unnest([NULL, NULL, NULL, NULL, NULL, 'xsd:integer', NULL]) AS dt FROM customer")
def x10_all(spark, d):
    from graphloom.operators.fusion import raw_properties

    more = F.create_map(F.lit("caps"), F.concat(F.lit("00"), "c_custkey"), F.lit("edge"), F.repeat(F.lit("x"), 500), F.lit("notes"), F.repeat(F.lit("x"), 501))
    rows = _boxes(spark, d).select(F.concat(F.lit("kg:player/"), "c_custkey").alias("s"), F.explode(F.map_concat(X.params(X.infobox(F.col("page"))), more)).alias("key", "raw"))
    return raw_properties(rows.where(~X.skipped(F.col("key"))))


@query("x11_property_dictionary", "SELECT 'clickName' AS p, 'click_name' AS label WHERE false UNION ALL SELECT event_type || 'Key' AS p, max(event_type || '_key') AS label FROM events GROUP BY event_type")
def x11(spark, d):
    x = table(spark, d, "events").select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, " key").otherwise("_key")).alias("key"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(1).alias("ord"))
    return x.groupBy(N.property_name(F.col("key")).alias("p")).agg(F.max_by("key", "ord").alias("label"))
