"""Careers of customers: infobox pages written from their orders, parsed back to stations, triples and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import wikitext as X
from graphloom.operators import stations as S
from graphloom.operators.closure import held
from graphloom.operators.fusion import allowed
from graphloom.operators.markup import infobox_parameters
from graphloom.operators.records import link_iris
from graphloom.plans.registry import query
from graphloom.sources.tables import dealt, iri, table

NOW = 2026
_KINDS = {"kg:YouthStation": "youth", S.CLUB: "club", S.NATIONAL: "national team"}
_CLASS = "CASE WHEN s_suppkey % 5 = 0 THEN 'kg:NationalTeam' WHEN s_suppkey % 7 = 3 THEN 'kg:Stadium' ELSE 'kg:FootballClub' END"

# What the pages say: team and years by the order's key, kind by its status; customers whose key 5 divides have no clubs on their page but memberships.
_SQL = f"""s AS (SELECT s_suppkey AS kk, {_CLASS} AS cls FROM supplier),
b AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 120 AS k, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS st, kk IS NOT NULL AS known, cls FROM orders LEFT JOIN s ON kk = o_orderkey % 120),
l AS (SELECT *, known IS NOT TRUE OR cls = CASE st WHEN 'P' THEN 'kg:NationalTeam' ELSE 'kg:FootballClub' END AS fits,
CASE o % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN known THEN 'Club ' ELSE 'Crossroads ' END WHEN 2 THEN CASE WHEN known THEN 'Club ' ELSE 'Old club ' END ELSE 'Club ' END || k AS page,
CASE o % 6 WHEN 0 THEN 'Side ' || k WHEN 1 THEN 'Crossroads ' || k || ', C' WHEN 2 THEN 'Old' ELSE 'Club ' || k END AS plain FROM b WHERE NOT (st = 'F' AND c % 5 = 0)),
x AS (SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY CASE st WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o) AS BIGINT) AS idx, CASE st WHEN 'F' THEN 'kg:ClubStation' WHEN 'O' THEN 'kg:YouthStation' ELSE 'kg:NationalTeamStation' END AS kind,
CASE WHEN fits THEN 'kg:' || replace(page, ' ', '_') END AS team, coalesce(CASE WHEN fits THEN page END, plain) AS label, CASE WHEN o % 11 > 0 THEN y END AS start, CASE WHEN o % 11 > 0 THEN CASE o % 3 WHEN 1 THEN y + 2 WHEN 2 THEN y END END AS "end",
CASE WHEN st <> 'O' AND o % 5 > 0 THEN o % 40 END AS apps, CASE WHEN st <> 'O' AND o % 5 > 0 AND o % 3 > 0 THEN o % 7 END AS goals, o % 4 = 0 AS loan FROM l),
h AS (SELECT c, max(idx) AS last, bool_or(kind = 'kg:ClubStation') AS club FROM x GROUP BY c),
m AS (SELECT c, coalesce(last, 0) + row_number() OVER (PARTITION BY c ORDER BY day, k, o) AS idx, CASE WHEN cls = 'kg:NationalTeam' THEN 'kg:NationalTeamStation' ELSE 'kg:ClubStation' END AS kind, 'kg:Club_' || k AS team, 'Club ' || k AS label,
y AS start, CASE WHEN o % 3 > 0 THEN y + 1 END AS "end", CASE WHEN o % 5 > 0 THEN o % 40 END AS apps, CASE WHEN o % 3 > 0 THEN o % 7 END AS goals, false AS loan
FROM b LEFT JOIN h USING (c) WHERE st = 'F' AND c % 5 = 0 AND NOT coalesce(club, false) AND (cls IS NULL OR cls <> 'kg:Stadium')),
z AS (SELECT 'kg:player/' || c AS entity, CAST(idx AS BIGINT) AS idx, kind, team, label, start, "end", CAST(apps AS BIGINT) AS apps, CAST(goals AS BIGINT) AS goals, loan FROM (SELECT * FROM x UNION ALL SELECT * FROM m))"""


def pages(spark, d):
    """entity, text: an infobox per customer with orders or a current club."""
    o = table(spark, d, "orders").where("not (o_orderstatus = 'F' and o_custkey % 5 = 0)")
    o = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))).withColumn("k", F.expr("o_orderkey % 120"))
    text = lambda *parts: F.concat(*[F.col(p) if p in ("k", "n") else F.lit(p) for p in parts])
    form = F.expr("o_orderkey % 6")
    team = F.when(form == 0, text("Side ", "k")).when(form == 1, text("[[Crossroads ", "k", "]], [[Club ", "k", "|C]]")).when(form == 2, text("[[old_club ", "k", "|Old]]")).otherwise(text("[[Club ", "k", "]]"))
    team = F.when(F.expr("o_orderkey % 4 = 0"), F.concat(F.lit("→ "), team, F.lit(" (mượn)"))).otherwise(team)
    y = F.year("o_orderdate")
    years = F.when(F.expr("o_orderkey % 11 = 0"), "không rõ").when(F.expr("o_orderkey % 3 = 0"), F.concat(y, F.lit("–"))).when(F.expr("o_orderkey % 3 = 1"), F.concat(y, F.lit("–"), y + 2)).otherwise(y.cast("string"))
    stem = lambda f, c, p: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", c).otherwise(p)
    field = lambda key, value: F.concat(F.lit("| "), key, F.col("n"), F.lit(" = "), value, F.lit("\n"))
    games = F.when(F.expr("o_orderstatus <> 'O' and o_orderkey % 5 > 0"), field(stem("caps", None, "nationalcaps"), F.expr("o_orderkey % 40")))
    goals = F.when(F.expr("o_orderstatus <> 'O' and o_orderkey % 5 > 0 and o_orderkey % 3 > 0"), field(stem("goals", None, "nationalgoals"), F.expr("o_orderkey % 7")))
    none = F.lit("")
    part = F.concat(field(stem("Years", "youthyears", "nationalyears"), years), field(stem("clubs", "youthclubs", "nationalteam"), team), F.coalesce(games, none), F.coalesce(goals, none))
    boxes = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("t"))))["t"], "").alias("body"))
    current = F.when(F.expr("c_custkey % 4 = 0"), F.concat(F.lit("| currentclub = [[Club "), F.expr("c_custkey % 120"), F.lit("]]\n"))).otherwise("")
    both = table(spark, d, "customer").join(boxes, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select(iri("player", "c_custkey").alias("entity"), F.concat(F.lit("{{Infobox football biography\n"), current, F.coalesce("body", none), F.lit("}}\nText.")).alias("text"))


def _sources(spark, d):
    """Targets of links and classes of what they lead to."""
    s = table(spark, d, "supplier")
    title = F.concat(F.lit("Club "), "s_suppkey")
    known = lambda raw, page, many: s.select(F.concat(F.lit(raw), "s_suppkey").alias("raw"), page.cast("string").alias("title"), F.lit(many).alias("disambiguation"))
    targets = known("Club ", title, False).union(known("Old club ", title, False)).union(known("Crossroads ", F.lit(None), True))
    return targets, s.select(F.concat(F.lit("kg:Club_"), "s_suppkey").alias("iri"), F.expr(_CLASS).alias("cls"))


def careers(spark, d):
    """The stations of every customer's page, or of the memberships where it has no club, and the parameters of all pages."""
    fields = held(infobox_parameters(dealt(pages(spark, d), "entity"), page="entity").select(F.col("page").alias("entity"), "key", "value"), "fields")
    targets, classes = _sources(spark, d)
    boxes = held(S.box_stations(fields, targets, classes, "kg:"), "stations")
    day, next_year = F.date_format("o_orderdate", "'+'yyyy-MM-dd"), F.concat(F.lit("+"), F.year("o_orderdate") + 1)
    text = lambda c, when: F.when(F.expr(when), F.expr(c).cast("string"))
    member = table(spark, d, "orders").where("o_orderstatus = 'F' and o_custkey % 5 = 0").select(
        iri("player", "o_custkey").alias("entity"), F.concat(F.lit("kg:Club_"), F.expr("o_orderkey % 120")).alias("team"), F.concat(F.lit("Club "), F.expr("o_orderkey % 120")).alias("label"),
        F.expr("o_orderkey % 120").alias("k"), "o_orderkey", day.alias("start"), F.when(F.expr("o_orderkey % 3 > 0"), next_year).alias("end"), text("o_orderkey % 40", "o_orderkey % 5 > 0").alias("apps"), text("o_orderkey % 7", "o_orderkey % 3 > 0").alias("goals"),
    )
    return boxes.unionByName(S.member_stations(member, classes, boxes, ("k", "o_orderkey"))), fields


@query("m22_stations_of_markup", f"WITH {_SQL} SELECT * FROM z")
def m22(spark, d):
    return careers(spark, d)[0]


@query(
    "m24_station_triples_of_markup",
    f"""WITH {_SQL}, t AS (SELECT z.*, entity || '__' || idx AS st, c_name FROM z JOIN customer ON entity = 'kg:player/' || c_custkey)
SELECT entity AS s, 'kg:careerStation' AS p, st AS o, 'iri' AS o_kind, NULL AS dt, NULL AS lang FROM t UNION ALL SELECT st, 'rdf:type', kind, 'iri', NULL, NULL FROM t
UNION ALL SELECT st, 'rdfs:label', c_name || ' – ' || label || ' (' || coalesce(CAST(start AS VARCHAR), '?') || '–' || coalesce(CAST("end" AS VARCHAR), '') || ')', 'lit', NULL, 'vi' FROM t
UNION ALL SELECT st, 'kg:team', team, 'iri', NULL, NULL FROM t WHERE team IS NOT NULL UNION ALL SELECT st, 'kg:startYear', CAST(start AS VARCHAR), 'lit', 'xsd:gYear', NULL FROM t WHERE start IS NOT NULL
UNION ALL SELECT st, 'kg:endYear', CAST("end" AS VARCHAR), 'lit', 'xsd:gYear', NULL FROM t WHERE "end" IS NOT NULL UNION ALL SELECT st, 'kg:appearances', CAST(apps AS VARCHAR), 'lit', 'xsd:nonNegativeInteger', NULL FROM t WHERE apps IS NOT NULL
UNION ALL SELECT st, 'kg:goals', CAST(goals AS VARCHAR), 'lit', 'xsd:nonNegativeInteger', NULL FROM t WHERE goals IS NOT NULL UNION ALL SELECT st, 'kg:onLoan', 'true', 'lit', 'xsd:boolean', NULL FROM t WHERE loan""",
)
def m24(spark, d):
    titles = table(spark, d, "customer").select(iri("player", "c_custkey").alias("entity"), F.col("c_name").alias("title"))
    return S.station_triples(careers(spark, d)[0], titles)


@query(
    "m25_current_club_of_markup",
    f"""WITH {_SQL}, g AS (SELECT 'kg:player/' || c_custkey AS entity, 'kg:Club_' || (c_custkey % 120) AS club FROM customer LEFT JOIN s ON kk = c_custkey % 120 WHERE c_custkey % 4 = 0 AND (cls IS NULL OR cls = 'kg:FootballClub'))
SELECT * FROM g UNION ALL SELECT entity, max_by(team, idx) FROM z WHERE kind = 'kg:ClubStation' AND team IS NOT NULL AND start IS NOT NULL AND "end" IS NULL AND entity NOT IN (SELECT entity FROM g) GROUP BY entity""",
)
def m25(spark, d):
    stations, fields = careers(spark, d)
    targets, classes = _sources(spark, d)
    links = fields.where("key = 'currentclub'").select("entity", F.explode(X.links(F.col("value"))).alias("raw"))
    links = link_iris(links, targets, "kg:").where("iri is not null").select(F.col("entity").alias("s"), F.col("iri").alias("o"))
    given = allowed(links, classes.withColumnRenamed("iri", "o"), ["kg:FootballClub"]).select(F.col("s").alias("entity"), F.col("o").alias("club"))
    return S.current_clubs(stations, given)


@query(
    "b18_notes_of_stations",
    f"""WITH {_SQL} SELECT entity, idx, concat_ws(' · ', CASE WHEN start IS NOT NULL OR "end" IS NOT NULL THEN coalesce(CAST(start AS VARCHAR), '?') || '–' || coalesce(CAST("end" AS VARCHAR), '') END,
apps || ' trận' || coalesce(', ' || goals || ' bàn', ''), CASE WHEN loan THEN 'cho mượn' END, CASE kind WHEN 'kg:YouthStation' THEN 'youth' WHEN 'kg:ClubStation' THEN 'club' ELSE 'national team' END) AS note FROM z""",
)
def b18(spark, d):
    return S.notes(careers(spark, d)[0], _KINDS)


@query(
    "b19_timeline_of_stations",
    f"""WITH RECURSIVE {_SQL}, i AS (SELECT entity, kind, idx, start, greatest(coalesce("end", {NOW}) + 1, start + 1) AS until, "end" IS NULL AS open FROM z WHERE start IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY entity, kind ORDER BY start, until, idx) AS r FROM i),
w AS (SELECT p.*, 0 AS lane, [until] AS ends, 0 AS beside FROM p WHERE r = 1 UNION ALL
SELECT * EXCLUDE (before, f), f - 1 AS lane, list_concat(before[1:f - 1], [until], before[f + 1:]) AS ends, len(list_filter(before, lambda e: e > start)) AS beside
FROM (SELECT p.*, w.ends AS before, coalesce(list_position(list_transform(w.ends, lambda e: e <= p.start), true), len(w.ends) + 1) AS f FROM w JOIN p ON p.entity = w.entity AND p.kind = w.kind AND p.r = w.r + 1))
SELECT entity, kind, idx, start, until, open, CAST(lane AS INTEGER) AS lane, CAST(beside AS INTEGER) AS beside FROM w""",
)
def b19(spark, d):
    return S.timeline(careers(spark, d)[0], NOW)


@query("b20_span_of_careers", f'WITH {_SQL} SELECT entity, min(start) AS first, max(coalesce("end", {NOW})) AS last FROM z WHERE start IS NOT NULL GROUP BY entity')
def b20(spark, d):
    return S.spans(careers(spark, d)[0], NOW)
