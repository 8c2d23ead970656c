"""Queries that build the triples of each class of record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import producers as P
from graphloom.operators.producers import BOX, STRUCTURED, Rule
from graphloom.plans.registry import query
from graphloom.sources.tables import TYPE, graph, table

PLAYER, CLUB, TEAM, GROUND, SCHOOL, AREA, LAND = "kg:FootballPlayer kg:FootballClub kg:NationalFootballTeam kg:Stadium kg:University kg:Province kg:Country".split()
_FOUNDED = lambda cls: Rule(cls, "founding", "kg:foundingDate", year="kg:foundingYear", year_too=True, how="pick")
_HOME = lambda cls: Rule(cls, "homepage", "foaf:homepage", how="pick")
_PLACE = lambda cls: Rule(cls, "place", "kg:locatedIn", split="kg:province", best=False, allow=(AREA, LAND))
_HELD = lambda cls: Rule(cls, "place", "kg:province", best=False, within=True, allow=())
_PEOPLE = lambda cls: [Rule(cls, "manager", "kg:manager", "kg:managerName", allow=(PLAYER,)), Rule(cls, "chairman", "kg:chairman", allow=(PLAYER,))]
COUNT = "xsd:nonNegativeInteger"

RULES = [
    Rule(PLAYER, "birthDate", "kg:birthDate", year="kg:birthYear", how="pick"),
    Rule(PLAYER, "deathDate", "kg:deathDate", how="pick"),
    Rule(PLAYER, "birthPlace", "kg:birthPlace", how="fallback", allow=(AREA,), take=1),
    Rule(PLAYER, "birthPlace", "kg:birthProvince", how="fallback", allow=(AREA,), within=True),
    Rule(PLAYER, "position", "kg:position", best=False, allow=()),
    Rule(PLAYER, "height", "kg:height", how="pick", dt="xsd:double", low=1.4, high=2.2),
    Rule(PLAYER, "shirtNumber", "kg:shirtNumber", how="pick", dt=COUNT, low=1.0, high=99.0, bound=BOX),
    _FOUNDED(CLUB), _HOME(CLUB), *_PEOPLE(CLUB), _PLACE(CLUB), _HELD(CLUB),
    Rule(CLUB, "ground", "kg:ground", best=False, allow=(GROUND,), both=True),
    Rule(CLUB, "league", "kg:league", best=False, allow=()),
    Rule(CLUB, "nickname", "kg:nickname", how="pick", lang="vi"),
    _FOUNDED(TEAM), _HOME(TEAM), *_PEOPLE(TEAM),
    Rule(GROUND, "capacity", "kg:capacity", how="pick", dt=COUNT),
    Rule(GROUND, "openingYear", year="kg:openingYear", year_too=True, how="pick"),
    Rule(GROUND, "tenant", "kg:tenant", best=False, allow=(CLUB, TEAM), both=True, known=True),
    Rule(GROUND, "owner", "kg:owner", best=False, allow=(AREA, SCHOOL, CLUB)),
    Rule(GROUND, "operator", "kg:operator", best=False, allow=(AREA, SCHOOL, CLUB)),
    _HOME(GROUND), _PLACE(GROUND), _HELD(GROUND),
    _FOUNDED(SCHOOL), _HOME(SCHOOL), _PLACE(SCHOOL), _HELD(SCHOOL),
    Rule(SCHOOL, "abbreviation", "kg:abbreviation", how="pick", chars=60),
    Rule(SCHOOL, "motto", "kg:motto", how="pick", lang="vi"),
    Rule(SCHOOL, "students", "kg:numberOfStudents", how="pick", dt=COUNT),
    Rule(SCHOOL, "staff", "kg:academicStaffSize", how="pick", dt=COUNT),
    Rule(SCHOOL, "rector", "kg:rector", "kg:rectorName", how="pick", allow=(), late=True, chars=120),
    Rule(SCHOOL, "englishName", "rdfs:label", how="pick", lang="en", chars=200),
    Rule(SCHOOL, "otherName", "skos:altLabel", how="pick", lang="en", chars=200),
    Rule(SCHOOL, "parent", "kg:affiliation", best=False, allow=(SCHOOL,), other=True),
    Rule(AREA, "population", "kg:population", year="kg:populationYear", how="latest", dt=COUNT),
    Rule(AREA, "area", "kg:area", how="pick", dt="xsd:double", per=1e6, digits=2),
    Rule(AREA, "dissolved", year="kg:dissolutionYear", year_too=True, how="pick"),
    Rule(AREA, "successor", "kg:successor", best=False), Rule(AREA, "predecessor", "kg:predecessor", best=False),
    Rule(AREA, "capital", "kg:capital", allow=()), Rule(AREA, "region", "kg:region", allow=()),
    Rule(AREA, "code", "kg:administrativeCode", how="pick", chars=20), _HOME(AREA),
    Rule(LAND, "population", "kg:population", year="kg:populationYear", how="latest", dt=COUNT),
    Rule(LAND, "area", "kg:area", how="pick", dt="xsd:double", per=1e6, digits=2),
    Rule(LAND, "capital", "kg:capital"),
]
#: Class -> table, IRI and, for each value, source, property, kind, order, value (null: none), and, where given, preferred and time.
_S, _B = STRUCTURED, BOX
SPECS = {
    PLAYER: ("customer", "'kg:player/' || c_custkey", [
        (_S, "birthDate", "time", 0, "case c_custkey % 3 when 0 then (1950 + c_custkey % 50) || '-03-07' when 1 then '' || (1950 + c_custkey % 50) end"),
        (_B, "birthDate", "time", 0, "'1980-01-02'"),
        (_S, "deathDate", "time", 0, "case c_custkey % 10 when 0 then '2010-05-06' when 1 then '2011' end"),
        (_S, "birthPlace", "iri", 0, "case when c_custkey % 2 = 0 then 'kg:stadium/' || (c_custkey % 20 + 1) end"),
        (_B, "birthPlace", "iri", 0, "'kg:club/1'"),
        (_B, "birthPlace", "iri", 1, "'kg:province/' || c_nationkey"),
        (_B, "birthPlace", "iri", 2, "'kg:province/' || ((c_nationkey + 1) % 25)"),
        (_S, "position", "iri", 0, "'kg:position/' || (c_custkey % 4)"),
        (_B, "position", "iri", 0, "'kg:position/' || (c_custkey % 3)"),
        (_S, "height", "lit", 0, "case c_custkey % 4 when 0 then '1.0' when 1 then '1.8' end"),
        (_B, "height", "lit", 0, "'1.75'"),
        (_B, "shirtNumber", "lit", 0, "'' || (c_custkey % 120)"),
    ]),
    CLUB: ("supplier", "'kg:club/' || s_suppkey", [
        (_S, "founding", "time", 0, "case when s_suppkey % 2 = 0 then '1931-04-05' end"),
        (_B, "founding", "time", 0, "'1950'"),
        (_B, "homepage", "lit", 0, "'https://club.example/' || s_suppkey"),
        (_S, "ground", "iri", 0, "'kg:stadium/' || s_suppkey"),
        (_B, "ground", "iri", 0, "case when s_suppkey % 2 = 0 then 'kg:club/1' else 'kg:ground/x' end"),
        (_S, "league", "iri", 0, "'kg:league/' || (s_suppkey % 3)"),
        (_B, "league", "iri", 0, "'kg:club/1'"),
        (_B, "nickname", "lit", 0, "case when s_suppkey % 5 = 0 then s_name end"),
        (_S, "manager", "iri", 0, "'kg:coach/' || s_suppkey", "s_suppkey % 2 = 0"),
        (_S, "manager", "iri", 1, "'kg:coach/' || (s_suppkey + 1)"),
        (_B, "manager", "iri", 0, "case when s_suppkey % 3 = 0 then 'kg:player/1' when s_suppkey % 3 = 1 then 'kg:club/1' end"),
        (_B, "manager", "lit", 1, "case when s_suppkey % 3 = 2 then 'M ' || s_suppkey end"),
        (_B, "chairman", "iri", 0, "'kg:player/' || (s_suppkey % 5 + 1)"),
        (_S, "place", "iri", 0, "'kg:province/' || s_nationkey"),
        (_S, "place", "iri", 1, "'kg:country/' || (s_suppkey % 2)"),
    ]),
    TEAM: ("orders", "'kg:team/' || o_orderkey", [
        (_S, "founding", "time", 0, "case when o_orderkey % 2 = 0 then '1922' end"),
        (_B, "founding", "time", 0, "case when o_orderkey % 3 = 0 then '1923-02-01' end"),
        (_S, "homepage", "lit", 0, "case when o_orderkey % 4 = 0 then 'https://a.example/' || o_orderkey end"),
        (_B, "homepage", "lit", 0, "'https://b.example/' || o_orderkey"),
        (_S, "manager", "iri", 0, "'kg:player/' || o_custkey"),
        (_B, "manager", "iri", 0, "'kg:player/' || o_custkey"),
    ]),
    GROUND: ("part", "'kg:stadium/' || p_partkey", [
        (_S, "capacity", "lit", 0, "case p_partkey % 4 when 0 then '100.5' when 1 then '-3' end"),
        (_B, "capacity", "lit", 0, "'' || (p_size * 1000)"),
        (_S, "openingYear", "time", 0, "case when p_partkey % 2 = 0 then '1999-09-09' end"),
        (_B, "openingYear", "time", 0, "'2001'"),
        (_S, "tenant", "iri", 0, "'kg:club/' || (p_partkey % 7 + 1)"),
        (_B, "tenant", "iri", 0, "case when p_partkey % 3 = 0 then 'kg:cup/2024' when p_partkey % 3 = 1 then 'kg:player/1' end"),
        (_S, "owner", "iri", 0, "case when p_partkey % 2 = 0 then 'kg:player/1' end"),
        (_B, "owner", "iri", 0, "case when p_partkey % 2 = 1 then 'kg:player/1' else 'kg:province/1' end"),
        (_S, "place", "iri", 0, "'kg:province/' || (p_partkey % 25)"),
        (_B, "place", "iri", 0, "case when p_partkey % 2 = 0 then 'kg:club/1' else 'kg:town/9' end"),
    ]),
    SCHOOL: ("part", "'kg:school/' || p_partkey", [
        (_S, "abbreviation", "lit", 0, "case when p_partkey % 2 = 0 then p_brand end"),
        (_B, "abbreviation", "lit", 0, "repeat('ab', 40)"),
        (_B, "motto", "lit", 0, "p_type"),
        (_S, "students", "lit", 0, "case when p_partkey % 3 = 0 then '2.5' end"),
        (_B, "students", "lit", 0, "'' || p_size"),
        (_B, "staff", "lit", 0, "'' || (p_size + 1)"),
        (_B, "rector", "iri", 0, "case p_partkey % 3 when 0 then 'kg:player/1' when 1 then 'kg:rector/1' end"),
        (_B, "rector", "lit", 1, "'R ' || p_partkey"),
        (_B, "englishName", "lit", 0, "case when p_partkey % 2 = 0 then p_name end"),
        (_B, "otherName", "lit", 0, "case when p_partkey % 2 = 1 then p_name end"),
        (_S, "parent", "iri", 0, "'kg:school/' || (p_partkey - p_partkey % 2)"),
        (_S, "place", "iri", 0, "'kg:stadium/' || p_partkey"),
    ]),
    AREA: ("customer", "'kg:area/' || c_custkey", [
        (_S, "population", "lit", 0, "case when c_custkey % 2 = 0 then '100' end", "false", "'2009-04-01'"),
        (_S, "population", "lit", 1, "case when c_custkey % 2 = 0 then '200' end", "false", "'2019-04-01'"),
        (_S, "population", "lit", 2, "case when c_custkey % 2 = 0 then '50' end"),
        (_B, "population", "lit", 0, "'' || c_custkey", "false", "case when c_custkey % 3 = 0 then '2022' end"),
        (_S, "area", "lit", 0, "case when c_custkey % 2 = 0 then '1234567890' end"),
        (_B, "area", "lit", 0, "'12.5'"),
        (_S, "dissolved", "time", 0, "case when c_custkey % 5 = 0 then '2008-08-01' end"),
        (_S, "memberOf", "iri", 0, "case when c_custkey % 4 > 0 then 'kg:class/province' else 'kg:class/town' end", "false", "case when c_custkey % 4 = 1 then '2008' end"),
        (_S, "successor", "iri", 0, "case when c_custkey % 5 = 0 then 'kg:area/1' end"),
        (_S, "capital", "iri", 0, "'kg:town/' || (c_custkey % 9)", "true"),
        (_S, "capital", "iri", 1, "'kg:town/old'"),
        (_B, "capital", "iri", 0, "'kg:club/1'"),
        (_B, "region", "iri", 0, "'kg:coast/' || (c_custkey % 3)"),
        (_B, "code", "lit", 0, "'VN-' || c_custkey"),
    ]),
    LAND: ("supplier", "'kg:land/' || s_suppkey", [
        (_S, "population", "lit", 0, "'' || s_suppkey", "false", "'2020-01-01'"),
        (_S, "area", "lit", 0, "'' || (s_suppkey * 1005000)"),
        (_S, "capital", "iri", 0, "'kg:town/1'", "s_suppkey % 2 = 0"),
        (_S, "capital", "iri", 1, "'kg:town/2'"),
    ]),
}
CURRENT = ["kg:class/province"]


def values(spark, d: str, cls: str) -> DataFrame:
    """The values of both sources for the records of a class."""
    name, entity, given = SPECS[cls]
    rows = [f"named_struct('source', '{s}', 'prop', '{p}', 'kind', '{k}', 'ord', {n}, 'value', string({v}), 'preferred', {more[0] if more else 'false'}, 'at', string({more[1] if len(more) > 1 else 'null'}))" for s, p, k, n, v, *more in given]
    return table(spark, d, name).selectExpr(f"{entity} as entity", f"'{cls}' as cls", f"explode(array({', '.join(rows)})) as v").select("entity", "cls", "v.*")


def triples(spark, d: str, *classes: str, once: bool = True) -> DataFrame:
    """The triples of the records of some classes in one pass, FormerProvince types included; distinct unless the caller does that (once)."""
    types = graph(spark, d).where(F.col("p") == TYPE).where(F.col("o").isin(PLAYER, CLUB, GROUND, AREA, LAND)).select(F.col("s").alias("value"), F.col("o").alias("target"))
    within = table(spark, d, "part").selectExpr("'kg:stadium/' || p_partkey as place", "'kg:province/' || (p_partkey % 25) as province")
    within = within.unionByName(table(spark, d, "nation").selectExpr("'kg:province/' || n_nationkey as place", "'kg:province/' || n_nationkey as province"))
    v = reduce(DataFrame.unionByName, [values(spark, d, c) for c in classes])
    out = P.produce(v, types, within, [r for r in RULES if r.cls in classes], "kg:country/0", once)
    return out.unionByName(P.former(values(spark, d, AREA), AREA, CURRENT)) if AREA in classes else out


def _sql(cls: str, *facts: tuple) -> str:
    """Hand-written SQL: (p, o, kind, dt, lang, where) of every fact."""
    name, entity, _ = SPECS[cls]
    q = lambda x: "NULL" if x is None else f"'{x}'"
    return " UNION ".join(
        f"SELECT {entity} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS o_kind, {q(dt)} AS dt, {q(lang)} AS lang FROM {name} WHERE {where}" for p, o, kind, dt, lang, where in facts
    )


def _i(p, o, where="true"):
    return p, o, "iri", None, None, where


def _l(p, o, dt=None, where="true", lang=None):
    return p, o, "lit", dt, lang, where


_K, _SK, _PK = "c_custkey", "s_suppkey", "p_partkey"
SQL = {
    PLAYER: _sql(
        PLAYER,
        _l("kg:birthDate", f"(1950 + {_K} % 50) || '-03-07'", "xsd:date", f"{_K} % 3 = 0"), _l("kg:birthDate", "'1980-01-02'", "xsd:date", f"{_K} % 3 = 2"),
        _l("kg:birthYear", f"1950 + {_K} % 50", "xsd:gYear", f"{_K} % 3 = 1"), _l("kg:deathDate", "'2010-05-06'", "xsd:date", f"{_K} % 10 = 0"),
        _i("kg:birthPlace", f"'kg:stadium/' || ({_K} % 20 + 1)", f"{_K} % 2 = 0"), _i("kg:birthPlace", "'kg:province/' || c_nationkey", f"{_K} % 2 = 1"),
        _i("kg:birthProvince", f"'kg:province/' || ({_K} % 20 + 1)", f"{_K} % 2 = 0"), _i("kg:birthProvince", "'kg:province/' || c_nationkey", f"{_K} % 2 = 1"),
        _i("kg:birthProvince", "'kg:province/' || ((c_nationkey + 1) % 25)", f"{_K} % 2 = 1"),
        _i("kg:position", f"'kg:position/' || ({_K} % 4)"), _i("kg:position", f"'kg:position/' || ({_K} % 3)"),
        _l("kg:height", f"CASE WHEN {_K} % 4 = 1 THEN '1.8' ELSE '1.75' END", "xsd:double"), _l("kg:shirtNumber", f"{_K} % 120", COUNT, f"{_K} % 120 BETWEEN 1 AND 99"),
    ),
    CLUB: _sql(
        CLUB,
        _l("kg:foundingDate", "'1931-04-05'", "xsd:date", f"{_SK} % 2 = 0"), _l("kg:foundingYear", f"CASE WHEN {_SK} % 2 = 0 THEN '1931' ELSE '1950' END", "xsd:gYear"),
        _l("foaf:homepage", f"'https://club.example/' || {_SK}"), _i("kg:ground", f"'kg:stadium/' || {_SK}"), _i("kg:ground", "'kg:ground/x'", f"{_SK} % 2 = 1"),
        _i("kg:league", f"'kg:league/' || ({_SK} % 3)"), _l("kg:nickname", "s_name", None, f"{_SK} % 5 = 0", "vi"),
        _i("kg:manager", f"'kg:coach/' || {_SK}"), _i("kg:manager", f"'kg:coach/' || ({_SK} + 1)", f"{_SK} % 2 = 1"), _i("kg:manager", "'kg:player/1'", f"{_SK} % 3 = 0"),
        _l("kg:managerName", f"'M ' || {_SK}", None, f"{_SK} % 3 = 2"), _i("kg:chairman", f"'kg:player/' || ({_SK} % 5 + 1)"),
        _i("kg:province", "'kg:province/' || s_nationkey"), _i("kg:locatedIn", "'kg:country/1'", f"{_SK} % 2 = 1"),
    ),
    TEAM: _sql(
        TEAM,
        _l("kg:foundingYear", "CASE WHEN o_orderkey % 2 = 0 THEN '1922' ELSE '1923' END", "xsd:gYear", "o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"),
        _l("kg:foundingDate", "'1923-02-01'", "xsd:date", "o_orderkey % 2 = 1 AND o_orderkey % 3 = 0"),
        _l("foaf:homepage", "CASE WHEN o_orderkey % 4 = 0 THEN 'https://a.example/' ELSE 'https://b.example/' END || o_orderkey"), _i("kg:manager", "'kg:player/' || o_custkey"),
    ),
    GROUND: _sql(
        GROUND,
        _l("kg:capacity", f"CASE WHEN {_PK} % 4 = 0 THEN 100 ELSE p_size * 1000 END", COUNT, f"{_PK} % 4 <> 1"), _l("kg:openingYear", f"CASE WHEN {_PK} % 2 = 0 THEN '1999' ELSE '2001' END", "xsd:gYear"),
        _i("kg:tenant", f"'kg:club/' || ({_PK} % 7 + 1)"), _i("kg:owner", f"CASE WHEN {_PK} % 2 = 0 THEN 'kg:player/1' END", f"{_PK} % 2 = 0"), _i("kg:owner", "'kg:province/1'", f"{_PK} % 2 = 0"),
        _i("kg:province", f"'kg:province/' || ({_PK} % 25)"), _i("kg:locatedIn", "'kg:town/9'", f"{_PK} % 2 = 1"),
    ),
    SCHOOL: _sql(
        SCHOOL,
        _l("kg:abbreviation", f"CASE WHEN {_PK} % 2 = 0 THEN p_brand ELSE repeat('ab', 30) END"), _l("kg:motto", "p_type", None, "true", "vi"),
        _l("kg:numberOfStudents", f"CASE WHEN {_PK} % 3 = 0 THEN 2 ELSE p_size END", COUNT), _l("kg:academicStaffSize", "p_size + 1", COUNT),
        _i("kg:rector", "'kg:rector/1'", f"{_PK} % 3 = 1"), _l("kg:rectorName", f"'R ' || {_PK}", None, f"{_PK} % 3 = 2"),
        _l("rdfs:label", "p_name", None, f"{_PK} % 2 = 0", "en"), _l("skos:altLabel", "p_name", None, f"{_PK} % 2 = 1", "en"),
        _i("kg:affiliation", f"'kg:school/' || ({_PK} - 1)", f"{_PK} % 2 = 1"), _i("kg:locatedIn", f"'kg:stadium/' || {_PK}"), _i("kg:province", f"'kg:province/' || ({_PK} % 25)"),
    ),
    AREA: _sql(
        AREA,
        _l("kg:population", f"CASE WHEN {_K} % 2 = 0 THEN 200 ELSE {_K} END", COUNT), _l("kg:populationYear", f"CASE WHEN {_K} % 2 = 0 THEN '2019' ELSE '2022' END", "xsd:gYear", f"{_K} % 2 = 0 OR {_K} % 3 = 0"),
        _l("kg:area", f"CASE WHEN {_K} % 2 = 0 THEN '1234.57' ELSE '12.5' END", "xsd:double"), _l("kg:dissolutionYear", "'2008'", "xsd:gYear", f"{_K} % 5 = 0"),
        _i("rdf:type", "'kg:FormerProvince'", f"{_K} % 5 = 0 OR {_K} % 4 < 2"), _i("kg:successor", "'kg:area/1'", f"{_K} % 5 = 0"), _i("kg:capital", f"'kg:town/' || ({_K} % 9)"),
        _i("kg:region", f"'kg:coast/' || ({_K} % 3)"), _l("kg:administrativeCode", f"'VN-' || {_K}"),
    ),
    LAND: _sql(
        LAND,
        _l("kg:population", _SK, COUNT), _l("kg:populationYear", "'2020'", "xsd:gYear"), _l("kg:area", f"round_even({_SK} * 100.5, 0) / 100", "xsd:double"),
        _i("kg:capital", "'kg:town/1'"), _i("kg:capital", "'kg:town/2'", f"{_SK} % 2 = 1"),
    ),
}


@query("m20_player_triples", SQL[PLAYER])
def m20(spark, d):
    return triples(spark, d, PLAYER)


@query("m26_club_triples", SQL[CLUB])
def m26(spark, d):
    return triples(spark, d, CLUB)


@query("m27_people_triples", f"SELECT * FROM ({SQL[CLUB]} UNION {SQL[TEAM]}) WHERE p IN ('kg:manager', 'kg:managerName', 'kg:chairman')")
def m27(spark, d):
    people = ["manager", "chairman"]
    types = graph(spark, d).where(F.col("p") == TYPE).where(F.col("o").isin(PLAYER, CLUB)).select(F.col("s").alias("value"), F.col("o").alias("target"))
    v = values(spark, d, CLUB).unionByName(values(spark, d, TEAM)).where(F.col("prop").isin(people))
    nowhere = spark.createDataFrame([], "place string, province string")
    return P.produce(v, types, nowhere, [r for r in RULES if r.prop in people])


@query("m28_team_triples", SQL[TEAM])
def m28(spark, d):
    return triples(spark, d, TEAM)


@query("m29_stadium_triples", SQL[GROUND])
def m29(spark, d):
    return triples(spark, d, GROUND)


@query("m30_university_triples", SQL[SCHOOL])
def m30(spark, d):
    return triples(spark, d, SCHOOL)


@query("m32_province_triples", SQL[AREA])
def m32(spark, d):
    return triples(spark, d, AREA)


@query("m34_country_triples", SQL[LAND])
def m34(spark, d):
    return triples(spark, d, LAND)


#: Group of the triples of each class.
GROUPS = {PLAYER: "players", CLUB: "teams", TEAM: "teams", GROUND: "places", SCHOOL: "places", AREA: "places", LAND: "places"}


@query("m35_all_triples", " UNION ".join(f"SELECT '{GROUPS[c]}' AS grp, * FROM ({SQL[c]})" for c in GROUPS))
def m35(spark, d):
    records = [table(spark, d, SPECS[c][0]).selectExpr(f"{SPECS[c][1]} as entity", f"'{c}' as cls") for c in GROUPS]
    return P.build(reduce(DataFrame.unionByName, records), triples(spark, d, *GROUPS, once=False), GROUPS)
