"""Operators on small graphs: cycles, disjointness, blank nodes, escapes, empty inputs."""

import pytest

from graphloom.functions import terms as N
from graphloom.functions import wikitext as X
from graphloom.operators.chains import final_successor
from graphloom.operators import closure as H
from graphloom.operators import fusion as M
from graphloom.operators import inference as R
from graphloom.operators import patterns as G
from graphloom.operators import quality as Q
from graphloom.operators import views as V
from graphloom.sources import landed, ntriples
from pyspark.sql import functions as F


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def facts(spark, *rows):
    return spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "sub string, sup string")
    assert pairs(H.closure(e), "sub", "sup") == sorted([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "a"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "d")])


def test_closure_of_nothing(spark):
    assert H.closure(spark.createDataFrame([], "sub string, sup string")).count() == 0


def test_succession_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("a", "z")], "node string, successor string")
    got = dict(pairs(final_successor(e), "node", "final"))
    assert got == {"a": "c", "b": "c", "x": "x", "y": "y"}


def test_inference_rules(spark):
    o = R.example_ontology(spark)
    f = facts(
        spark, ("kg:p", "rdf:type", "kg:FootballPlayer"), ("kg:p", "kg:birthProvince", "kg:x"), ("kg:p", "kg:careerStation", "kg:s1"), ("kg:p", "kg:careerStation", "kg:s2"),
        ("kg:s1", "rdf:type", "kg:ClubStation"), ("kg:s2", "rdf:type", "kg:NationalTeamStation"), ("kg:s1", "kg:team", "kg:c"), ("kg:s2", "kg:team", "kg:n"),
        ("kg:p", "owl:sameAs", "ext:1"),
    )
    got = set(pairs(R.inferred(f, o), "s", "p", "o"))
    for t in [("kg:p", "rdf:type", "up:Agent"), ("kg:p", "kg:birthPlace", "kg:x"), ("kg:p", "kg:playedFor", "kg:c"), ("kg:c", "kg:hasPlayer", "kg:p"),
              ("kg:c", "rdf:type", "kg:FootballClub"), ("kg:n", "rdf:type", "kg:NationalTeam"), ("kg:p", "rdf:type", "kg:NationalTeamPlayer"), ("kg:x", "rdf:type", "kg:Place")]:
        assert t in got
    assert not any("sameAs" in p or s == "ext:1" for s, p, _ in got)
    assert R.disjointness(R.materialise(f, o), o.disjoint).count() == 0
    clash = f.union(facts(spark, ("kg:c", "rdf:type", "kg:Province")))
    assert ("kg:c", "kg:Place", "kg:Team") in pairs(R.disjointness(R.materialise(clash, o), o.disjoint), "s", "a", "b")


def test_patterns(spark):
    t = facts(spark, ("a", "knows", "a"), ("a", "knows", "b"), ("b", "knows", "c")).withColumn("part", F.lit("asserted"))
    assert pairs(G.pattern(t, "?x", "knows", "?x"), "x") == [("a",)]
    assert pairs(G.bgp(t, ("?x", "knows", "?y"), ("?y", "knows", "?z")), "x", "z") == [("a", "a"), ("a", "b"), ("a", "c")]
    assert G.ask(G.pattern(t, "c", "knows", "?x")).first()[0] is False


def test_ntriples_round_trip(spark, tmp_path):
    t = spark.createDataFrame(
        [("asserted", "_:b1", "p", 'a "quoted" \\ line\nnext\ttab \\n', "lit", None, "en"), ("asserted", "s", "p", "x", "iri", None, None), ("inferred", "s", "q", "5", "lit", "xsd:integer", None), ("inferred", "s", "r", "_:b1", "bnode", None, None), ("asserted", "s", "e", "", "lit", None, None)],
        "part string, s string, p string, o string, o_kind string, dt string, lang string",
    )
    ntriples.write(t, str(tmp_path / "dump"))
    assert sorted(map(str, ntriples.read(spark, str(tmp_path / "dump")).collect())) == sorted(map(str, t.collect()))


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (N.integer, "khoảng 1.234 người", 1234), (N.integer, "none", None), (N.decimal, "16.361,2 km", 16361.2), (N.decimal, "1.234", 1234.0), (N.decimal, "1,85 m", 1.85),
        (N.height, "185 cm", 1.85), (N.height, "3.1 m", None), (N.year, "in 1999.", 1999), (N.year, "12345", None), (N.leading_year, "-0300-01-01", -300), (N.read_integer, "-44", -44),
        (N.fold, "Đà_Nẵng", "da nang"), (N.norm_title, "  hà__nội ", "Hà nội"), (N.iri_local, "a b?", "A_b%3F"), (N.safe_iri, "https://a b", None), (N.property_name, "2nd club-name!", "_2ndClubName"),
        (X.render, "[[A|b]]<ref>x</ref> ''c'' ()", "b c"), (X.first_url, "see example.org/x", "http://example.org/x"),
    ],
)
def test_expressions(spark, f, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_year_range_and_date(spark):
    d = spark.createDataFrame([("2015–",), ("2015",), ("2010–2012",), ("none",)], "x string").select(N.year_range(F.col("x")).alias("r")).select("r.*")
    assert [tuple(r) for r in d.collect()] == [(2015, None), (2015, 2015), (2010, 2012), (None, None)]
    d = spark.createDataFrame([("5 March 1990",), ("31/02/1990",), ("March 1990",), ("c. 1990",)], "x string").select(N.date(F.col("x")).alias("r")).select("r.*")
    assert [tuple(r) for r in d.collect()] == [("1990-03-05", "date"), ("1990", "gYear"), ("1990-03", "gYearMonth"), ("1990", "gYear")]


def test_params_of_nested_templates(spark):
    d = spark.createDataFrame([("Infobox x | a = {{b|c={{d|e}}|f}} | g = [[h|i]] | a2 = | a = last",)], "x string").select(X.params(F.col("x")))
    assert d.first()[0] == {"g": "[[h|i]]", "a": "last"}


DEEP = "{{short|x}} {{Infobox club | name = {{plainlist|{{small|{{nowrap|{{lang|vi|b}}}}}}|class=c|[[A|d]]}} | ill = {{ill|An|fr|Ana}} | n = {{ubl|a|b|c}} | s = {{sort|1|Zed}} | e = {{end date|2001|2|3}} | p = {{plainlist|\n* x\n* y\n}} | q = {{abbr|No|Number}} | z = {{Infobox sub | y = 1}}}} {{Known_name | k = v}} tail"


def test_deep_templates(spark):
    d = spark.createDataFrame([(DEEP,), ("{{Infobox a | b {{x | c }} {{Infobox d | e = f}}",), ("none",), (None,)], "x string")
    body = X.infobox(F.col("x"))
    got = d.select(body.alias("b"), X.params(body).alias("p")).collect()
    assert got[0].b.endswith("| z = {{Infobox sub | y = 1}}") and got[1].b == "Infobox d | e = f" and got[2].b == "" and got[3].b is None
    p = d.limit(1).select(F.explode(X.params(body)).alias("k", "v")).select("k", X.render(F.col("v")).alias("v"))
    assert {r.k: r.v for r in p.collect()} == {"name": "b; d", "ill": "An", "n": "a; b; c", "s": "Zed", "e": "2001-02-03", "p": "x; y", "q": "No", "z": ""}
    assert d.select(X.infobox(F.col("x"), ("known name",))).first()[0] == "Known_name | k = v"


def test_official_sites(spark):
    d = spark.createDataFrame([("a {{url|no.example}}\n== External links ==\n* {{Official website|www.club.example}}\n* [https://b.example/x B]\n* {{url|1=http://c.example}}\n== Notes ==\nhttp://d.example",)], "x string")
    assert d.select(X.external_links(F.col("x"))).first()[0] == ["http://www.club.example", "https://b.example/x", "http://c.example"]


def test_search_answers_short_queries(spark):
    names = spark.createDataFrame([("e1", "Abc", "abc"), ("e2", "x", "x"), ("e3", "ca x", "ca x")], "entity string, name string, folded string")
    queries = spark.createDataFrame([(1, "X"), (2, " c "), (3, "ab"), (4, ""), (5, "ca  x")], "qid int, text string")
    assert pairs(V.search(names, queries, 3), "qid", "entity", "place") == [(1, "e2", 1), (1, "e3", 2), (2, "e1", 2), (2, "e3", 1), (3, "e1", 1), (5, "e3", 1)]


def test_raw_properties(spark):
    d = spark.createDataFrame([("s", "a", "007"), ("s", "b", "x" * 501), ("s", "c", "x" * 500), ("s", "d", "[[t]]"), ("s", "e", "1a")], "s string, key string, raw string")
    assert {(r.p, r.o, r.o_kind, r.dt) for r in M.raw_properties(d).collect()} == {("a", "7", "lit", "xsd:integer"), ("c", "x" * 500, "lit", None), ("d", "T", "iri", None), ("e", "1a", "lit", None)}


def test_fusion(spark):
    s = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False), (2, 4, False)], "k int, v int, pref boolean")
    assert pairs(M.best(s, ["k"], F.col("pref")), "k", "v") == [(1, 1), (2, 3), (2, 4)]
    p = spark.createDataFrame([("a", 5, None), ("a", 7, "2019-01-01"), ("a", 9, "2020-05-01")], "k string, v int, t string")
    assert pairs(M.latest(p, "k", "v", "t"), "k", "v", "year") == [("a", 9, 2020)]


def test_merge_pages(spark):
    p = spark.createDataFrame([("t", 2, ["c"], None, "y"), ("t", 1, ["a", "b"], None, "x"), ("t", 3, [], 7, None)], "title string, n int, links array<string>, rev int, touched string")
    r = landed.merge_pages(p, "title", "n", ["links"], ["rev"], ["touched"]).first()
    assert (r.links, r.rev, r.touched) == (["a", "b", "c"], 7, "y")


def test_strict_quality(spark):
    t = spark.createDataFrame([("s", "lit", "xsd:integer", "x")], "s string, o_kind string, dt string, o string")
    with pytest.raises(ValueError, match="1 data-quality"):
        Q.strict(Q.ill_typed(t))


def test_lanes_and_mentions(spark):
    s = spark.createDataFrame([(1, 10, 2000, 2003), (1, 11, 2001, 2002), (1, 12, 2002, 2005), (1, 13, 2003, 2004)], "k int, id long, start int, end int")
    assert dict(pairs(V.lanes(s, ["k"]), "id", "lane")) == {10: 0, 11: 1, 12: 1, 13: 0}


def test_conflicts_none_for_a_fitting_triple(spark):
    o = R.example_ontology(spark)
    types = spark.createDataFrame([("kg:p", "kg:FootballPlayer"), ("kg:c", "kg:FootballClub")], "s string, cls string")
    p = spark.createDataFrame([(1, "kg:p", "kg:playedFor", "kg:c"), (2, "kg:c", "kg:playedFor", "kg:p")], "id int, s string, p string, o string")
    got = V.conflicts(p, types, o.prop, o.sub_class, o.disjoint)
    assert {r.id for r in got.collect()} == {2}


def one(spark, text, *exprs):
    df = spark.createDataFrame([(text,)], "t string")
    return tuple(df.select(*[e(F.col("t")).alias(f"c{k}") for k, e in enumerate(exprs)]).first())


@pytest.mark.parametrize(
    ("text", "value"),
    [("2010 150 caps", 2010), ("39.220", 39220), ("40,192 seats", 40192), ("39 220", 39220), ("about 5.000 people", 5000), ("none", None), ("1234.567", 1234)],
)
def test_integers(spark, text, value):
    assert one(spark, text, N.integer) == (value,)


@pytest.mark.parametrize(
    ("text", "value", "precision"),
    [
        ("ngày 12 tháng 4 năm 1997", "1997-04-12", "date"), ("March 5, 1990", "1990-03-05", "date"), ("5 March 1990", "1990-03-05", "date"), ("1997-04", "1997-04", "gYearMonth"),
        ("12-4-1997", "1997-04-12", "date"), ("12/04/1997 (age 20)", "1997-04-12", "date"), ("tháng 4 năm 1997", "1997-04", "gYearMonth"), ("May 2001", "2001-05", "gYearMonth"),
        ("season 2001", "2001", "gYear"), ("1990-02-31", "1990", "gYear"), ("x", None, None),
    ],
)
def test_dates(spark, text, value, precision):
    assert tuple(one(spark, text, N.date)[0]) == (value, precision)


def test_other_values(spark):
    ranges = {"2015–2019": (2015, 2019), "2015—": (2015, None), "2015 − nay": (2015, None), "2015": (2015, 2015), "2015-present": (2015, None), "x": (None, None)}
    assert {k: tuple(one(spark, k, N.year_range)[0]) for k in ranges} == ranges
    assert [one(spark, t, N.height)[0] for t in ("172 cm", "1,72 m", "1.72", "17 cm", "180")] == [1.72, 1.72, 1.72, None, 1.8]
    assert [one(spark, t, N.on_loan)[0] for t in ("A (loan)", "A (cho mượn)", "→ A", "A mượn", "Loaner", "A (on loan)")] == [True, True, True, True, False, False]
    names = {"imageSize": "imageSize", "ngày thành lập": "ngàyThànhLập", "a/b c": "aBC", "1 x": "_1X", "Full_name": "fullName"}
    assert {k: one(spark, k, N.property_name)[0] for k in names} == names
    urls = {"see https://a.vn/x.": "https://a.vn/x", "at www.b.com.vn/p, or": "http://www.b.com.vn/p", "e.g. this or that.": None, "mail a@b.com": None}
    assert {k: one(spark, k, X.first_url)[0] for k in urls} == urls
    keys = {"altitude": False, "alt": True, "bodyweight": False, "body2": True, "Image": True, "pattern_la1": True, "name": False, "caption3": True, "kit_alt": True}
    assert {k: one(spark, k, X.skipped)[0] for k in keys} == keys


def test_rendered_templates(spark):
    cases = {
        "{{birth date|1950|3|7}}": "1950-03-07", "{{ngày sinh và tuổi|1997|12|1}}": "1997-12-01", "{{start date|1999|5}}": "1999-05", "{{height|m=1.80}}": "1.80 m",
        "{{height|cm=180}}": "180 cm", "{{convert|12|km2}}": "12 km2", "{{nowrap|{{small|x}}}}": "x", "{{plainlist|a|b}}": "a; b", "{{url|a.vn}}": "a.vn", "{{unknown|x}}": "",
    }
    assert {k: one(spark, k, X.render)[0] for k in cases} == cases
    got = one(spark, "{{Infobox x|a = 1 |b=[[c|d]]| a=2|e=|f={{g|h=i}}}}", lambda t: X.params(X.infobox(t)))[0]
    assert got == {"a": "2", "b": "[[c|d]]", "f": "{{g|h=i}}"}
