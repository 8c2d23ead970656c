"""The written inferred part, answers to single goals, and what proposals add: against the plain fixpoint."""

import pytest

from graphloom.operators import goals as Goals
from graphloom.operators import inference as R
from graphloom.operators import parts as P
from graphloom.operators import proposals as W
from pyspark.sql import functions as F

ROWS = [
    ("kg:player/1", "rdf:type", "kg:FootballPlayer"), ("kg:player/2", "rdf:type", "kg:FootballPlayer"), ("kg:player/1", "kg:birthProvince", "kg:province/1"),
    ("kg:player/1", "kg:careerStation", "kg:station/1"), ("kg:player/2", "kg:careerStation", "kg:station/2"), ("kg:station/1", "rdf:type", "kg:ClubStation"),
    ("kg:station/2", "rdf:type", "kg:NationalTeamStation"), ("kg:station/1", "kg:team", "kg:club/1"), ("kg:station/2", "kg:team", "kg:club/2"), ("kg:club/3", "rdf:type", "kg:Team"),
    ("kg:province/2", "kg:successor", "kg:province/1"), ("kg:province/1", "rdf:type", "kg:Province"), ("kg:province/2", "rdf:type", "kg:FormerProvince"),
    ("kg:province/1", "kg:locatedIn", "kg:country/1"), ("kg:country/1", "rdf:type", "kg:Country"),
]


def frame(spark, rows):
    return spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")


def triples(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


@pytest.fixture(scope="module")
def tbox(spark):
    return R.example_ontology(spark)


@pytest.fixture(scope="module")
def every(spark, tbox):
    return triples(R.materialise(frame(spark, ROWS), tbox))


@pytest.fixture(scope="module")
def stored(spark, tbox):
    given = frame(spark, ROWS).select(F.lit("asserted").alias("part"), "s", "p", "o", "o_kind", F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    return P.store(given, R.inferred(frame(spark, ROWS), tbox), tbox)


def test_rounds_keep_each_fact_once(spark, tbox, every):
    again = R.materialise(frame(spark, ROWS + ROWS), tbox)
    assert again.count() == len(every)
    assert R.materialise(frame(spark, []), tbox).count() == 0
    assert triples(R.materialise(frame(spark, ROWS), tbox, "none")) == set(ROWS)
    assert R.inferred(frame(spark, []), tbox).count() == 0


def test_marks_need_no_shuffle(spark, stored, every):
    for df in (P.marked(stored), P.triple_counts(stored)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = P.marked(stored).where("p not like 'rdfs:%' and p not like 'owl:%'").collect()
    assert {(r.s, r.p, r.o) for r in got} == every
    assert {(r.s, r.p, r.o) for r in got if not r.inferred} == set(ROWS)
    assert {r.part for r in P.asserted_view(stored).select("part").distinct().collect()} == {"asserted", "ontology"}


def test_class_tree_with_two_parents(spark):
    types = [("x", c, part) for c, part in (("kg:A", "asserted"), ("kg:B", "inferred"), ("up:C", "inferred"), ("kg:D", "inferred"), ("up:Z", "asserted"))]
    rows = spark.createDataFrame([(part, s, "rdf:type", c, "iri", None, None) for s, c, part in types], "part string, s string, p string, o string, o_kind string, dt string, lang string")
    edges = [("kg:A", "kg:B"), ("kg:A", "up:C"), ("kg:B", "kg:D"), ("up:C", "kg:D"), ("kg:A", "kg:D"), ("kg:B", "kg:Missing"), ("kg:A", "kg:A")]
    got = P.class_trees(rows, spark.createDataFrame(edges, "sub string, sup string"), "kg:").orderBy("place").collect()
    assert [(r.cls, r.parent, r.also, r.inferred) for r in got] == [
        ("up:Z", None, "", False), ("kg:D", None, "", True), ("up:C", "kg:D", "", True), ("kg:B", "kg:D", "", True), ("kg:A", "kg:B", "up:C", False),
    ]


@pytest.mark.parametrize("unfold", [0, 8, 1000])
def test_goals_give_what_the_fixpoint_gives(spark, tbox, every, unfold, monkeypatch):
    monkeypatch.setattr(Goals, "UNFOLD", unfold)
    rules, given = Goals.Rules(tbox), frame(spark, ROWS)
    for p, s, o in (("kg:playedFor", None, ["kg:club/2"]), ("kg:hasPlayer", ["kg:club/1"], None), ("kg:birthPlace", None, None), ("kg:predecessor", None, None), ("kg:none", None, None)):
        want = {t for t in every if t[1] == p and (s is None or t[0] in s) and (o is None or t[2] in o)}
        assert triples(Goals.ask_edges(given, rules, p, s, o)) == want
    for cls in ("kg:NationalTeamPlayer", "kg:Team") if unfold else ("kg:Place",):
        assert {r.s for r in Goals.ask_members(given, rules, [cls]).collect()} == {s for s, p, c in every if p == "rdf:type" and c == cls}


def test_a_goal_that_needs_itself(spark, tbox):
    loop = R.Ontology(**{**tbox.__dict__, "chain": R.small(spark, [("kg:in", "kg:in", "kg:in")], "p string, p1 string, p2 string")})
    given = frame(spark, [("a", "kg:in", "b"), ("b", "kg:in", "c"), ("c", "kg:in", "d")])
    assert triples(Goals.ask_edges(given, Goals.Rules(loop), "kg:in", s=["a"])) == {("a", "kg:in", x) for x in "bcd"}
    preds, classes = Goals.needed(Goals.Rules(tbox), ["kg:playedFor"])
    assert preds == {"kg:playedFor", "kg:hasPlayer", "kg:careerStation", "kg:team"} and not classes


PROPOSED = [
    (1, "kg:player/1", "kg:careerStation", "kg:station/2"), (2, "kg:country/1", "kg:careerStation", "kg:station/2"), (3, "kg:club/3", "kg:hasPlayer", "kg:province/1"), (4, "kg:player/1", "rdf:type", "kg:NationalTeam"),
    (5, "kg:player/1", "rdf:type", "kg:FootballPlayer"), (6, "kg:station/1", "kg:team", "kg:province/2"), (7, "kg:new/1", "kg:unknown", "kg:new/2"), (8, "kg:station/9", "kg:team", "kg:club/3"),
]


def test_proposals_add_what_the_fixpoint_of_each_adds(spark, tbox, every, stored):
    proposed = spark.createDataFrame([(*r, "iri") for r in PROPOSED], "id int, s string, p string, o string, o_kind string")
    added = W.consequences(proposed, stored, tbox)
    got = {}
    for r in added.collect():
        got.setdefault(r.id, set()).add((r.s, r.p, r.o))
    for id_, *t in PROPOSED:
        assert got.get(id_, set()) == triples(R.materialise(frame(spark, [*ROWS, tuple(t)]), tbox)) - every, id_
    gained = {(r.id, r.node, r.cls) for r in W.gained_classes(proposed, added, "kg:").collect()}
    assert (4, "kg:player/1", "kg:NationalTeam") in gained and (2, "kg:country/1", "kg:NationalTeamPlayer") in gained and not any(i == 5 for i, _, _ in gained)
    assert all(n in (s, o) for i, n, _ in gained for k, s, _, o in PROPOSED if k == i)
    assert {r.id: (r.domain, r.range) for r in W.property_axioms(proposed, tbox.prop).collect()}[7] == (None, None)


def test_facts_are_told_apart_without_sorts_and_rounds_are_kept(spark):
    """A round's facts are new ones, once each, in the table of all facts; their duplicates cost no sort."""
    from graphloom.operators.inference import FACT, Known

    rows = [("kg:a", "kg:p", "kg:b", "iri"), ("kg:a", "kg:p", "kg:b", "iri"), ("kg:a", "rdf:type", "kg:C", "iri")]
    known = Known(spark)
    first = known.add(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FACT)))
    again = known.add(spark.createDataFrame([*rows, ("kg:b", "kg:q/r", "kg:a", "iri")], ", ".join(f"{c} string" for c in FACT)))
    assert first == {"kg:p", "rdf:type"} and again == {"kg:q/r"}
    assert known.add(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FACT))) == set()
    assert sorted(map(tuple, known.facts().collect())) == sorted({*rows, ("kg:b", "kg:q/r", "kg:a", "iri")})
    assert [tuple(r) for r in known.facts(1).collect()] == [("kg:b", "kg:q/r", "kg:a", "iri")]
    assert {c.name for c in spark.catalog.listColumns(known.table)} == {"k", "s", "p", "o", "o_kind", "round"}


def test_asserted_view_works_out_no_inference(spark, sf_dir, monkeypatch):
    from graphloom.plans import stored_queries as Q

    monkeypatch.setattr(Q.R, "inferred", None)
    monkeypatch.setattr(Q, "_DERIVED", {})
    monkeypatch.setattr(Q, "_STORED", {})
    assert Q.s06(spark, sf_dir).count() == 16


def test_given_facts_that_no_rule_concludes_are_not_shuffled_and_inverses_do_not_lead_back(spark, tbox, every, monkeypatch):
    added, inverted = [], []
    add, inverse = R.Known.add, R.rule_inverse
    monkeypatch.setattr(R.Known, "add", lambda self, found: added.append({r.p for r in found.select("p").distinct().collect()}) or add(self, found))
    monkeypatch.setattr(R, "rule_inverse", lambda facts, axioms: inverted.append({r.p for r in facts.select("p").distinct().collect()}) or inverse(facts, axioms))
    known = R.fixpoint(frame(spark, ROWS + ROWS), tbox)
    assert added[0] == {"rdf:type", "kg:successor", "kg:locatedIn"} and set().union(*inverted) == {"kg:successor", "kg:playedFor"}
    assert triples(known.facts()) == every
    given = [("a", "kg:p", "b"), ("a", "kg:p", "b"), ("c", "kg:q", "a")]  # q has two inverses, and p and q are both given
    more = R.Ontology(**{**tbox.__dict__, "inverse": R.small(spark, [("kg:p", "kg:q"), ("kg:q", "kg:r")], "p string, q string")})
    assert triples(R.materialise(frame(spark, given), more)) == {("a", "kg:p", "b"), ("b", "kg:q", "a"), ("a", "kg:r", "b"), ("c", "kg:q", "a"), ("a", "kg:p", "c"), ("a", "kg:r", "c")}
