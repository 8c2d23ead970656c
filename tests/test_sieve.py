"""Sieves of keys, and proposals that meet the graph through them."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import inference as R
from graphloom.operators import parts as P
from graphloom.operators import proposals as W
from graphloom.operators.closure import held
from graphloom.operators.sieve import sifted
from graphloom.plans import QUERIES

ROWS = [
    ("p1", "rdf:type", "kg:FootballPlayer"), ("p1", "kg:careerStation", "s1"), ("s1", "rdf:type", "kg:NationalTeamStation"), ("s1", "kg:team", "c1"), ("s2", "kg:team", "c2"),
    ("s2", "rdf:type", "kg:ClubStation"), ("c2", "rdf:type", "kg:FootballClub"), ("v1", "rdf:type", "kg:Province"),
]
PROPOSED = [(1, "x", "kg:careerStation", "s1"), (2, "p1", "kg:careerStation", "s2"), (3, "s2", "kg:team", "v1"), (4, "s1", "rdf:type", "kg:ClubStation"), (5, "p1", "rdf:type", "kg:FootballPlayer"), (6, None, "rdf:type", None)]


def test_a_sieve_keeps_its_keys_and_few_others(spark):
    rows = spark.range(100_000).selectExpr("'a' || id as a", "if(id % 5 = 0, null, 'b' || id) as b", "id")
    keys = held(rows.where("id % 100 = 7").select(F.col("a").alias("x"), F.col("b").alias("y")), "keys")
    got = {r.id for r in sifted(rows, ["a", "b"], keys).collect()}
    assert got >= {*range(7, 100_000, 100)} and len(got) < 2 * 1_000
    assert sifted(rows, ["a", "b"], held(keys.limit(0), "none")).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_proposals_of_any_number_add_the_same(spark, few, monkeypatch):
    """the graph is not written for them; of more than FEW proposals it is sifted, not shuffled."""
    monkeypatch.setattr(W, "FEW", few)
    tbox = R.example_ontology(spark)
    frame = lambda rows: spark.createDataFrame([(*r, "iri") for r in rows], "s string, p string, o string, o_kind string")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "s", "p", "o", "o_kind")
    every = {(r.s, r.p, r.o) for r in R.materialise(frame(ROWS), tbox).collect()}
    graph = part(frame(ROWS), "asserted").unionByName(part(R.inferred(frame(ROWS), tbox), "inferred"))
    proposed = spark.createDataFrame([(*r, "iri") for r in PROPOSED], "id int, s string, p string, o string, o_kind string")
    got = {}
    for r in W.consequences(proposed, graph, tbox).where("id < 6").collect():
        got.setdefault(r.id, set()).add((r.s, r.p, r.o))
    for id_, *t in PROPOSED[:5]:
        assert got.get(id_, set()) == {(r.s, r.p, r.o) for r in R.materialise(frame([*ROWS, tuple(t)]), tbox).collect()} - every, id_


def test_w05_does_not_write_the_graph(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(P, "store", lambda *_: pytest.fail("the whole graph is written"))
    monkeypatch.setattr("graphloom.plans.stored_queries._STORED", {})
    assert QUERIES["w05_classes_gained"](spark, sf_dir).count() > 0
