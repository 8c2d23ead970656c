"""What the fixpoint shuffles and writes, and queries that need no written graph."""

from graphloom.operators import inference as R
from graphloom.operators import parts as P
from pyspark.sql import functions as F

FACTS = [("p1", "kg:careerStation", "s1"), ("p1", "kg:careerStation", "s2"), ("s1", "kg:team", "c1"), ("s2", "kg:team", "c1"), ("s1", "rdf:type", "kg:ClubStation"), ("s2", "rdf:type", "kg:NationalTeamStation")]


def frame(spark, rows):
    return spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")


def triples(df):
    return sorted((r.s, r.p, r.o) for r in df.collect())


def test_an_inverse_of_a_concluded_predicate_is_read_from_it(spark):
    """hasPlayer is playedFor read backwards, once each, in no folder of its own."""
    known = R.fixpoint(frame(spark, FACTS + FACTS), R.example_ontology(spark))
    assert [t for t in triples(known.facts(1)) if t[1] in ("kg:playedFor", "kg:hasPlayer")] == [("c1", "kg:hasPlayer", "p1"), ("p1", "kg:playedFor", "c1")]
    assert not [r for r in spark.sql(f"show partitions {known.table}").collect() if "hasPlayer" in r.partition]
    got = triples(known.facts(1, None, ["rdf:type"]))
    assert len(got) == len(set(got)) and ("p1", "rdf:type", "kg:NationalTeamPlayer") in got and ("c1", "rdf:type", "kg:NationalTeam") in got


def test_types_that_a_property_rule_concludes(spark):
    """Any class may follow from a property below rdf:type, so such facts meet all known types and the rounds end."""
    tbox = R.Ontology(**{**R.example_ontology(spark).__dict__, "sub_prop": R.small(spark, [("kg:is", "rdf:type")], "sub string, sup string")})
    got = triples(R.fixpoint(frame(spark, [("x", "kg:is", "kg:Odd"), ("x", "rdf:type", "kg:Odd"), ("y", "kg:is", "kg:Stadium")]), tbox).facts(1))
    assert got == [("y", "rdf:type", "kg:Place"), ("y", "rdf:type", "kg:Stadium")]


def test_trees_are_worked_out_once_for_each_set_of_classes(spark, monkeypatch):
    """300 entities of two kinds, two trees; what is asserted too is not marked as inferred."""
    seen, trees = [], P.trees_of_sets
    monkeypatch.setattr(P, "trees_of_sets", lambda sets, *rest: seen.append(sets.count()) or trees(sets, *rest))
    x = spark.range(300).select(F.concat(F.lit("x"), "id").alias("s"), F.explode(F.when(F.col("id") % 2 == 0, F.expr("array(named_struct('part', 'asserted', 'o', 'kg:A'), named_struct('part', 'inferred', 'o', 'kg:B'), named_struct('part', 'inferred', 'o', 'kg:A'))")).otherwise(F.expr("array(named_struct('part', 'asserted', 'o', 'kg:B'))"))).alias("t"))
    x = x.select("t.part", "s", F.lit("rdf:type").alias("p"), "t.o")
    got = P.class_trees(x, spark.createDataFrame([("kg:A", "kg:B")], "sub string, sup string"), "kg:").collect()
    assert sum(seen) <= 3 and len(seen) == 1
    assert sorted((r.place, r.cls, r.parent, r.inferred) for r in got if r.s == "x4") == [(1, "kg:B", None, True), (2, "kg:A", "kg:B", False)]
    assert [(r.place, r.cls, r.parent, r.inferred) for r in got if r.s == "x5"] == [(1, "kg:B", None, False)] and len(got) == 450


def test_links_need_no_written_graph(spark, sf_dir, monkeypatch):
    """links come from the tables and the derived facts; totals count what the cap leaves out."""
    from graphloom.plans import stored_queries as Q

    monkeypatch.setattr(Q.P, "store", None)
    rows = [("asserted", f"s{n}", "kg:p", "o", "iri") for n in range(5)] + [("inferred", "s1", "kg:p", "o", "iri"), ("inferred", "s9", "kg:a", "o", "iri"), ("asserted", "s4", "rdfs:label", "A", "lit")]
    t = spark.createDataFrame(rows, "part string, s string, p string, o string, o_kind string")
    got = sorted(tuple(r) for r in P.referenced_by(t, 2).collect())
    assert got == [("o", "kg:a", 2, 1, 1, "s9", True), ("o", "kg:p", 1, 5, 1, "s4", False), ("o", "kg:p", 1, 5, 2, "s0", False)]
    assert sorted((r.subject, r.object) for r in P.labelled_edges(t).where("property = 'p'").collect()) == [("A", "o")] + [(f"s{n}", "o") for n in range(4)]
    assert Q.b23(spark, sf_dir).columns == ["subject", "property", "object", "inferred"]


def test_what_holds_both_ways_is_labelled_once(spark):
    """hasPlayer is shuffled and labelled with playedFor, whose facts are its own read backwards."""
    rows = [*FACTS, ("c2", "rdf:type", "kg:ClubStation"), ("p1", "kg:careerStation", "s3"), ("s3", "kg:team", "_:b")]
    known = R.fixpoint(frame(spark, rows), R.example_ontology(spark))
    once = [(r.s, r.p, r.o, [(n.p, n.turned) for n in r.names]) for r in R.useful_once(known).where("p <> 'rdf:type'").collect()]
    assert sorted(once) == [("p1", "kg:playedFor", "_:b", [("kg:playedFor", False)]), ("p1", "kg:playedFor", "c1", [("kg:playedFor", False), ("kg:hasPlayer", True)])]
    label = spark.createDataFrame([("p1", "rdfs:label", "Ann", "lit"), ("c1", "rdfs:label", "Club", "lit")], "s string, p string, o string, o_kind string")
    given = frame(spark, [*rows, rows[0]]).unionByName(label).select(F.lit("asserted").alias("part"), "*")
    both = given.unionByName(R.useful(known).select(F.lit("inferred").alias("part"), "s", "p", "o", "o_kind"))
    got = sorted(map(tuple, P.labelled_edges(given, R.useful_once(known), known.written()).collect()))
    assert got == sorted(map(tuple, P.labelled_edges(both).collect())) and ("Club", "hasPlayer", "Ann", True) in got and ("_:b", "hasPlayer", "Ann", True) not in got
