"""What the rules for records shuffle."""

from pyspark.sql import functions as F

from graphloom.operators import producers as P
from graphloom.operators.producers import Rule

RULES = [
    Rule("c", "place", "in", split="at", best=False, allow=("kg:Province",)), Rule("c", "name", "called", "called", how="pick", lang="vi"),
    Rule("c", "boss", "led", allow=("kg:Person",)), Rule("c", "place", "within", best=False, within=True, allow=()),
]
VALUES = "entity string, cls string, source string, prop string, ord int, kind string, value string, preferred boolean, at string"


def _frames(spark):
    rows = [
        ("e1", "c", "structured", "place", 0, "iri", "p1", False, None), ("e1", "c", "box", "place", 1, "iri", "x", False, None), ("e1", "c", "box", "name", 0, "lit", "b", False, None),
        ("e1", "c", "structured", "name", 1, "lit", "a", False, None), ("e2", "c", "structured", "boss", 0, "iri", "m", True, None), ("e2", "c", "structured", "boss", 1, "iri", "n", False, None),
        ("e2", "c", "box", "boss", 0, "iri", "k", False, None), ("e2", "c", "box", "boss", 0, "iri", "x", False, None), (None, "c", "box", "name", 0, "lit", "z", None, None),
        ("e2", "c", "box", "place", 0, None, "q", None, None), ("e3", "c", "box", "other", 0, "lit", "q", None, None), ("e3", "c", "box", "name", 0, "lit", None, None, None),
    ]
    classes = spark.createDataFrame([("p1", "kg:Province"), ("p1", "kg:Province"), ("x", "kg:Club"), ("k", "kg:Person")], "value string, target string")
    return spark.createDataFrame([*rows, *rows[:4]], VALUES), classes, spark.createDataFrame([("p1", "v1"), ("p1", "v2"), ("x", "v3")], "place string, province string")


def _nodes(plan, out):
    out.append(plan)
    children = plan.children()
    for k in range(children.size()):
        _nodes(children.apply(k), out)
    return out


def test_windows_get_the_number_of_a_rule_and_none_of_its_fields(spark):
    """every value was shuffled three times, with the thirty fields of its rule from the second on."""
    out = P.produce(*_frames(spark), RULES)
    got = {(r.s, r.p, r.o) for r in out.collect()}
    assert got == {("e1", "at", "p1"), ("e1", "called", "a"), ("e2", "led", "m"), ("e2", "led", "k"), ("e1", "within", "v1"), ("e1", "within", "v2"), (None, "called", "z")}
    windows = [x for x in _nodes(out._jdf.queryExecution().sparkPlan(), []) if x.nodeName() == "Window"]
    names = windows[-1].children().apply(0).output().mkString(" ")
    assert "rule#" in names and not any(f"{c}#" in names for c in ("allow", "dt", "lang", "how", "split"))


def test_records_and_triples_meet_in_one_shuffle_of_the_triples(spark):
    values, classes, within = _frames(spark)
    records = spark.createDataFrame([("e1", "c"), ("e1", "c"), ("e2", "d"), (None, "c")], "entity string, cls string")
    out = P.build(records, P.produce(values, classes, within, RULES, once=False), {"c": "g"})
    assert sorted((r.grp, r.s, r.p, r.o) for r in out.collect()) == [("g", "e1", "at", "p1"), ("g", "e1", "called", "a"), ("g", "e1", "within", "v1"), ("g", "e1", "within", "v2")]
    before = P.build(records, P.produce(values, classes, within, RULES), {"c": "g"})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, before.where(F.lit(True)).collect()))
