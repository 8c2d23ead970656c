"""Chains of successors by pointer jumping, held against following them one by one."""

import random

import pytest

from graphloom.operators import chains
from graphloom.operators.chains import final_successor
from graphloom.operators.units import unit_lists, unit_table
from graphloom.sources.landed import resolve_chains


def walked(edges, going=None):
    """node -> (final, cycle) by walking."""
    after = {}
    for a, b in edges:
        if a is not None and b is not None and (going is None or a in going):
            after[a] = min(b, after.get(a, b))
    out = {}
    for start in after:
        at, seen = start, set()
        while at in after and at not in seen:
            seen.add(at)
            at = after[at]
        out[start] = (at, at in after)
    return out


def followed(spark, edges, going=None):
    e = spark.createDataFrame(edges, "node int, successor int")
    g = None if going is None else spark.createDataFrame([(x,) for x in going], "node int")
    return {r.node: (r.final, r.cycle) for r in final_successor(e, g).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_steps(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(None, 1), (1, None), (3, 3)]
    going = [x for x in range(60) if rnd.random() < 0.9]
    assert followed(spark, edges) == walked(edges)
    assert followed(spark, edges, going) == walked(edges, set(going))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(chains, "held", lambda df, name, f=chains.held: writes.append(name) or f(df, name))
    edges = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2001), (5, 6)]
    assert followed(spark, edges) == walked(edges)
    assert len(writes) < 24


def test_a_current_unit_stops_a_chain(spark):
    assert followed(spark, [(1, 2), (2, 3), (3, 4)], [1, 2]) == {1: (3, False), 2: (3, False)}


def test_no_steps(spark):
    assert followed(spark, []) == {}


def test_units_by_era(spark):
    units = spark.createDataFrame([("old", True, 1990), ("mid", True, None), ("now", False, None), ("far", False, None)], "unit string, former boolean, year int")
    succession = spark.createDataFrame([("old", "mid"), ("mid", "now"), ("now", "far")], "node string, successor string")
    members = spark.createDataFrame([("old", "player", "a"), ("now", "player", "a"), ("now", "player", "b"), ("mid", "club", "c")], "unit string, kind string, member string")
    t = {r.unit: r for r in unit_table(units, members, succession, ["player", "club"]).collect()}
    assert (t["old"].final, t["old"].player, t["old"].group_player, t["old"].year) == ("now", 1, None, 1990)
    assert (t["now"].final, t["now"].player, t["now"].group_player, t["now"].group_club) == ("now", 2, 2, 1)
    assert (t["far"].player, t["far"].group_player) == (0, 0)
    labels = spark.createDataFrame([("a", "Zoe"), ("b", "Amy")], "member string, label string")
    rows = unit_lists(units, members, succession, labels, spark.createDataFrame([("a", 3)], "member string, n long"), 1).collect()
    assert sorted((r.unit, r.era, r.kind, r.member, r.total) for r in rows) == [
        ("mid", "before", "club", "c", 1), ("now", "after", "club", "c", 1), ("now", "after", "player", "a", 2), ("now", "before", "player", "a", 2), ("old", "before", "player", "a", 1),
    ]


def test_aliases_end_at_records(spark):
    asked = spark.createDataFrame([("a",), ("d",), ("x",), ("x",)], "title string")
    alias = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "source string, target string")
    got = resolve_chains(asked, alias, spark.createDataFrame([("d", 7)], "target string, page int")).collect()
    assert sorted((r.title, r.target, r.page) for r in got) == [("a", "d", 7), ("d", "d", 7), ("x", "x", None)]
