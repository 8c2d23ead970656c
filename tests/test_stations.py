"""Careers by case: teams, loans, fallback to memberships, current clubs, notes, and lanes against a plain packing."""

import random

from graphloom.operators import stations as S
from graphloom.operators.views import lanes

FIELDS = [
    ("a", "Clubs1", "[[Cross]] [[Red FC|Red]]"), ("a", "years1", "2001–2003"), ("a", "caps1", "1.234"), ("a", "goals1", "0"),
    ("a", "CLUBS2", "→ [[Land|The land]] (mượn)"), ("a", "years2", "2002"), ("a", "clubs10", "[[File:x.png]] Blue (cho mượn)"), ("a", "years10", "2005–nay"),
    ("a", "clubs03", "[[Red FC]]"), ("a", "years4", "1999"), ("a", "nationalteam1", "[[Land]]"), ("a", "nationalcaps1", "x"), ("a", "youthclubs1", "[[new place]]"),
    ("b", "nationalteam1", "[[Red FC]]"), ("c", "name", "C"), ("a", "clubs11", None),
]


def _data(spark):
    fields = spark.createDataFrame(FIELDS, "entity string, key string, value string")
    targets = spark.createDataFrame([("Cross", None, True), ("Red FC", "Red Club", False), ("Land", "Land", False)], "raw string, title string, disambiguation boolean")
    classes = spark.createDataFrame([("k:Red_Club", "kg:FootballClub"), ("k:Land", "kg:NationalTeam"), ("k:Arena", "kg:Stadium")], "iri string, cls string")
    return fields, targets, classes


def test_stations_of_a_box(spark):
    rows = S.box_stations(*_data(spark), "k:").collect()
    got = {(r.entity, r.idx): (r.kind, r.team, r.label, r.start, r.end, r.apps, r.goals, r.loan) for r in rows}
    assert got == {
        ("a", 1): ("kg:YouthStation", "k:New_place", "New place", None, None, None, None, False),
        ("a", 2): (S.CLUB, "k:Red_Club", "Red Club", 2001, 2003, 1234, 0, False),
        ("a", 3): (S.CLUB, None, "The land", 2002, 2002, None, None, True),  # a national team is no club
        ("a", 4): (S.CLUB, None, "Blue", 2005, None, None, None, True),
        ("a", 5): (S.NATIONAL, "k:Land", "Land", None, None, None, None, False),
        ("b", 1): (S.NATIONAL, None, "Red FC", None, None, None, None, False),
    }


def test_memberships_where_no_club_is_known(spark):
    fields, targets, classes = _data(spark)
    boxes = S.box_stations(fields, targets, classes, "k:")
    rows = [("a", "k:Red_Club", "x", "+2001", None, None, None), ("b", "k:Land", "Land", "+2004-01-01", None, "7.0", None), ("b", "k:New", None, None, "+2003", None, "2"), ("b", "k:Arena", "Arena", "+1999", None, None, None), ("d", "k:Red_Club", "Red", "+2010", None, None, None), (None, "k:Red_Club", None, None, None, None, None)]
    members = spark.createDataFrame(rows, "entity string, team string, label string, start string, end string, apps string, goals string")
    more = S.member_stations(members, classes, boxes)
    got = {(r.entity, r.idx, r.kind, r.team, r.start, r.end, r.apps, r.goals) for r in more.where("entity is not null").collect()}
    assert got == {("b", 2, S.CLUB, "k:New", None, 2003, None, 2), ("b", 3, S.NATIONAL, "k:Land", 2004, None, 7, None), ("d", 1, S.CLUB, "k:Red_Club", 2010, None, None, None)}
    every = boxes.unionByName(more)
    given = spark.createDataFrame([("e", "k:E"), ("e", "k:F")], "entity string, club string")
    assert set(map(tuple, S.current_clubs(every.where("entity is not null"), given).collect())) == {("e", "k:E"), ("e", "k:F"), ("d", "k:Red_Club")}
    titles = spark.createDataFrame([("a", "an_a"), ("d", "D")], "entity string, title string")
    t = {(r.s, r.p, r.o) for r in S.station_triples(every, titles).collect()}
    assert {("a__3", "rdfs:label", "An a – The land (2002–2002)"), ("a__4", "rdfs:label", "An a – Blue (2005–)"), ("a__1", "rdfs:label", "An a – New place (?–)"), ("a__3", "kg:onLoan", "true"), ("a__2", "kg:goals", "0"), ("d", "kg:careerStation", "d__1")} <= t
    assert not [x for x in t if x[0] in ("a__3", "a__4") and x[1] == "kg:team"] and not [x for x in t if x[0].startswith("b")]


def test_notes(spark):
    notes = {(r.entity, r.idx): r.note for r in S.notes(S.box_stations(*_data(spark), "k:"), {S.CLUB: "club", S.NATIONAL: "team"}).collect()}
    assert notes[("a", 2)] == "2001–2003 · 1234 trận, 0 bàn · club" and notes[("a", 4)] == "2005– · cho mượn · club" and notes[("a", 5)] == "team" and notes[("a", 1)] == ""


def test_spans_and_open_stations(spark):
    st = S.box_stations(*_data(spark), "k:")
    assert set(map(tuple, S.spans(st, 2026).collect())) == {("a", 2001, 2026)}
    got = {r.idx: (r.start, r.until, r.open, r.lane, r.beside) for r in S.timeline(st, 2026).collect()}
    assert got == {2: (2001, 2004, False, 0, 0), 3: (2002, 2003, False, 1, 1), 4: (2005, 2027, True, 0, 0)}


def test_lanes_against_a_plain_packing(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None, "hot", "hot", "hot"]), k, rng.choice([None, *range(1990, 2010)]), None) for k in range(3000)]
    rows = [(key, k, start, None if start is None or rng.random() < 0.05 else start + rng.randrange(1, 6)) for key, k, start, _ in rows]
    want = {}
    for key in {r[0] for r in rows}:
        ends = []
        for _, k, start, end in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[3] is None, r[3] or 0, r[1])):
            still = sum(e > start for e in ends)
            lane = next((x for x, e in enumerate(ends) if e <= start), len(ends))
            ends[lane : lane + 1] = [9999 if end is None else end]
            want[k] = (key, lane, still)
    df = spark.createDataFrame(rows, "who string, id long, start int, end int").repartition(7)
    assert {r.id: (r.who, r.lane, r.beside) for r in lanes(df, ["who"]).collect()} == want


def test_empty_careers(spark):
    fields, targets, classes = _data(spark)
    none = S.box_stations(fields.limit(0), targets, classes, "k:")
    assert none.count() == 0 and S.timeline(none, 2026).count() == 0 and S.spans(none, 2026).count() == 0


def test_memberships_go_by_the_order_given(spark):
    fields, targets, classes = _data(spark)
    rows = [("e", "k:Club_10", "+2001-01-01", "9", 10, 1), ("e", "k:Club_9", "+2001-01-01", "8", 9, 2), ("e", "k:Club_9", "+2001-01-01", "20", 9, 3)]
    members = spark.createDataFrame(rows, "entity string, team string, start string, apps string, k int, place int").selectExpr("*", "team as label", "cast(null as string) as end", "cast(null as string) as goals")
    taken = S.box_stations(fields.limit(0), targets, classes, "k:")
    got = {r.idx: (r.team, r.apps) for r in S.member_stations(members, classes, taken, ("k", "place")).collect()}
    assert got == {1: ("k:Club_9", 8), 2: ("k:Club_9", 20), 3: ("k:Club_10", 9)}
