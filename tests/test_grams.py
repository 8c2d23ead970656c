"""The gram index against a scan of all names, salted lists, classes filtered by a text, cells."""

import random

from pyspark.sql import functions as F

from graphloom.operators import grams as N


def _index(spark, rows):
    return N.gram_index(spark.createDataFrame(rows, "entity string, name string, folded string"))


def test_every_text_finds_what_a_scan_finds(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["a", "ab", "\U0001f600", "\U0001f600a"]
    rows = [(f"e{k}", n, n) for k, n in enumerate(names)] + [("null", None, None)]
    texts = sorted({n[i : i + k] for n in names for k in (1, 2, 3, 5) for i in range(len(n))} | {"zzz", "z", "", "abababababab"})
    index = _index(spark, rows)
    q = spark.createDataFrame([(t,) for t in texts] + [(None,)], "q string")
    want = sorted((t, n) for t in texts if t for n in set(names) if t in n)
    assert sorted(map(tuple, N.containing(index, q).collect())) == want
    assert sorted(map(tuple, N.containing(index, q, list_size=7).collect())) == want  # hot lists on many keys


def test_long_texts_read_one_list_only(spark):
    index = _index(spark, [(f"e{k}", f"common {k}", f"common {k}") for k in range(50)] + [("x", "common rare", "common rare")])
    assert {r.gram: r.n for r in index.frequencies.where("gram in ('com', 'rar')").collect()} == {"com": 51, "rar": 1}
    got = N.ranked_search(index, spark.createDataFrame([(1, " Common  RARE"), (2, "common rare"), (3, None), (4, "  ")], "qid int, text string"), 5)
    assert sorted(map(tuple, got.collect())) == [(1, "x", "common rare", 1), (2, "x", "common rare", 1)]


def test_an_empty_index(spark):
    index = _index(spark, [])
    assert N.ranked_search(index, spark.createDataFrame([(1, "a"), (2, "abc")], "qid int, text string"), 5).count() == 0


def test_branches_without_hits_are_pruned(spark):
    index = _index(spark, [("e1", "An", "an"), ("e2", "Ban", "ban"), ("e3", "Cy", "cy"), ("e1", "Anna", "anna")])
    members = spark.createDataFrame([("e1", "A"), ("e2", "A"), ("e3", "B"), ("e3", "A1")], "entity string, cls string")
    tree = spark.createDataFrame([("A1", "A"), ("A", "Top"), ("B", "Top"), ("C", "Top")], "sub string, sup string")
    got = N.filtered_classes(index, members, tree, spark.createDataFrame([("AN",), ("c",)], "text string"), cap=1)
    assert set(map(tuple, got.collect())) == {("an", "A", 2, 1, "e1", "An"), ("an", "Top", 0, None, None, None), ("c", "A1", 1, 1, "e3", "Cy"), ("c", "B", 1, 1, "e3", "Cy"), ("c", "A", 0, None, None, None), ("c", "Top", 0, None, None, None)}


def test_cells(spark):
    names = spark.createDataFrame([("k:1", "an"), ("k:2", "ban"), ("k:3", "ban"), ("k:1", "x" * 9)], "entity string, folded string")
    cells = ["k:1", "k:9", "http://a", "http://a b", "AN", "ban", "", "x" * 9, None, "AN"]
    got = N.cells_to_entities(spark.createDataFrame([(c,) for c in cells], "cell string"), names, names.select("entity"), "k:", 8)
    found = {r.cell: (r.node, r.how) for r in got.collect()}
    assert found == {"k:1": ("k:1", "own"), "k:9": (None, None), "http://a": ("http://a", "web"), "http://a b": (None, None), "AN": ("k:1", "name"), "ban": (None, None), "": (None, None), "x" * 9: (None, None)}
    assert got.where(F.col("cell") == "AN").count() == 1
