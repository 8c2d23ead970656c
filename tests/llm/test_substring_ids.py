"""Substring dedup where ids are null, repeated, of another type, or beside clashing columns."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm.substring_dedup import substring_dedup

A, B = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))


def _kept(df, **kw):
    return sorted((-1 if r.doc_id is None else int(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, 20, **kw).collect())


def test_null_ids_come_last(spark):
    rows = [(None, A), (7, A), (3, f"x {A} y"), (None, f"{B} z"), (None, f"{B} z"), (None, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(-1, 30, 30, ""), (7, 30, 30, ""), (3, 32, 0, f"x {A} y"), (-1, 31, 0, f"{B} z"), (-1, 31, 0, f"{B} z"), (-1, 0, 0, ""), (-1, 0, 0, "")])
    assert _kept(d) == want
    assert _kept(d.repartition(5)) == want  # however the rows are dealt


def test_one_of_two_null_ids_keeps_a_shared_passage(spark):
    d = spark.createDataFrame([(None, f"p {A}"), (None, f"q {A}")], "doc_id long, text string")
    first, again = _kept(d), _kept(d.repartition(3))
    assert first == again and sorted(r[2] for r in first) == [0, 30]


def test_repeated_ids_and_types(spark):
    rows = [(1, A), (1, A), (2, f"{A} end"), (3, f"{A} {A}")]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"row": F.lit("r"), "runs": F.lit(1), "id": F.lit(None).cast("string"), "words": F.lit(0)})
    want = [(1, 30, 0, A), (1, 30, 0, A), (2, 31, 30, "end"), (3, 60, 60, "")]
    assert _kept(d) == want
    assert _kept(d.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))) == want
    with pytest.raises(TypeError, match="whole numbers"):
        substring_dedup(d.withColumn("doc_id", F.col("doc_id").cast("string")))
