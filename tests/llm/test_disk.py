"""What written tables leave on disk."""

import os

from graphloom.llm.common import shared_dir, written
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.ngram_join import ngram_components


def _shuffles(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_the_shuffles_of_a_written_table_go_when_it_is_written(spark):
    before = _shuffles(spark)
    grouped = written(spark.range(10_000).selectExpr("id % 7 as k", "id").groupBy("k").count(), "grouped")
    assert _shuffles(spark) <= before
    assert {(r.k, r["count"]) for r in grouped.collect()} == {(k, len(range(k, 10_000, 7))) for k in range(7)}


def test_near_and_exact_copies_leave_only_what_their_results_read(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = written(spark.createDataFrame([(k, f"{text} {k // 2}", "x") for k in range(40)], "doc_id long, text string, source string"), "docs")
    top = shared_dir(spark).removeprefix("file:")
    here = {*os.listdir(top)}
    assert drop_exact_copies(docs).count() == 20
    made = sorted(x.partition("-")[0] for x in {*os.listdir(top)} - here)
    assert "rows" not in made and made.count("run") <= 1 and "gone" in made  # one run at the top of the tree
    here = {*os.listdir(top)}
    assert ngram_components(docs, 3, 90, 100).count() == 40
    assert not {"features", "rows", "nodes", "hung", "open"} & {x.partition("-")[0] for x in {*os.listdir(top)} - here}
