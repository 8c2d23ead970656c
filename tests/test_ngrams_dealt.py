"""All n-grams of words: every text, dealt to all tasks (F25)."""

from graphloom.plans import QUERIES


def test_texts_of_one_file_are_read_by_all_tasks_and_no_gram_is_lost(spark, tmp_path):
    texts = [(1, "A b  c\td e f g h I j"), (2, None), (3, " "), (4, "one"), (None, "x y"), (6, "x\x0by é")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["u03_every_word_ngram"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = {i: (t or "").lower().split() for i, t in texts}
    want = [(i, k + 1, n, " ".join(w[k : k + n])) for i, w in words.items() for n in range(1, 9) for k in range(len(w) - n + 1)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
