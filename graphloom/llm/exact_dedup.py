"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, fresh, release, sized_join, written

#: Leaf runs, and runs that one merge of a round takes.
RUNS, FAN_IN = 64, 4
KEY = ["digest", "length", "check"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keys(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).alias("length"), F.xxhash64(text).alias("check")]


def _merge(runs: DataFrame, key: list[str]) -> DataFrame:
    """One sorted run per run number: each key once, with its smallest (missing id last, id, row) and its rows."""
    merged = runs.groupBy("run", *key).agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    return written(merged, "run")


def tree_merge(keyed: DataFrame, key: list[str], fan_in: int = FAN_IN, used: list[DataFrame] | None = None) -> DataFrame:
    """Add `keep` (none, id, row of the smallest id) and `group_size` to each row of (id, *key).

    Rows are dealt to RUNS leaf runs by a hash of their number. In each round, fan_in runs are exchanged and
    merged into one, keeping the smallest id of a key at every level. The results then go down the same
    tree, so that the rows of a huge group are joined under RUNS separate keys, never in one. The written
    tables that the result reads are added to `used`, for release() once the result is written.
    """
    rows = written(
        keyed.withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(RUNS)).cast("int")), "rows"
    )
    levels = [_merge(rows.select("run", *key, F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("first"), F.lit(1).cast("long").alias("rows")), key)]
    width = RUNS
    while width > 1:
        width = -(-width // fan_in)
        levels.append(_merge(levels[-1].withColumn("run", (F.col("run") / fan_in).cast("int")), key))
    if used is not None:
        used += [rows, *levels]
    found = levels.pop().select("run", *key, F.col("first").alias("keep"), F.col("rows").alias("group_size"))
    for level in reversed(levels):
        found = (
            level.select(F.col("run").alias("leaf"), (F.col("run") / fan_in).cast("int").alias("run"), *key)
            .join(found.hint("merge"), ["run", *key])
            .select(F.col("leaf").alias("run"), *key, "keep", "group_size")
        )
    return rows.join(found.hint("merge"), ["run", *key])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", used: list[DataFrame] | None = None) -> DataFrame:
    """Group rows whose normalised texts are equal; one row of each group stays.

    Digests are merged up a tree of sorted runs (tree_merge); two entries merge only if SHA-256, length
    and a second hash of another family all agree, which is checked at every level.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256. Null and empty texts are
    equal; a null id is larger than any other; of repeated rows with the smallest id exactly one stays;
    an empty table gives an empty result; other columns of the input are ignored. used: see tree_merge().
    """
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", *_keys(F.col("text")))
    return tree_merge(keyed, KEY, used=used).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    used: list[DataFrame] = []
    out = written(exact_dedup(docs, id_col, text_col, used).where(~F.col("kept")), "gone")
    release(*used)
    repeat = F.col(id_col).eqNullSafe(F.col("keep_id"))  # the kept row's own id: the same row once more
    key, id_, digest = fresh(docs, "_digest"), fresh(docs, "_id"), fresh(docs, "_same")
    gone = out.where(~repeat).select(F.col(id_col).alias(id_), F.unhex("text_sha256").alias(digest)).distinct()
    tagged = docs.withColumn(key, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    kept = sized_join(tagged, gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(digest)), "left_anti")
    if not out.where(repeat).isEmpty():
        kept = kept.dropDuplicates([id_col, key])
    return kept.drop(key)
