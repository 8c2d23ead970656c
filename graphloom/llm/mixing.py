"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ranked, sized_join, uniform, word_count, written

#: Weights by rank of the source, repeated.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times.
MOST = 3
#: Documents that one fold of the reduction tree pairs up.
BLOCK = 64
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, docs, source_size, target.

    Sources rank by code point, null last; weights repeat by rank. The targets share the total size; a
    target above `most` times its source's size stops there and the excess is shared anew by weight.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    per = ranked(per, [F.col("source").asc_nulls_last()], "rank")
    per = written(
        per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))),
        "sources",
    )
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        total, taken, weight, n = per.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if n == capped or not weight:
            break
        level, capped = max(level, ((total or 0) - (taken or 0.0)) / weight), n
    return per.select("source", "docs", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Fold the documents of a block: (done, rest), rest the one that is still fractional.

    Two documents of sizes a, b and fractions x, y exchange mass: either x gains what y loses or the
    other way round, as far as one of them becomes 0 or 1, with the chances that leave both expectations
    as they were. The sum of size times fraction never changes.
    """

    def step(acc: Column, new: Column) -> Column:
        i, j = acc["rest"], new
        to_i, from_j = (1 - i["x"]) * i["size"], j["x"] * j["size"]
        from_i, to_j = i["x"] * i["size"], (1 - j["x"]) * j["size"]
        up, down = F.least(to_i, from_j), F.least(from_i, to_j)
        gains = uniform(i["id"], j["id"], i["u"], j["u"], F.lit(seed)) * (up + down) < down
        i_ends = F.when(gains, to_i <= from_j).otherwise(from_i <= to_j)
        i_x = F.when(gains, i["x"] + up / i["size"]).otherwise(i["x"] - down / i["size"])
        j_x = F.when(gains, j["x"] - up / j["size"]).otherwise(j["x"] + down / j["size"])
        ended = F.when(i_ends, i.withField("x", F.when(gains, 1.0).otherwise(0.0))).otherwise(j.withField("x", F.when(gains, 0.0).otherwise(1.0)))
        going = F.when(i_ends, j.withField("x", F.least(F.greatest(j_x, F.lit(0.0)), F.lit(1.0)))).otherwise(
            i.withField("x", F.least(F.greatest(i_x, F.lit(0.0)), F.lit(1.0)))
        )
        return F.struct(F.concat(acc["done"], F.array(ended)).alias("done"), going.alias("rest"))

    ordered = F.sort_array(items)
    return F.aggregate(
        F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))),
        F.struct(F.slice(ordered, 1, 0).alias("done"), ordered[0].alias("rest")),
        step,
    )


def mix_to_weights(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How often the mix takes each document so that every source's taken words come near its target.

    A document of a source is expected target / source_size times. The whole part is taken as it is; the
    fraction is settled by pivotal dependent rounding. Each block of about `block` documents of a source
    (dealt by hash, so a hot source has many blocks) folds to one fractional document, `block` of these
    residuals fold again, and so on up a tree; the last one of a source is settled by its own chance.
    What a source takes therefore differs from its target by less than one document.

    Returns one row per input row: id, source, size, source_size, target, copies, taken, and row_col (a written row number) if given. Null text has
    size 0; documents of size 0 take nothing; null sources form one source, the last; repeated rows count
    each; an empty table gives an empty result. The random numbers depend on `seed` and on a row's rank by
    source, id, text and size, so reruns agree however the rows lie: rows equal in all of these, with or without
    an id, have ranks next to each other and may stand for one another, and no block has more of them than its share.
    """
    size = word_count(F.col("text")) if size is None else size
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    same = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.cast("long").alias("row"), same.alias("same")), "sizes")
    # a document's own number: of its rank, which equal rows share among themselves and no place in the table decides
    sizes = ranked(sizes, [F.col(c) for c in ("source", "id", "same", "size", "row")], "rank")
    sizes = written(sizes.select("id", "source", "size", "row", F.xxhash64("rank", F.lit(seed)).alias("u")), "sizes")
    targets = written(source_targets(sizes, weights, most), "targets")
    named = targets.select(F.col("source").alias("_source"), "docs", "source_size", "target")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized_join(sizes, named, F.col("source").eqNullSafe(F.col("_source")), "inner", 100_000)
        .withColumn("share", share)
        .select("id", "source", "size", "row", "docs", F.floor("share").alias("whole"), (F.col("share") - F.floor("share")).alias("x"), "u")
    )
    open_ = (F.col("size") > 0) & (F.col("x") > 1e-12)
    item = F.struct("u", "id", "size", "whole", "x", "row")
    settled = [rows.where(~open_).select("id", "source", "size", "row", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))]
    blocks = F.ceil(F.col("docs") / block)
    level = rows.where(open_).select("source", F.pmod(F.col("u"), blocks).alias("block"), item.alias("item"))
    left = -(-(targets.agg(F.max("docs")).first()[0] or 0) // block)
    while True:
        folded = written(
            level.groupBy("source", "block").agg(F.collect_list("item").alias("items")).select("source", "block", _fold(F.col("items"), seed).alias("f")),
            "folded",
        )
        settled.append(folded.select("source", F.explode("f.done").alias("d")).select("d.id", "source", "d.size", "d.row", (F.col("d.whole") + F.col("d.x")).cast("long").alias("copies")))
        if left <= 1:
            break
        left = -(-left // block)
        level = folded.select("source", F.floor(F.col("block") / block).alias("block"), F.col("f.rest").alias("item"))
    last = F.when(uniform(F.col("f.rest.u"), F.lit(seed + 1)) < F.col("f.rest.x"), 1).otherwise(0)
    settled.append(folded.where("f.rest is not null").select("f.rest.id", "source", "f.rest.size", "f.rest.row", (F.col("f.rest.whole") + last).cast("long").alias("copies")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return sized_join(out, named, F.col("source").eqNullSafe(F.col("_source")), "inner", 100_000).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([] if row_col is None else [F.col("row").alias(row_col)])
    )
