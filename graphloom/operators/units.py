"""Administrative units that succeed one another: own figures, figures of the group that a unit ended up in, and lists of members by era."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.chains import final_successor


def finals(units: DataFrame, succession: DataFrame) -> DataFrame:
    """unit, final of every unit: former units follow their successors, others are their own. units has unit, former."""
    last = final_successor(succession, units.where("former").select(F.col("unit").alias("node")))
    return units.select("unit").distinct().join(last.select(F.col("node").alias("unit"), "final").hint("merge"), "unit", "left").select("unit", F.coalesce("final", "unit").alias("final"))


def unit_table(units: DataFrame, members: DataFrame, succession: DataFrame, kinds: list[str]) -> DataFrame:
    """unit, former, year, final, a count of each kind, and group_<kind>: the distinct members of all units that end in a current one.

    units has unit, former, year; members has unit, kind, member; succession has node, successor. A member of two
    units of a group counts once there; the group of a former unit is null.
    """
    last = finals(units, succession)
    own = members.groupBy("unit").pivot("kind", kinds).agg(F.count_distinct("member"))
    group = members.join(last.hint("merge"), "unit").groupBy(F.col("final").alias("unit")).pivot("kind", kinds).agg(F.count_distinct("member"))
    group = group.select("unit", *[F.col(k).alias(f"group_{k}") for k in kinds])
    rows = reduce(lambda a, b: a.join(b.hint("merge"), "unit", "left"), [units.select("unit", "former", "year"), last, own, group])
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("unit", "former", "year", "final", *[none(k) for k in kinds], *[F.when(~F.col("former"), F.coalesce(f"group_{k}", F.lit(0))).alias(f"group_{k}") for k in kinds])


def unit_lists(units: DataFrame, members: DataFrame, succession: DataFrame, labels: DataFrame, weights: DataFrame, most: int = 12) -> DataFrame:
    """unit, era, kind, place, member, total: the first `most` members by falling weight, then label, then name; all are counted.

    Era "before" has a unit's own members, "after" those of all units whose final successor it is. labels has
    member, label; weights member, n (0 if absent). Row numbers below a bound are cut before the shuffle, so a
    unit with very many members is not gathered in one task.
    """
    before = members.select("unit", F.lit("before").alias("era"), "kind", "member")
    after = members.join(finals(units, succession).hint("merge"), "unit").select(F.col("final").alias("unit"), F.lit("after").alias("era"), "kind", "member")
    rows = before.unionByName(after).distinct()
    total = rows.groupBy("unit", "era", "kind").agg(F.count("*").alias("total"))
    named = rows.join(labels.groupBy("member").agg(F.min("label").alias("label")).hint("merge"), "member", "left").join(weights.hint("merge"), "member", "left")
    place = F.row_number().over(Window.partitionBy("unit", "era", "kind").orderBy(F.coalesce("n", F.lit(0)).desc(), F.coalesce("label", "member"), "member"))
    best = named.withColumn("place", place).where(F.col("place") <= most)
    return best.join(total.hint("merge"), ["unit", "era", "kind"]).select("unit", "era", "kind", F.col("place").cast("long").alias("place"), "member", "total")
