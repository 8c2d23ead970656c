"""Graph-pattern operators over the triples table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(triples: DataFrame, s: str, p: str | list[str], o: str) -> DataFrame:
    """Bindings of a triple pattern: terms that begin with ? are variables, a repeated one must be equal.

    A list of predicates is a path alternative; its bindings are distinct.
    """
    out, named = triples, {}
    for col, term in (("s", s), ("p", p), ("o", o)):
        if isinstance(term, list):
            out = out.where(F.col(col).isin(term))
        elif not term.startswith("?"):
            out = out.where(F.col(col) == term)
        elif term[1:] in named:
            out = out.where(F.col(col) == F.col(named[term[1:]]))
        else:
            named[term[1:]] = col
    out = out.select(*[F.col(c).alias(v) for v, c in named.items()])
    return out.distinct() if isinstance(p, list) else out


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all variables that both sides have."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def bgp(triples: DataFrame, *patterns: tuple) -> DataFrame:
    """Basic graph pattern: the natural join of its triple patterns."""
    return reduce(natural, [pattern(triples, *p) for p in patterns])


def star(triples: DataFrame, subject: str, **properties: str) -> DataFrame:
    """Star pattern of functional properties, in one aggregation: column name -> predicate."""
    wanted = triples.where(F.col("p").isin(list(properties.values())))
    cols = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in properties.items()]
    return wanted.groupBy(F.col("s").alias(subject)).agg(*cols)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keep every left solution, with the right one's variables where it matches."""
    return natural(left, right, "left")


def union(*parts: DataFrame) -> DataFrame:
    """All solutions of the parts; variables that a part lacks are unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left solutions without a compatible right one."""
    return natural(left, right, "left_anti")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left solutions with a compatible right one."""
    return natural(left, right, "left_semi")


def values(triples: DataFrame, name: str, *rows) -> DataFrame:
    """Inline table of one variable."""
    return triples.sparkSession.createDataFrame([(r,) for r in rows], f"{name} string")


def group_concat(column: str, separator: str = ", ") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(solutions: DataFrame, *templates: tuple[Column, Column, Column]) -> DataFrame:
    """Distinct triples s, p, o of the templates over all solutions; unbound terms give none."""
    parts = [solutions.select(s.alias("s"), p.alias("p"), o.alias("o")).dropna() for s, p, o in templates]
    return reduce(DataFrame.union, parts).distinct()


def describe(triples: DataFrame, entities: DataFrame, incoming: int = 2000) -> DataFrame:
    """entity, direction, s, p, o: all triples out of each entity and up to `incoming` into it, by s and p."""
    from pyspark.sql.window import Window

    terms = triples.select("s", "p", "o")
    out = entities.join(terms, entities.entity == terms.s).select("entity", F.lit("out").alias("direction"), "s", "p", "o")
    into = entities.join(terms, entities.entity == terms.o)
    into = into.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("s", "p"))).where(F.col("_n") <= incoming)
    return out.unionByName(into.select("entity", F.lit("in").alias("direction"), "s", "p", "o"))


def edges_among(triples: DataFrame, nodes: DataFrame, inverses: list[tuple[str, str]]) -> DataFrame:
    """s, p, o between two nodes of a set, without a second edge for the inverse property q of (p, q)."""
    edges = triples.where("o_kind = 'iri'").select("s", "p", "o").distinct()
    inside = edges.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("o")), "o", "left_semi")
    if not inverses:
        return inside.select("s", "p", "o")
    pair = F.create_map(*[F.lit(x) for kv in inverses for x in kv])
    mirror = inside.where(F.col("p").isin([p for p, _ in inverses])).select(F.col("o").alias("s"), pair[F.col("p")].alias("p"), F.col("s").alias("o"))
    return inside.select("s", "p", "o").join(mirror, ["s", "p", "o"], "left_anti")
