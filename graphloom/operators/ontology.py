"""Views of an ontology: prepared axioms, class rows, display order; and proposals to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import closure, held
from graphloom.operators.inference import SKIPPED, Ontology, disjointness, materialise


def axioms(tbox: Ontology) -> DataFrame:
    """All axioms as rows: kind, term, other."""
    p = tbox.prop
    rows = [
        tbox.sub_class.select(F.lit("sub_class").alias("kind"), F.col("sub").alias("term"), F.col("sup").alias("other")),
        tbox.sub_prop.select(F.lit("sub_property"), "sub", "sup"),
        p.where("domain is not null").select(F.lit("domain"), "p", "domain"),
        p.where("range is not null").select(F.lit("range"), "p", "range"),
        p.where("functional").select(F.lit("functional"), "p", F.lit(None).cast("string")),
        tbox.inverse.select(F.lit("inverse"), "p", "q"),
        tbox.chain.select(F.lit("chain"), "p", F.concat_ws(" ", "p1", "p2")),
        tbox.some_values.select(F.lit("some_values"), "cls", F.concat_ws(" ", "p", "filler")),
        tbox.all_values.select(F.lit("all_values"), "cls", F.concat_ws(" ", "p", "filler")),
        tbox.disjoint.select(F.lit("disjoint"), "cls", F.col("grp").cast("string")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def prepared(all_axioms: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The axioms that enter reasoning: functional, inverse-functional, cardinality and same-as ones stay out."""
    return all_axioms.where(~F.col("kind").isin(list(skipped)))


def class_rows(tbox: Ontology, members: DataFrame) -> DataFrame:
    """cls, depth (steps to the top), properties (own, by domain, sorted), members, of every class of the ontology.

    members has cls and n; classes that it lacks have none.
    """
    names = tbox.sub_class.select(F.col("sub").alias("cls")).union(tbox.sub_class.select("sup")).distinct()
    depth = closure(tbox.sub_class).groupBy(F.col("sub").alias("cls")).agg(F.max("depth").alias("depth"))
    own = tbox.prop.where("domain is not null").groupBy(F.col("domain").alias("cls")).agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("properties"))
    out = held(names.join(depth, "cls", "left").join(own, "cls", "left"), "classes")
    return out.join(members, "cls", "left").select("cls", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("properties", F.lit("")).alias("properties"), F.coalesce("n", F.lit(0)).cast("long").alias("members"))


def class_paths(sub_class: DataFrame) -> DataFrame:
    """cls, path, depth: classes parent first and siblings by name when ordered by path; of several parents the first by name counts."""
    parent = held(sub_class.groupBy(F.col("sub").alias("cls")).agg(F.min("sup").alias("parent")), "parents")
    roots = parent.select(F.col("parent").alias("cls")).distinct().join(parent.select("cls"), "cls", "left_anti")
    level, depth = held(roots.select("cls", F.col("cls").alias("path"), F.lit(0).alias("depth")), "paths"), 0
    out = level
    while not level.isEmpty():
        depth += 1
        step = parent.join(level.select(F.col("cls").alias("parent"), F.col("path").alias("above")), "parent")
        level = held(step.select("cls", F.concat_ws("/", "above", "cls").alias("path"), F.lit(depth).alias("depth")), "paths")
        out = out.unionByName(level)
    return out


def display_classes(types: DataFrame, order: DataFrame) -> DataFrame:
    """entity, classes: each entity's classes (s, cls) that have a place in order (cls, place), in that order, comma-joined."""
    ranked = types.join(order.hint("merge"), "cls").groupBy("s").agg(F.array_sort(F.collect_set(F.struct("place", "cls"))).alias("c"))
    return ranked.select(F.col("s").alias("entity"), F.array_join(F.transform("c", lambda x: x["cls"]), ",").alias("classes"))


def resolved(proposals: DataFrame, entities: DataFrame, properties: DataFrame, own: str) -> DataFrame:
    """id, s, p, o, known of proposals whose terms are IRIs or local names of the namespace `own`.

    entities has term, properties p. known says that all three terms exist; the terms of the others are null.
    """
    full = lambda c: F.when(F.contains(F.col(c), F.lit(":")), F.col(c)).otherwise(F.concat(F.lit(own), F.col(c)))
    out = proposals.select("id", *[full(c).alias(c) for c in ("s", "p", "o")])
    names = entities.select("term").distinct()
    found = lambda df, c, terms: df.join(terms.toDF(c).withColumn(f"has_{c}", F.lit(True)).hint("merge"), c, "left")
    out = found(found(found(out, "s", names), "o", names), "p", properties.select("p").distinct())
    known = F.coalesce("has_s", F.lit(False)) & F.coalesce("has_p", F.lit(False)) & F.coalesce("has_o", F.lit(False))
    return out.select("id", *[F.when(known, F.col(c)).alias(c) for c in ("s", "p", "o")], known.alias("known"))


def neighbourhood(proposals: DataFrame, triples: DataFrame, via: str) -> DataFrame:
    """id, s, p, o: the triples of both ends of each proposal (id, s, o), and of what `via` leads to from them."""
    ends = proposals.select("id", F.explode(F.array("s", "o")).alias("s")).distinct()
    ends = held(ends, "ends")
    further = ends.join(triples.where(F.col("p") == via).select("s", F.col("o").alias("next")).hint("merge"), "s").select("id", F.col("next").alias("s"))
    nodes = held(ends.union(further).distinct(), "nodes")
    return nodes.join(triples.select("s", "p", "o").hint("merge"), "s").select("id", "s", "p", "o").distinct()


def axiom_counts(all_axioms: DataFrame, inferred: DataFrame) -> DataFrame:
    """kind, term, other, n: chains, inverses and value restrictions, with the inferred triples of what each gives.

    That is the property of a chain, the other property of an inverse (both ways round), the class of a
    some-values axiom, the filler of an all-values one. inferred has p, o; the others of `kind` are left out.
    """
    rows = all_axioms.where(F.col("kind").isin("chain", "inverse", "some_values", "all_values"))
    back = rows.where("kind = 'inverse'").select("kind", F.col("other").alias("term"), F.col("term").alias("other"))
    rows = rows.unionByName(back)
    filler = F.element_at(F.split("other", " "), -1)
    gives = F.when(F.col("kind") == "inverse", F.col("other")).when(F.col("kind") == "all_values", filler).otherwise(F.col("term"))
    is_type = F.col("p") == "rdf:type"
    counts = inferred.groupBy(is_type.alias("typed"), F.when(is_type, F.col("o")).otherwise(F.col("p")).alias("gives")).agg(F.count("*").alias("n"))
    rows = rows.withColumns({"gives": gives, "typed": F.col("kind").isin("some_values", "all_values")})
    return rows.join(counts, ["typed", "gives"], "left").select("kind", "term", "other", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def described(all_axioms: DataFrame, terms: DataFrame) -> DataFrame:
    """about, kind, term, other: every axiom that a term (column `term`) stands in, on either side or as a part of a chain or restriction."""
    parts = F.array_distinct(F.concat(F.array("term"), F.split(F.coalesce("other", F.lit("")), " ")))
    every = all_axioms.select("kind", "term", "other", F.explode(parts).alias("about"))
    return every.join(terms.select(F.col("term").alias("about")).distinct(), "about", "left_semi").select("about", "kind", "term", "other").distinct()


def clashes(facts: DataFrame, tbox: Ontology) -> DataFrame:
    """id, s, a, b: subjects that the rules put into two disjoint classes, for each proposal by itself.

    facts has id, s, p, o, o_kind: each proposal with what surrounds it. Entities carry the id of their
    proposal while the rules run, so all proposals run at once and none sees another's facts.
    """
    own = lambda c: F.concat(F.col("id").cast("string"), F.lit("\n"), F.col(c))
    entity = (F.col("o_kind") == "iri") & (F.col("p") != "rdf:type")
    tagged = facts.select(own("s").alias("s"), "p", F.when(entity, own("o")).otherwise(F.col("o")).alias("o"), "o_kind")
    found = disjointness(materialise(tagged, tbox), tbox.disjoint)
    return found.select(F.substring_index("s", "\n", 1).cast("long").alias("id"), F.substring_index("s", "\n", -1).alias("s"), "a", "b")
