"""Data-quality checks: each returns issues (severity, check, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import closure
from graphloom.operators.inference import TYPE, Ontology

ISSUE = ["severity", "check", "subject", "detail"]
#: Lexical forms of literal datatypes.
LEXICAL = {
    "xsd:integer": r"^[+-]?[0-9]+$",
    "xsd:nonNegativeInteger": r"^\+?[0-9]+$",
    "xsd:double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "xsd:boolean": r"^(true|false|0|1)$",
    "xsd:date": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "xsd:gYearMonth": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])$",
    "xsd:gYear": r"^-?[0-9]{4,}$",
}


def issue(df: DataFrame, check: str, subject: Column, detail: Column, severity: str = "error") -> DataFrame:
    """Rows of df as issues."""
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.alias("subject"), detail.alias("detail"))


def super_property_kind(sub_prop: DataFrame, prop: DataFrame) -> DataFrame:
    """A property and its super-property are of different kinds."""
    kind = prop.select("p", "kind")
    a = sub_prop.join(kind.select(F.col("p").alias("sub"), F.col("kind").alias("k1")), "sub")
    return issue(a.join(kind.select(F.col("p").alias("sup"), F.col("kind").alias("k2")), "sup").where("k1 <> k2"), "super_property_kind", F.col("sub"), F.col("sup"))


def without_aligned_ancestor(classes: DataFrame, sub_class: DataFrame, namespace: str) -> DataFrame:
    """Classes (cls) without an ancestor in the aligned vocabulary."""
    fine = closure(sub_class).where(F.col("sup").startswith(namespace)).select(F.col("sub").alias("cls"))
    return issue(classes.join(fine, "cls", "left_anti"), "no_aligned_ancestor", F.col("cls"), F.lit(""))


def missing_labels(labels: DataFrame, languages: list[str]) -> DataFrame:
    """Terms (term, lang) that lack a label in one of the languages."""
    lacks = labels.groupBy("term").agg(F.array_except(F.array(*[F.lit(x) for x in languages]), F.collect_set("lang")).alias("m"))
    return issue(lacks.where(F.size("m") > 0), "missing_label", F.col("term"), F.array_join("m", ","))


def property_kinds(triples: DataFrame, prop: DataFrame) -> DataFrame:
    """Object properties with literals and datatype properties with IRIs."""
    bad = ((F.col("kind") == "object") & (F.col("o_kind") == "lit")) | ((F.col("kind") == "datatype") & (F.col("o_kind") != "lit"))
    return issue(triples.join(F.broadcast(prop.select("p", "kind")), "p").where(bad), "property_kind", F.col("s"), F.col("p"))


def ill_typed(triples: DataFrame) -> DataFrame:
    """Literals whose lexical form is no value of their datatype."""
    form = F.create_map(*[F.lit(x) for kv in LEXICAL.items() for x in kv])
    return issue(triples.where(F.expr("o_kind = 'lit'") & form[F.col("dt")].isNotNull() & ~F.regexp(F.col("o"), form[F.col("dt")])), "ill_typed", F.col("s"), F.col("o"))


def datatype_range(triples: DataFrame, prop: DataFrame) -> DataFrame:
    """Literals whose datatype, or language where the range is a language string, disagrees with the range."""
    t = triples.where("o_kind = 'lit'").join(F.broadcast(prop.where("range is not null and kind = 'datatype'").select("p", "range")), "p")
    bad = F.when(F.col("range") == "rdf:langString", F.col("lang").isNull()).otherwise(~F.col("dt").eqNullSafe(F.col("range")))
    return issue(t.where(bad), "datatype_range", F.col("s"), F.concat_ws(" ", "p", F.coalesce("dt", F.lit("-"))))


def one_main_class(triples: DataFrame, main: list[str]) -> DataFrame:
    """Entities with more or fewer than one of the main classes."""
    n = F.count_distinct(F.when(F.col("o").isin(main), F.col("o")))
    per = triples.where((F.col("p") == TYPE) & F.col("o").isin(main)).groupBy("s").agg(n.alias("n"))
    return issue(per.where("n <> 1"), "main_class", F.col("s"), F.col("n").cast("string"))


def required(triples: DataFrame, needs: dict[str, dict[str, str]]) -> DataFrame:
    """Members of a class that lack a required property: class -> property -> severity."""
    out = []
    for cls, props in needs.items():
        members = triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
        for p, severity in props.items():
            out.append(issue(members.join(triples.where(F.col("p") == p).select("s"), "s", "left_anti"), "required", F.col("s"), F.lit(p), severity))
    return reduce(DataFrame.unionByName, out)


def functional(triples: DataFrame, prop: DataFrame) -> DataFrame:
    """Functional properties with more than one value; up to three of them are shown."""
    t = triples.join(F.broadcast(prop.where("functional").select("p")), "p", "left_semi").select("s", "p", "o").distinct()
    per = t.groupBy("s", "p").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o")).alias("v")).where("n > 1")
    return issue(per, "functional", F.col("s"), F.concat_ws(" ", "p", F.array_join(F.slice("v", 1, 3), ",")))


def object_ranges(triples: DataFrame, tbox: Ontology) -> DataFrame:
    """Objects whose asserted classes all lie outside the property's range; objects without a class pass."""
    anc = closure(tbox.sub_class, reflexive=True).select(F.col("sub").alias("cls"), F.col("sup"))
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("cls"))
    types = types.join(F.broadcast(anc), "cls", "left").select("o", F.coalesce("sup", "cls").alias("cls"))
    uses = triples.where("o_kind = 'iri'").join(F.broadcast(tbox.prop.where("kind = 'object' and range is not null").select("p", "range")), "p").select("s", "p", "o", "range")
    per = uses.join(types, "o").groupBy("s", "p", "o").agg(F.bool_or(F.col("cls") == F.col("range")).alias("fits"))
    return issue(per.where("not fits"), "object_range", F.col("s"), F.concat_ws(" ", "p", "o"))


def same_as_lists(triples: DataFrame, marks: list[str]) -> DataFrame:
    """Same-as targets that look like lists or disambiguation pages."""
    odd = reduce(lambda a, b: a | b, [F.contains(F.col("o"), F.lit(m)) for m in marks])
    return issue(triples.where((F.col("p") == "owl:sameAs") & odd), "same_as_list", F.col("s"), F.col("o"))


def same_as_shared(triples: DataFrame) -> DataFrame:
    """Same-as targets of more than one entity."""
    per = triples.where(F.col("p") == "owl:sameAs").groupBy("o").agg(F.count_distinct("s").alias("n")).where("n > 1")
    return issue(per, "same_as_shared", F.col("o"), F.col("n").cast("string"))


def bounding_box(points: DataFrame, lat: tuple, lon: tuple) -> DataFrame:
    """Points (s, lat, lon) outside a box."""
    inside = F.col("lat").between(*lat) & F.col("lon").between(*lon)
    return issue(points.where(~inside), "coordinates", F.col("s"), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")), "warning")


def plausible_years(triples: DataFrame, low: int, high: int) -> DataFrame:
    """Literals whose year is outside a span."""
    year = F.regexp_extract("o", r"^(-?\d{4})", 1).try_cast("int")
    return issue(triples.where(~year.between(low, high)), "year", F.col("s"), F.col("o"), "warning")


def value_ranges(triples: DataFrame, limits: DataFrame) -> DataFrame:
    """Numbers outside their property's limits (p, lo, hi)."""
    t = triples.join(F.broadcast(limits), "p").where(~F.expr("try_cast(o as double) between lo and hi"))
    return issue(t, "value_range", F.col("s"), F.concat_ws(" ", "p", "o"), "warning")


def disjoint_issues(violations: DataFrame) -> DataFrame:
    """Disjointness violations (s, a, b) as issues."""
    return issue(violations, "disjoint", F.col("s"), F.concat_ws(" ", "a", "b"))


def summary(*checks: DataFrame) -> DataFrame:
    """Issues by severity and check, with subtotals."""
    return reduce(DataFrame.unionByName, checks).rollup("severity", "check").agg(F.count("*").alias("n"))


def strict(issues: DataFrame) -> None:
    """Raise if there is an error among the issues."""
    n = issues.where("severity = 'error'").count()
    if n:
        raise ValueError(f"{n} data-quality errors")
