"""Triples of typed records from two sources of values, by a table of rules per class and property."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRUCTURED, BOX = "structured", "box"
TRIPLE = ["s", "p", "o", "o_kind", "dt", "lang"]


@dataclass(frozen=True)
class Rule:
    """How the values of one property of a class become triples.

    how: "union" keeps the values of both sources, "pick" the first value of the source that comes first,
    "latest" the one with the latest time of it, "fallback" all values of that source, and of the box
    (`take` values, 0: all) only where the other has none.
    """

    cls: str
    prop: str
    out: str | None = None  # property of links, texts, numbers and full dates
    text: str | None = None  # property of texts where links have another one
    year: str | None = None  # property of the year of a time, or of the time of a number
    year_too: bool = False  # the year beside a full date
    how: str = "union"
    box_first: bool = False
    best: bool = True  # preferred statements only, where there are some
    allow: tuple[str, ...] | None = None  # classes of linked entities, if their class is known
    both: bool = False  # `allow` holds for structured values too
    known: bool = False  # entities without a class are not allowed
    late: bool = False  # `allow` judges the picked value: there is no second choice
    other: bool = False  # no link to itself
    take: int = 0
    within: bool = False  # the provinces that hold the linked place, in place of it
    split: str | None = None  # property in place of `out` where the linked entity is a province
    dt: str | None = None
    lang: str | None = None
    per: float = 1.0  # structured numbers are divided by it
    digits: int | None = None
    low: float | None = None  # bounds of numbers in `bound`, before one is picked
    high: float | None = None
    bound: str = STRUCTURED
    chars: int | None = None  # longest text, cut beyond


_TYPES = {"str": "string", "bool": "boolean", "int": "int", "float": "double", "tuple[str, ...]": "array<string>"}
_SCHEMA = "rule int, " + ", ".join(f"{f.name} {_TYPES[f.type.replace(' | None', '')]}" for f in fields(Rule))
_INTEGER = ("xsd:integer", "xsd:nonNegativeInteger")


def _looked_up(df: DataFrame, other: DataFrame, key: str, applies: Column) -> DataFrame:
    """Left join of the rows that `applies` holds for by their value; the others get nulls and are not shuffled."""
    applies, added = F.coalesce(applies, F.lit(False)), [c for c in other.columns if c != key]
    met = df.where(applies).join(other.withColumnRenamed(key, "value").hint("merge"), "value", "left").select(*df.columns, *added)
    return met.unionByName(df.where(~applies).withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in added}))


def _number(v: Column, digits: Column, dt: Column) -> Column:
    """A number as literal: whole numbers rounded half to even and not negative, others to their digits, by their shortest decimal form."""
    whole = F.bround(v, 0).cast("long")
    return F.when(dt.isin(*_INTEGER), F.when(whole >= 0, whole.cast("string"))).otherwise(F.when(digits == 2, F.bround(v, 2)).otherwise(v).cast("string"))


def produce(values: DataFrame, classes: DataFrame, within: DataFrame, rules: list[Rule], country: str | None = None, once: bool = True) -> DataFrame:
    """s, p, o, o_kind, dt, lang of all records, distinct unless the caller does that (once).

    values has entity, cls, source (structured or box), prop, ord, kind (iri, lit, time), value, preferred and
    at (time of a value, null); classes value, target; within place, province. Values without a rule, null
    values and numbers that cannot be read give no triple. Values are joined and dealt once for all rules, with the
    number of their rule: its fields are looked up anew in each step, none is shuffled. Only links whose class
    matters meet the classes, only values that a rule chooses among are dealt; where a rule keeps every value of
    every rank, they stay where they are. A window holds what one record says of one property.
    """
    spark = values.sparkSession
    table = spark.createDataFrame([(k, *(list(x) if isinstance(x, tuple) else x for x in astuple(r))) for k, r in enumerate(rules)], _SCHEMA)
    own = ["entity", "rule", "source", "ord", "kind", "value", "preferred", "at"]
    told = lambda df: df.join(F.broadcast(table.drop("cls", "prop")), "rule")
    linked = F.col("kind") == "iri"
    structured, good = F.col("source") == STRUCTURED, F.coalesce("preferred", F.lit(False))
    v = values.where("value is not null").join(F.broadcast(table.select("rule", "cls", "prop")), ["cls", "prop"]).select(*own)
    judged = (~structured | F.col("both")) & F.col("allow").isNotNull() | F.col("split").isNotNull()
    v = _looked_up(told(v).select(*own, (linked & judged).alias("_judged")), classes.select("value", "target"), "value", F.col("_judged")).drop("_judged")

    fits = F.col("allow").isNull() | F.when(F.col("target").isNull(), ~F.col("known")).otherwise(F.array_contains("allow", F.col("target")))
    bad = linked & (~structured | F.col("both")) & ~fits
    read = F.col("value").try_cast("double") / F.when(structured, F.col("per")).otherwise(1.0)
    outside = (F.col("source") == F.col("bound")) & ((F.col("_x") < F.col("low")) | (F.col("_x") > F.col("high")))
    alone = (F.col("how") == "union") & ~F.col("best")  # every value of every rank stays

    def allowed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_bad": bad, "_x": F.when(F.col("dt").isNotNull() & (F.col("kind") == "lit"), read)}).where("late or not _bad")
        return rows.where(~F.coalesce(outside, F.lit(False)) & ~(F.col("other") & linked & (F.col("value") == F.col("entity"))))

    group = ["entity", "rule"]
    chosen = told(v).where(~alone).select(*own, "target").withColumn("_any", F.max(structured & good).over(Window.partitionBy(*group)))
    chosen = allowed(told(chosen).where(~(F.col("best") & structured & F.col("_any")) | good))
    rank = F.when(structured == ~F.col("box_first"), 0).otherwise(1)
    time = F.when(F.col("how") == "latest", F.coalesce("at", F.lit(""))).otherwise("")
    in_order = Window.partitionBy(*group).orderBy(rank, time.desc(), "ord", "value")
    chosen = chosen.withColumns({"_top": F.first(rank).over(in_order), "_n": F.row_number().over(in_order)})
    several = (rank == F.col("_top")) & (structured | (F.col("take") == 0) | (F.col("_n") <= F.col("take")))
    chosen = chosen.where(F.when(F.col("how") == "union", True).when(F.col("how") == "fallback", several).otherwise(F.col("_n") == 1))
    kept = [*own, "target"]
    v = chosen.where("not _bad").select(*kept).unionByName(allowed(told(v).where(alone)).where("not _bad").select(*kept))

    if any(r.within for r in rules):
        v = told(v).select(*kept, (linked & F.col("within")).alias("_inner"))
        inner = F.col("_inner")
        v = _looked_up(v, within.select("place", "province"), "place", inner).where(~inner | F.col("province").isNotNull())
        v = v.withColumn("value", F.when(inner, F.col("province")).otherwise(F.col("value"))).select(*kept)
    v = told(v).withColumn("_x", F.when(F.col("dt").isNotNull() & (F.col("kind") == "lit"), read))
    if country is not None:
        v = v.where(~(linked & F.col("split").isNotNull() & (F.col("value") == country)))

    none = F.lit(None)
    fact = lambda p, o, kind, dt=None, lang=None: F.struct(
        p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (none if dt is None else dt).cast("string").alias("dt"), (none if lang is None else lang).cast("string").alias("lang")
    )
    value, text, time = F.col("value"), F.col("kind") == "lit", F.col("kind") == "time"
    day = time & value.rlike(r"^\d{4}-\d\d-\d\d$")
    year = F.regexp_extract(F.when(time, value).otherwise(F.col("at")), r"^(\d{4})", 1)
    literal = F.when(F.col("dt").isNotNull(), _number(F.col("_x"), F.col("digits"), F.col("dt"))).otherwise(F.when(F.col("chars").isNotNull(), F.substring(value, F.lit(1), F.col("chars"))).otherwise(value))
    found = F.array(
        fact(F.when(linked, F.when(F.col("target") == "kg:Province", F.coalesce("split", "out")).otherwise(F.col("out"))), value, "iri"),
        fact(F.when(text, F.coalesce("text", "out")), literal, "lit", F.col("dt"), F.col("lang")),
        fact(F.when(day, F.col("out")), value, "lit", F.lit("xsd:date")),
        fact(F.when(text | (time & (~day | F.col("year_too"))), F.col("year")), year, "lit", F.lit("xsd:gYear")),
    )
    full = F.filter(found, lambda f: f["p"].isNotNull() & f["o"].isNotNull() & (f["o"] != ""))
    out = v.select(F.col("entity").alias("s"), F.explode(full).alias("f")).select("s", "f.*")
    return out.distinct() if once else out


def former(values: DataFrame, cls: str, current: list[str]) -> DataFrame:
    """Type triples of the records of a class that are dissolved, or belong to no current class without an end (`at` of memberOf)."""
    flags = values.where(F.col("cls") == cls).groupBy("entity").agg(
        F.max((F.col("prop") == "dissolved") & F.col("value").isNotNull()).alias("gone"),
        F.max((F.col("prop") == "memberOf") & F.coalesce(F.col("value").isin(current), F.lit(False)) & F.col("at").isNull()).alias("now"),
    )
    none = F.lit(None).cast("string")
    return flags.where("gone or not now").select(F.col("entity").alias("s"), F.lit("rdf:type").alias("p"), F.lit("kg:FormerProvince").alias("o"), F.lit("iri").alias("o_kind"), none.alias("dt"), none.alias("lang"))


def build(records: DataFrame, triples: DataFrame, groups: dict[str, str]) -> DataFrame:
    """grp, s, p, o, o_kind, dt, lang: the triples whose subject is a record (entity, cls) with a group for its class, distinct. Triples need not be: they are shuffled once, by subject."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    seeds = records.select(F.col("entity").alias("s"), F.element_at(pairs, F.col("cls")).alias("grp")).where("grp is not null").distinct()
    return triples.join(seeds.hint("merge"), "s").select("grp", *TRIPLE).distinct()
