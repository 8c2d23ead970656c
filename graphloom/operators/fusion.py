"""Fusing several sources into triples: ranks, precedence, references, career rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import wikitext as X


def totals(given: DataFrame, parts: DataFrame) -> DataFrame:
    """entity, value: the given total, or the sum of the parts where it is missing."""
    rest = parts.join(given.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.sum("value").alias("value"))
    return given.select("entity", "value").unionByName(rest)


def raw_properties(rows: DataFrame, links: int = 10, chars: int = 500) -> DataFrame:
    """s, p, o, o_kind, dt from (s, key, raw): linked titles (up to `links`) if any, else the text unless longer than `chars`; digits are an xsd:integer."""
    item = lambda o, kind: F.struct(o.alias("o"), F.lit(kind).alias("o_kind"))
    items = F.transform(F.array(X.links(F.col("raw"))), lambda found: F.when(F.size(found) > 0, F.transform(F.slice(found, 1, links), lambda o: item(o, "iri"))).otherwise(F.array(item(X.render(F.col("raw")), "lit"))))[0]
    out = rows.select("s", F.col("key").alias("p"), F.inline(items)).where((F.col("o_kind") == "iri") | ((F.col("o") != "") & (F.length("o") <= chars)))
    digits = (F.col("o_kind") == "lit") & F.col("o").rlike(r"^[0-9]+$")
    return out.select("s", "p", F.when(digits, F.regexp_replace("o", r"^0+(?=[0-9])", "")).otherwise(F.col("o")).alias("o"), "o_kind", F.when(digits, "xsd:integer").alias("dt"))


def best(statements: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """The preferred statements of each key if there is one, else all."""
    any_ = F.max(preferred.cast("int")).over(Window.partitionBy(*keys))
    return statements.withColumn("_any", any_).where(preferred | (F.col("_any") == 0)).drop("_any")


def pick(first: Column, second: Column, prefer_first: Column) -> Column:
    """One of two sources' values by precedence, the other where it is missing."""
    return F.when(prefer_first, F.coalesce(first, second)).otherwise(F.coalesce(second, first))


def mapped(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fields (entity, key, raw) by a mapping (key, property, prio), case-insensitively; the first key of a property wins."""
    both = fields.withColumn("key", F.lower("key")).join(F.broadcast(mapping), "key")
    first = F.row_number().over(Window.partitionBy("entity", "property").orderBy("prio", "key"))
    return both.withColumn("_n", first).where("_n = 1").select("entity", "property", "raw")


def coverage(fields: DataFrame, mapping: DataFrame, parsed: Column) -> DataFrame:
    """status, key, n: how often a key is mapped and parsed, mapped but not parsed, or unmapped."""
    both = fields.join(F.broadcast(mapping.select("key", "property")), "key", "left")
    status = F.when(F.col("property").isNull(), "unmapped").when(parsed, "parsed").otherwise("failed")
    return both.groupBy(status.alias("status"), "key").agg(F.count("*").alias("n"))


def references(refs: DataFrame, own: DataFrame, titles: DataFrame) -> DataFrame:
    """ref -> iri: an own entity (ref, iri), else an article title (ref, title), else the external id."""
    out = refs.join(own, "ref", "left").join(titles, "ref", "left")
    return out.select("ref", F.coalesce("iri", F.concat(F.lit("kg:article/"), "title"), F.concat(F.lit("ext:"), "ref")).alias("iri"))


def allowed(links: DataFrame, classes: DataFrame, allow: list[str], known_only: bool = False) -> DataFrame:
    """Links (s, o) whose target has an allowed class (o, cls); targets without a class pass unless known_only."""
    both = links.join(classes, "o", "left")
    ok = F.col("cls").isin(allow) if allow else F.lit(False)
    return both.where(ok if known_only else F.col("cls").isNull() | ok).select("s", "o").distinct()


def series(fields: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """entity, n and a column per kind from numbered keys such as years1, clubs1: prefix -> column."""
    prefix, n = F.regexp_extract("key", r"^([a-z]+)(\d+)$", 1), F.regexp_extract("key", r"^([a-z]+)(\d+)$", 2).try_cast("int")
    rows = fields.withColumn("_p", prefix).withColumn("n", n).where(F.col("_p").isin(list(kinds)))
    return rows.groupBy("entity", "n").agg(*[F.max(F.when(F.col("_p") == p, F.col("raw"))).alias(c) for p, c in kinds.items()])


def numbered(stations: DataFrame, entity: str, *order: Column) -> DataFrame:
    """Stations with their number per entity, `idx`, in the given order."""
    return stations.withColumn("idx", F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("long"))


def with_fallback(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and those of other whose keys rows lack."""
    return rows.unionByName(other.join(rows.select(*keys).distinct(), keys, "left_anti"))


def latest(statements: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """The value with the largest time (a string; missing lowest), the largest value on ties, and its year."""
    top = F.max(F.struct(F.coalesce(F.col(time), F.lit("")).alias("t"), F.col(value).alias("v"))).alias("b")
    return statements.groupBy(key).agg(top).select(key, F.col("b.v").alias(value), F.substring("b.t", 1, 4).try_cast("int").alias("year"))
