"""Triples of article records: core facts, coordinates, and link targets as IRIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as N

TRIPLE = "array<struct<p: string, o: string, o_kind: string, dt: string, lang: string>>"


def fact(p: str, o: Column, kind: str = "lit", dt: str | None = None, lang: str | None = None) -> Column:
    """A triple of a record but for its subject."""
    return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt"), F.lit(lang).cast("string").alias("lang"))


def facts_of(records: DataFrame, facts: list[Column]) -> DataFrame:
    """s, p, o, o_kind, dt, lang: the facts of records (entity) that have a value."""
    every = F.filter(F.array(*facts), lambda f: f["o"].isNotNull() & (f["o"] != ""))
    return records.select(F.col("entity").alias("s"), F.explode(every).alias("f")).select("s", "f.*")


def core(records: DataFrame, site: str, lang: str, other_lang: str) -> DataFrame:
    """s, p, o, o_kind, dt, lang of every record: types, labels, abstracts, page data, source page both ways, same-as and image.

    records has entity, cls, title, en_title, qid_iri, abstract, pageid, revid, length, image; a field that is
    null or empty gives no triple. The source page's way back has the page as its subject.
    """
    page = N.page_url(F.col("title"), site)
    own = facts_of(
        records,
        [
            fact("rdf:type", F.col("cls"), "iri"), fact("rdfs:label", F.col("title"), lang=lang), fact("rdfs:label", F.col("en_title"), lang=other_lang),
            fact("owl:sameAs", F.col("qid_iri"), "iri"), fact("kg:abstract", F.col("abstract"), lang=lang), fact("rdfs:comment", N.short_abstract(F.col("abstract")), lang=lang),
            fact("kg:pageId", F.col("pageid"), dt="xsd:integer"), fact("kg:revisionId", F.col("revid"), dt="xsd:integer"), fact("kg:pageLength", F.col("length"), dt="xsd:integer"),
            fact("kg:page", page, "iri"), fact("kg:derivedFrom", F.when(F.col("revid").isNotNull(), F.concat(page, F.lit("?oldid="), "revid")), "iri"),
            fact("kg:image", N.safe_iri(F.col("image")), "iri"),
        ],
    )
    back = records.where("title is not null").select(page.alias("s"), F.lit("kg:topic").alias("p"), F.col("entity").alias("o"), F.lit("iri").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("dt", "lang")])
    return own.unionByName(back)


def coordinates(records: DataFrame) -> DataFrame:
    """s, p, o, o_kind, dt, lang: latitude, longitude and point of the structured WKT `point`, else of `lat` and `lon`, six decimals, half to even."""
    held = N.point(F.col("point"))
    given = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    at = records.select("entity", F.coalesce(held, given).alias("at")).where("at is not null")
    lat, lon = (F.bround(F.col(f"at.{c}"), 6) for c in ("lat", "lon"))
    return facts_of(at, [fact("geo:lat", lat, dt="xsd:double"), fact("geo:long", lon, dt="xsd:double"), fact("geo:point", F.concat_ws(" ", lat.cast("string"), lon.cast("string")))])


def link_iris(links: DataFrame, targets: DataFrame, namespace: str) -> DataFrame:
    """links with `iri` of each `raw` title: that of the page which a redirect leads to, of the title itself where nothing is known, null for disambiguation pages.

    targets has raw, title (null: no such page), disambiguation.
    """
    known = targets.select("raw", F.col("title").alias("_title"), F.coalesce("disambiguation", F.lit(False)).alias("_many"))
    title = N.norm_title(F.coalesce("_title", "raw"))
    return links.join(known.hint("merge"), "raw", "left").select(*links.columns, F.when(~F.coalesce("_many", F.lit(False)), N.resource_iri(title, namespace)).alias("iri"))
