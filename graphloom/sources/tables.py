"""Readers of the source tables and the graph that Spark derives from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = ["part", "s", "p", "o", "o_kind", "dt", "lang"]
TERMS = ["s", "p", "o", "o_kind", "dt", "lang"]
TYPE, LABEL, SAME_AS = "rdf:type", "rdfs:label", "owl:sameAs"
#: Station class of each order status.
STATION = {"F": "kg:ClubStation", "O": "kg:YouthStation", "P": "kg:NationalTeamStation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by key in as many parts as shuffles have: small files of many rows are read by few tasks, which is too few for heavy work on each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, by Spark's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def iri(kind: str, key: str | Column) -> Column:
    """IRI of an entity: kg:<kind>/<key>."""
    return F.concat(F.lit(f"kg:{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _rows(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri", dt: str | None = None, lang: str | None = None) -> DataFrame:
    return df.select(
        F.lit("asserted").alias("part"), s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt"), F.lit(lang).cast("string").alias("lang"),
    )


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asserted triples.

    Regions are countries and nations provinces (every third one former, with a successor); customers are
    players, orders their career stations, suppliers clubs and teams, parts stadiums. A filter on `p`
    leaves only the branches, and so the tables, that produce the predicate.
    """
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, orders = t("region"), t("nation"), t("customer"), t("orders")
    supplier, part, line = t("supplier"), t("part"), t("lineitem")
    former = nation.where("n_nationkey % 3 = 2")
    station = F.element_at(F.create_map(*[F.lit(x) for kv in STATION.items() for x in kv]), F.col("o_orderstatus"))
    ground = line.groupBy("l_suppkey").agg(F.min("l_partkey").alias("partkey"))
    team = line.select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()  # what is said of a station stays together
    cls = F.lit
    branches = [
        _rows(region, iri("country", "r_regionkey"), TYPE, cls("kg:Country")),
        _rows(region, iri("country", "r_regionkey"), LABEL, F.col("r_name"), "lit", None, "en"),
        _rows(nation, iri("province", "n_nationkey"), TYPE, cls("kg:Province")),
        _rows(nation, iri("province", "n_nationkey"), LABEL, F.col("n_name"), "lit", None, "en"),
        _rows(nation, iri("province", "n_nationkey"), "kg:locatedIn", iri("country", "n_regionkey")),
        _rows(former, iri("province", "n_nationkey"), TYPE, cls("kg:FormerProvince")),
        _rows(former, iri("province", "n_nationkey"), "kg:successor", iri("province", F.expr("n_nationkey div 2"))),
        _rows(customer, iri("player", "c_custkey"), TYPE, cls("kg:FootballPlayer")),
        _rows(customer, iri("player", "c_custkey"), LABEL, F.col("c_name"), "lit", None, "en"),
        _rows(customer, iri("player", "c_custkey"), "kg:birthProvince", iri("province", "c_nationkey")),
        _rows(orders, iri("player", "o_custkey"), "kg:careerStation", iri("station", "o_orderkey")),
        _rows(orders, iri("station", "o_orderkey"), TYPE, station),
        _rows(orders, iri("station", "o_orderkey"), "kg:startYear", F.year("o_orderdate"), "lit", "xsd:gYear"),
        _rows(team, iri("station", "l_orderkey"), "kg:team", iri("club", "l_suppkey")),
        _rows(supplier, iri("club", "s_suppkey"), TYPE, cls("kg:FootballClub")),
        _rows(supplier, iri("club", "s_suppkey"), LABEL, F.col("s_name"), "lit", None, "en"),
        _rows(supplier, iri("club", "s_suppkey"), "kg:province", iri("province", "s_nationkey")),
        _rows(ground, iri("club", "l_suppkey"), "kg:ground", iri("stadium", "partkey")),
        _rows(part, iri("stadium", "p_partkey"), TYPE, cls("kg:Stadium")),
        _rows(part, iri("stadium", "p_partkey"), LABEL, F.col("p_name"), "lit", None, "en"),
        _rows(part, iri("stadium", "p_partkey"), "kg:capacity", F.col("p_size"), "lit", "xsd:integer"),
        _rows(part, iri("stadium", "p_partkey"), "kg:province", iri("province", F.expr("p_partkey % 25"))),
    ]
    return reduce(DataFrame.unionByName, branches)
