"""An inverted index of the three-letter grams of names: written posting lists with document frequencies, probed by the rarest gram."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.terms import fold
from graphloom.operators.closure import closure, held

#: Stands behind the end of a name, so that its last letters begin a gram too.
END = "\u0000\u0000"
#: Posting lists with more names than this are dealt to several join keys.
LIST = 20_000


@dataclass(frozen=True)
class GramIndex:
    """names (entity, name, folded), postings (gram, folded, each pair once) and frequencies (gram, n), all written."""

    names: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def _grams(text: Column) -> Column:
    """The distinct three-letter pieces of a text; none for a text of fewer letters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def gram_index(names: DataFrame) -> GramIndex:
    """Index names (entity, name, folded). A folded form that several names share is indexed once; null and empty ones are not."""
    names = held(names.select("entity", "name", "folded"), "names")
    forms = names.where("folded <> ''").select("folded").distinct()
    postings = held(forms.select(F.explode(_grams(F.concat("folded", F.lit(END)))).alias("gram"), "folded"), "postings")
    return GramIndex(names, postings, held(postings.groupBy("gram").agg(F.count("*").alias("n")), "frequencies"))


def containing(index: GramIndex, texts: DataFrame, list_size: int = LIST) -> DataFrame:
    """q, folded: the folded names that contain each text (q, folded and not empty), each pair once.

    A text of three letters or more reads the list of its rarest gram only; a shorter one reads the lists of the
    grams that begin with it. A list of more than `list_size` names is dealt by a hash of the name to as many keys
    as it needs, and the texts that read it are repeated for each: no key holds more than about that many names.
    """
    q = texts.select("q").where("q <> ''").distinct()
    terms = q.where("length(q) >= 3").select("q", F.explode(_grams(F.col("q"))).alias("gram"))
    # grams that no name has are kept with n = 0: their text finds nothing, which is the rarest gram of all
    rarest = terms.join(index.frequencies.hint("merge"), "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    long = rarest.select("q", "r.gram", "r.n").where("n > 0")
    begins = index.frequencies.select(F.explode(F.array_distinct(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2)))).alias("q"), "gram", "n")
    short = q.where("length(q) < 3").join(begins.hint("merge"), "q").select("q", "gram", "n")
    keys = lambda n: F.ceil(n / F.lit(list_size)).cast("int")
    probes = long.unionByName(short).select("q", "gram", F.explode(F.sequence(F.lit(0), keys(F.col("n")) - 1)).alias("salt"))
    big = index.frequencies.where(F.col("n") > list_size).select("gram", keys(F.col("n")).alias("keys"))  # few: their lists are long
    lists = index.postings.join(big.hint("merge"), "gram", "left").select("gram", "folded", F.when(F.col("keys").isNull(), 0).otherwise(F.pmod(F.xxhash64("folded"), F.col("keys"))).cast("int").alias("salt"))
    hit = lists.join(probes.hint("merge"), ["gram", "salt"]).where(F.contains("folded", F.col("q")))
    return hit.select("q", "folded").distinct()


def ranked_search(index: GramIndex, queries: DataFrame, k: int) -> DataFrame:
    """qid, entity, name, place: the k best names that contain each query (qid, text).

    Equal before prefix before word start before inside, then shorter names, then by name and entity; an entity
    counts by its best name. White space in queries counts as one space; null and empty queries find nothing.
    Queries of one text are answered once.
    """
    asked = queries.select("qid", F.trim(F.regexp_replace(fold(F.col("text")), r"\s+", " ")).alias("q")).where("q <> ''")
    hit = containing(index, asked)
    rank = F.when(F.col("folded") == F.col("q"), 0).when(F.startswith("folded", F.col("q")), 1).when(F.contains(F.concat(F.lit(" "), "folded"), F.concat(F.lit(" "), "q")), 2).otherwise(3)
    named = hit.withColumn("rank", rank).join(index.names.hint("merge"), "folded")
    best = named.groupBy("q", "entity").agg(F.min(F.struct("rank", F.length("name").alias("n"), "name")).alias("b"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("b.rank", "b.n", "b.name", "entity"))
    top = best.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("q", "entity", "b.name", "place")
    return asked.join(top.hint("merge"), "q").select("qid", "entity", "name", "place")


def filtered_classes(index: GramIndex, members: DataFrame, sub_class: DataFrame, texts: DataFrame, cap: int = 100) -> DataFrame:
    """q, cls, total, place, entity, name: each class's own members (entity, cls) with a name that contains the text (text).

    `cap` members are shown, by name, all are counted. A class without such members has one row without an entity
    if one below it (sub_class has sub, sup) has some; other classes are gone.
    """
    asked = texts.select(F.trim(F.regexp_replace(fold(F.col("text")), r"\s+", " ")).alias("q"))
    named = containing(index, asked).join(index.names.hint("merge"), "folded").groupBy("q", "entity").agg(F.min("name").alias("name"))
    found = held(named.join(members.select("entity", "cls").distinct().hint("merge"), "entity"), "found")
    totals = found.groupBy("q", "cls").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("q", "cls").orderBy("name", "entity"))
    shown = found.withColumn("place", place.cast("long")).where(F.col("place") <= cap)
    above = totals.join(closure(sub_class).select(F.col("sub").alias("cls"), "sup").hint("merge"), "cls").select("q", F.col("sup").alias("cls"), F.lit(0).cast("long").alias("total"))
    kept = totals.unionByName(above).groupBy("q", "cls").agg(F.max("total").alias("total"))
    return kept.join(shown.hint("merge"), ["q", "cls"], "left").select("q", "cls", "total", "place", "entity", "name")


def cells_to_entities(cells: DataFrame, names: DataFrame, entities: DataFrame, own: str, longest: int | None = None) -> DataFrame:
    """cell, node, how of each distinct cell (cell): an own IRI that is an entity, a web address without a space, or a folded name of one entity only.

    names has entity, folded; entities a column entity. Other cells, empty ones and, as names, those of more than
    `longest` characters have null for both; null cells are left out.
    """
    cells = cells.select("cell").where("cell is not null").distinct()
    known = entities.select(F.col("entity").alias("cell")).distinct().withColumn("is_own", F.lit(True))
    unique = names.where("folded <> ''").groupBy("folded").agg(F.min("entity").alias("one"), F.max("entity").alias("two")).where("one = two").select("folded", "one")
    mine, web = F.startswith("cell", F.lit(own)), F.col("cell").rlike("^https?://[^ ]*$")
    rows = cells.join(known.hint("merge"), "cell", "left").withColumn("folded", fold(F.col("cell"))).join(unique.hint("merge"), "folded", "left")
    short = F.length("cell") <= longest if longest is not None else F.lit(True)
    how = F.when(mine, F.when(F.col("is_own"), "own")).when(web, "web").when(F.col("one").isNotNull() & short, "name")
    return rows.select("cell", F.when(how == "name", F.col("one")).when(how.isNotNull(), F.col("cell")).alias("node"), how.alias("how"))
