"""Names and search, entity views, class browser, geography, question linking and what-if checks, each for a table of entities or requests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.terms import fold
from graphloom.operators.chains import final_successor
from graphloom.operators.closure import closure, held
from graphloom.operators.grams import gram_index, ranked_search
from graphloom.operators.inference import TYPE

LABEL = "rdfs:label"


def preferred_labels(labels: DataFrame, languages: list[str]) -> DataFrame:
    """s, label: the label in the first language there is, the smallest if several."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    best = F.min(F.struct(F.when(rank > 0, rank).otherwise(len(languages) + 1).alias("r"), F.col("o")))
    return labels.groupBy("s").agg(best.alias("b")).select("s", F.col("b.o").alias("label"))


def display_class(types: DataFrame, order: list[str]) -> DataFrame:
    """s, cls: the first class of the order that an entity has."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("o"))
    return types.where(rank > 0).groupBy("s").agg(F.min_by("o", rank).alias("cls"))


def name_index(triples: DataFrame, main: list[str]) -> DataFrame:
    """entity, name, folded over the labels of entities of the main classes."""
    members = triples.where((F.col("p") == TYPE) & F.col("o").isin(main)).select("s")
    names = triples.where(F.col("p").isin(LABEL, "skos:altLabel")).select("s", "o").distinct()
    return names.join(members, "s", "left_semi").select(F.col("s").alias("entity"), F.col("o").alias("name"), fold(F.col("o")).alias("folded"))


def search(names: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, entity, name, place: the k best names that contain each query (qid, text), by an index of the names made for it."""
    return ranked_search(gram_index(names), queries, k)


def counted(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Add the 1-based rank by a column: row numbers inside written range partitions plus the counts of those before, so no task sorts all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = held(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "counted")
    before = part.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("_n", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def property_table(triples: DataFrame, cap: int = 40) -> DataFrame:
    """s, p, o, place, total: values per property, IRIs first, sorted; `cap` shown, all counted."""
    w = Window.partitionBy("s", "p")
    place = F.row_number().over(w.orderBy((F.col("o_kind") == "lit"), "o"))
    return triples.select("s", "p", "o", place.cast("long").alias("place"), F.count("*").over(w).alias("total")).where(F.col("place") <= cap)


def referenced_by(triples: DataFrame, cap: int = 40) -> DataFrame:
    """o, p, s, place, total: who refers to an entity by a property, `cap` shown, all counted."""
    w = Window.partitionBy("o", "p")
    rows = triples.where("o_kind = 'iri'").select("o", "p", "s").distinct()
    return rows.select("o", "p", "s", F.row_number().over(w.orderBy("s")).cast("long").alias("place"), F.count("*").over(w).alias("total")).where(F.col("place") <= cap)


def neighbours(triples: DataFrame, links: list[str], not_inbound: list[str]) -> DataFrame:
    """node, other, side, props: one-hop neighbours over link properties, each once, out before in."""
    t = triples.where(F.col("p").isin(links) & (F.col("o_kind") == "iri"))
    out = t.select(F.col("s").alias("node"), F.col("o").alias("other"), F.lit(0).alias("side"), "p")
    into = t.where(~F.col("p").isin(not_inbound)).select(F.col("o").alias("node"), F.col("s").alias("other"), F.lit(1).alias("side"), "p")
    per = out.unionByName(into).groupBy("node", "other").agg(F.min("side").alias("side"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("props"))
    return per.select("node", "other", F.when(F.col("side") == 0, "out").otherwise("in").alias("side"), "props")


def round_robin(near: DataFrame, n: int) -> DataFrame:
    """n neighbours per node and side, taking one of each leading property in turn."""
    lead = F.split("props", ",")[0]
    turn = F.row_number().over(Window.partitionBy("node", "side", "lead").orderBy("other"))
    rows = near.withColumn("lead", lead).withColumn("turn", turn)
    place = F.row_number().over(Window.partitionBy("node", "side").orderBy("turn", "lead"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n).select("node", "side", "other", "place")


def relation_tree(edges: DataFrame, roots: DataFrame, fanout: tuple[int, ...] = (15, 8, 6), budget: int = 300) -> DataFrame:
    """root, depth, node, parent: bounded expansion without repeats on a path; level order, `budget` nodes per root.

    edges has s, o.
    """
    level = roots.select(F.col("root"), F.col("root").alias("node"), F.array("root").alias("path"))
    out = None
    for depth, cap in enumerate(fanout, 1):
        step = level.join(edges.select(F.col("s").alias("node"), F.col("o").alias("next")), "node").where(~F.array_contains("path", F.col("next")))
        place = F.row_number().over(Window.partitionBy("root", "path").orderBy("next"))
        step = step.withColumn("_n", place).where(F.col("_n") <= cap)
        level = step.select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        rows = level.select("root", F.lit(depth).alias("depth"), "node", F.array_join("path", ">").alias("path"))
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "path"))
    return out.withColumn("_n", place).where(F.col("_n") <= budget).drop("_n")


def lanes(stations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, lane, beside of rows (keys, id, start, end): the first lane that is free at the start, and how many rows still run then.

    Rows are dealt by key and sorted by start, end and id; a sweep keeps the running rows' ends in a heap, so memory
    grows with the rows that overlap, not with those of a key. A row ends before one that starts at its end; one
    without an end keeps its lane; rows without a start are left out.
    """
    rows = stations.where("start is not null").select(*keys, "id", "start", "end").repartition(*keys).sortWithinPartitions(*keys, "start", F.col("end").asc_nulls_last(), "id")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, "id").schema]
    return rows.mapInArrow(partial(_sweep, keys=keys), ", ".join([*fields, "lane int", "beside int"]))


def _sweep(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    now, running, free, used = None, [], [], 0
    for batch in batches:
        out = []
        key_of = zip(*(batch.column(k).to_pylist() for k in keys))
        for key, start, end in zip(key_of, batch.column("start").to_pylist(), batch.column("end").to_pylist()):
            if key != now:
                now, running, free, used = key, [], [], 0
            while running and running[0][0] <= start:
                heappush(free, heappop(running)[1])
            beside = used - len(free)
            if free:
                lane = heappop(free)
            else:
                lane, used = used, used + 1
            if end is not None:
                heappush(running, (end, lane))
            out.append((lane, beside))
        lane, beside = (pa.array([x[k] for x in out], pa.int32()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, "id"]), lane, beside], names=[*keys, "id", "lane", "beside"])


def direct_members(types: DataFrame, sub_class: DataFrame) -> DataFrame:
    """s, cls: members of a class that are in none of its descendants. types has s, cls."""
    below = closure(sub_class).select(F.col("sup").alias("cls"), F.col("sub").alias("under"))
    covered = types.withColumnRenamed("cls", "under").join(F.broadcast(below), "under").select("s", "cls").distinct()
    return types.join(covered, ["s", "cls"], "left_anti")


def folded_counts(members: DataFrame, succession: DataFrame) -> DataFrame:
    """unit, n: distinct members per unit after former units are folded into their final successor. members has unit, member."""
    final = final_successor(succession)
    both = members.join(final.select(F.col("node").alias("unit"), "final"), "unit", "left")
    return both.groupBy(F.coalesce("final", "unit").alias("unit")).agg(F.count_distinct("member").alias("n"))


def quantile_breaks(values: DataFrame, ps: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row of breaks: the lower-index quantiles of the positive values, from counts per value; distinct."""
    counts = values.where("v > 0").groupBy("v").agg(F.count("*").alias("c"))
    run = counts.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    cols = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("n")), F.col("v"))) for p in ps]
    return run.agg(F.array_sort(F.array_distinct(F.array(*cols))).alias("breaks"))


def conflicts(proposals: DataFrame, types: DataFrame, prop: DataFrame, sub_class: DataFrame, disjoint: DataFrame) -> DataFrame:
    """id, side, known, new: classes that a proposed triple gives an end although it has a disjoint one.

    proposals has id, s, p, o; types the known ones (s, cls).
    """
    up = closure(sub_class, reflexive=True).select(F.col("sub").alias("cls"), F.col("sup"))
    grow = lambda df: df.join(F.broadcast(up), "cls", "left").withColumn("cls", F.coalesce("sup", "cls")).drop("sup").distinct()
    axioms = F.broadcast(prop.select("p", "domain", "range", "kind"))
    both = proposals.join(axioms, "p")
    gained = both.where("domain is not null").select("id", F.lit("domain").alias("side"), F.col("s"), F.col("domain").alias("cls")).unionByName(
        both.where("range is not null and kind = 'object'").select("id", F.lit("range").alias("side"), F.col("o").alias("s"), F.col("range").alias("cls"))
    )
    group = F.broadcast(disjoint)
    new = grow(gained).join(group, "cls").select("id", "side", "s", "grp", F.col("cls").alias("new"))
    known = grow(types).join(group, "cls").select("s", "grp", F.col("cls").alias("known"))
    return new.join(known, ["s", "grp"]).where("new <> known").select("id", "side", "known", "new").distinct()


def cards(triples: DataFrame, spaces: dict[str, str], page: str, derived: str, lat: tuple[str, ...], lon: tuple[str, ...]) -> DataFrame:
    """entity, a column per name of `spaces`, page, derived, revision, lat, lon of every subject that has one of them.

    A column of `spaces` has the same-as IRIs with its prefix, sorted and comma-joined. The first property of
    `lat` and `lon` with a value counts; of several values the smallest. revision is the number after oldid=.
    """
    used = ["owl:sameAs", page, derived, *lat, *lon]
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    same = [F.array_join(F.array_sort(F.collect_set(F.when((F.col("p") == "owl:sameAs") & F.startswith("o", F.lit(start)), F.col("o")))), ",").alias(name) for name, start in spaces.items()]
    first = lambda props: F.coalesce(*[one(p).try_cast("double") for p in props])
    per = triples.where(F.col("p").isin(used)).groupBy(F.col("s").alias("entity")).agg(*same, one(page).alias("page"), one(derived).alias("derived"), first(lat).alias("lat"), first(lon).alias("lon"))
    return per.withColumn("revision", F.regexp_extract("derived", r"oldid=([0-9]+)", 1).try_cast("long"))


def asserted_neighbours(triples: DataFrame) -> DataFrame:
    """node, side, other, props: links to other entities both ways, asserted ones only; neighbours without one are gone. triples has part."""
    links = triples.where("part = 'asserted' and o_kind = 'iri' and s <> o")
    both = links.select(F.col("s").alias("node"), F.lit("out").alias("side"), F.col("o").alias("other"), "p").union(links.select("o", F.lit("in"), "s", "p"))
    return both.groupBy("node", "side", "other").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("props"))


def relation_groups(triples: DataFrame, nodes: DataFrame, out: list[str], into: list[str], also_inferred: tuple[str, ...] = (), province: str = "kg:province", located: str = "kg:locatedIn") -> DataFrame:
    """node, place, p, side, other: the relations of the nodes as groups in the order of `out`, then of `into`.

    Asserted links only, but for incoming ones of `also_inferred`; a place that is already the province of a
    node is not among its `located`. triples has part, nodes a column node.
    """
    places = [(p, "out", k) for k, p in enumerate(out)] + [(p, "in", len(out) + k) for k, p in enumerate(into)]
    order = F.broadcast(triples.sparkSession.createDataFrame(places, "p string, side string, place int"))
    links = triples.where((F.col("o_kind") == "iri") & F.col("p").isin([*out, *into]) & ((F.col("part") == "asserted") | F.col("p").isin(list(also_inferred))))
    ends = F.explode(F.array(F.struct(F.col("s").alias("node"), F.lit("out").alias("side"), F.col("o").alias("other")), F.struct(F.col("o").alias("node"), F.lit("in").alias("side"), F.col("s").alias("other"))))
    rows = links.select("part", "p", ends.alias("e")).select("part", "p", "e.*").where((F.col("side") == "in") | (F.col("part") == "asserted"))
    rows = rows.join(order, ["p", "side"]).join(nodes.select("node").distinct().hint("merge"), "node", "left_semi")
    held_in = (F.col("side") == "out") & (F.col("p") == province)
    doubled = F.max(held_in).over(Window.partitionBy("node", "side", "other")) & (F.col("p") == located)
    return rows.withColumn("_doubled", doubled).where("not _doubled").select("node", "place", "p", "side", "other").distinct()
