"""What proposed triples would add to the graph, each on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import held
from graphloom.operators.inference import (
    FACT, TYPE, Ontology, rule_all_values, rule_chain, rule_domain, rule_inverse, rule_range, rule_some_values, rule_sub_class, rule_sub_property, schema_closure,
)
from graphloom.operators.sieve import sifted

TAGGED = ["id", *FACT]
#: Rows (of five short strings) up to which a side is broadcast.
FEW = 200_000
#: Classes of asked types up to which other types of the graph are left out before they are looked up.
CLASSES = 1_000


def _new(found: DataFrame, known: DataFrame, mine: DataFrame | None) -> DataFrame:
    """Rows of found that neither the graph nor the proposal itself has. Found is counted: few rows go to where the graph's are, for more the graph is sifted, and what passes meets them by sort-merge."""
    found = held(found.select(*TAGGED).distinct(), "found")
    how = "broadcast" if found.count() <= FEW else "merge"
    asked, there = held(found.select(*FACT).distinct(), "asked"), known.where(F.col("p").isin([r.p for r in found.select("p").distinct().collect()])).select(*FACT)
    classes = [r.o for r in asked.where(F.col("p") == TYPE).select("o").distinct().limit(CLASSES + 1).collect()]
    there = there if len(classes) > CLASSES else there.where((F.col("p") != TYPE) | F.col("o").isin(classes))
    there = there if how == "broadcast" else sifted(there, FACT, asked)
    there = held(there.join(asked.hint(how), FACT, "left_semi").distinct(), "there")
    new = found.join(there.hint(how), FACT, "left_anti")
    return held(new if mine is None else new.join(mine.hint("merge"), TAGGED, "left_anti"), "delta")


def consequences(proposals: DataFrame, graph: DataFrame, tbox: Ontology) -> DataFrame:
    """id, s, p, o, o_kind: what each proposal (id, s, p, o, o_kind) adds to the graph, itself included, as if it were the only one.

    graph has the asserted triples and those that follow (parts.store, or both as they come): it is closed, so rules
    start from the proposals only. A round applies them to what the last one found; premises come from the graph, of
    the predicates that the axioms name, or from what the same proposal has added. An axiom runs only if the last
    round has a predicate or class that it starts from. Found rows carry their proposal's id and are joined to the
    graph by subject or object; of the graph only rows that pass a sieve of what is looked for are shuffled, so what is
    moved grows with the proposals, not with the graph.
    """
    known = graph.where(F.col("part") != "ontology")
    classes, props = schema_closure(tbox.sub_class), schema_closure(tbox.sub_prop)
    of = lambda df, c: {r[c] for r in df.collect()}  # noqa: E731  axioms, schema-sized
    fillers, starts = of(tbox.some_values, "filler"), of(tbox.all_values, "cls")
    # rule, predicates (and classes) of its two premises, its axioms, the columns by which the premises meet
    pairs = (
        (rule_chain, (of(tbox.chain, "p1"), None), (of(tbox.chain, "p2"), None), tbox.chain, ("o", "s")),
        (rule_some_values, (of(tbox.some_values, "p"), None), ({TYPE}, fillers), tbox.some_values, ("o", "s")),
        (rule_all_values, ({TYPE}, starts), (of(tbox.all_values, "p"), None), tbox.all_values, ("s", "s")),
    )

    def premise(df: DataFrame, want: tuple[set[str], set[str] | None]) -> DataFrame:
        rows = df.where(F.col("p").isin(sorted(want[0])))
        return rows if want[1] is None else rows.where(F.col("o").isin(sorted(want[1])))

    def kinds(df: DataFrame) -> set[tuple[str, str | None]]:
        """Predicates, and the classes of types that the axioms name."""
        cls = F.when((F.col("p") == TYPE) & F.col("o").isin(sorted(fillers | starts)), F.col("o"))
        return {(r.p, c) for r in df.select("p", cls.alias("c")).distinct().collect() for c in {r.c, None}}

    def has(seen: set[tuple[str, str | None]], want: tuple[set[str], set[str] | None]) -> bool:
        return any((p, c) in seen for p in want[0] for c in ({None} if want[1] is None else want[1]))

    delta, mine, seen = _new(proposals, known, None), None, set()
    while new := kinds(delta):
        mine, seen, few = delta if mine is None else mine.unionByName(delta), seen | new, delta.count() <= FEW
        found = [rule_sub_class(delta, classes), rule_sub_property(delta, props), rule_domain(delta, tbox.prop), rule_range(delta, tbox.prop), rule_inverse(delta, tbox.inverse)]
        for rule, a, b, axioms, (left, right) in pairs:
            how = "broadcast" if few else None
            whole = lambda want, column, other, at: premise(known, want).select(*FACT) if few else sifted(premise(known, want).select(*FACT), [column], held(other.select(at).distinct(), "looked"))  # noqa: E731,B023
            if has(new, a):
                one = premise(delta, a)
                found.append(rule(one, whole(b, right, one, left), axioms, (how, None)))
                if has(seen, b):
                    found.append(rule(one, premise(mine, b), axioms))
            if has(new, b):
                two = premise(delta, b)
                found.append(rule(whole(a, left, two, right), two, axioms, (None, how)))
                if has(seen, a):
                    found.append(rule(premise(mine, a), two, axioms))
        delta = _new(reduce(DataFrame.unionByName, [f.select(*TAGGED) for f in found]), known, mine)
    return delta if mine is None else mine


def gained_classes(proposals: DataFrame, added: DataFrame, own: str) -> DataFrame:
    """id, node, cls: classes of the own namespace that an end of a proposal gains; the object is no end where a type is proposed."""
    ends = F.array(F.struct(F.lit("s").alias("end"), F.col("s").alias("node")), F.struct(F.lit("o").alias("end"), F.col("o").alias("node")))
    nodes = proposals.select("id", "p", F.explode(ends).alias("e")).where((F.col("e.end") == "s") | (F.col("p") != TYPE)).select("id", "e.node").distinct()
    types = added.where((F.col("p") == TYPE) & F.startswith("o", F.lit(own))).select("id", F.col("s").alias("node"), F.col("o").alias("cls"))
    return types.join(nodes.hint("merge"), ["id", "node"]).distinct()


def property_axioms(proposals: DataFrame, prop: DataFrame) -> DataFrame:
    """id, p, domain, range, kind, functional of the proposed property; nulls where the ontology has none."""
    return proposals.select("id", "p").join(F.broadcast(prop), "p", "left").select("id", "p", "domain", "range", "kind", "functional")
