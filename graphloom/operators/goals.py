"""Answering one goal from the axioms that it needs, instead of materialising all that follows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.inference import FACT, TYPE, Ontology, materialise


#: Predicates and classes up to which a goal is unfolded into one plan; beyond, its slice is materialised in rounds. Both give the same rows.
UNFOLD = 8


class Recursive(Exception):
    """A goal needs itself or very many others, so that rules have to be applied to a fixpoint."""


@dataclass
class Rules:
    """The axioms by what they conclude; schema-sized, on the driver."""

    tbox: Ontology
    sub_class: dict[str, set[str]] = field(default_factory=dict)
    sub_prop: dict[str, set[str]] = field(default_factory=dict)
    domain: dict[str, set[str]] = field(default_factory=dict)
    range: dict[str, set[str]] = field(default_factory=dict)
    inverse: dict[str, set[str]] = field(default_factory=dict)
    chain: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    some: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    every: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        t = self.tbox
        for table, into, key, value in (
            (t.sub_class.where("sub <> sup"), self.sub_class, "sup", "sub"), (t.sub_prop.where("sub <> sup"), self.sub_prop, "sup", "sub"),
            (t.prop.where("domain is not null"), self.domain, "domain", "p"), (t.prop.where("range is not null and kind = 'object'"), self.range, "range", "p"),
            (t.inverse, self.inverse, "p", "q"), (t.inverse, self.inverse, "q", "p"),
        ):
            for r in table.collect():
                into.setdefault(r[key], set()).add(r[value])
        for r in t.chain.collect():
            self.chain.setdefault(r.p, set()).add((r.p1, r.p2))
        for r in t.some_values.collect():
            self.some.setdefault(r["cls"], set()).add((r.p, r.filler))
        for r in t.all_values.collect():
            self.every.setdefault(r.filler, set()).add((r["cls"], r.p))


def needed(rules: Rules, predicates: Iterable[str] = (), classes: Iterable[str] = ()) -> tuple[set[str], set[str]]:
    """(predicates, classes) whose asserted facts and rules can lead to a goal: the axioms followed backwards."""
    preds, types, todo = set(), set(), [("p", x) for x in predicates] + [("c", x) for x in classes]
    while todo:
        kind, x = todo.pop()
        seen = preds if kind == "p" else types
        if x in seen:
            continue
        seen.add(x)
        if kind == "p":
            todo += [("p", q) for q in rules.sub_prop.get(x, set()) | rules.inverse.get(x, set())]
            todo += [("p", q) for pair in rules.chain.get(x, ()) for q in pair]
        else:
            todo += [("c", c) for c in rules.sub_class.get(x, ())]
            todo += [("p", q) for q in rules.domain.get(x, set()) | rules.range.get(x, set())]
            todo += [g for q, filler in rules.some.get(x, ()) for g in (("p", q), ("c", filler))]
            todo += [g for c, q in rules.every.get(x, ()) for g in (("p", q), ("c", c))]
    return preds, types


def slice_of(facts: DataFrame, rules: Rules, predicates: Iterable[str] = (), classes: Iterable[str] = ()) -> tuple[DataFrame, Ontology]:
    """The facts and the axioms that a goal needs."""
    preds, types = needed(rules, predicates, classes)
    within = lambda c, names: F.col(c).isin(sorted(names)) if names else F.lit(False)
    keep = within("p", preds - {TYPE}) if not types else within("p", preds | {TYPE}) & ((F.col("p") != TYPE) | within("o", types))
    t = rules.tbox
    prop = t.prop.withColumns({"domain": F.when(within("domain", types), F.col("domain")), "range": F.when(within("range", types), F.col("range"))})
    both = within("p", preds) & within("q", preds)
    sliced = Ontology(
        t.sub_class.where(within("sup", types)), t.sub_prop.where(within("sup", preds)), prop, t.inverse.where(both), t.chain.where(within("p", preds)),
        t.some_values.where(within("cls", types)), t.all_values.where(within("filler", types)), t.disjoint,
    )
    return facts.where(keep).select(*FACT), sliced


class Unfolded:
    """Goals written out as joins and unions over asserted facts, with constants pushed down to the facts they bind."""

    def __init__(self, facts: DataFrame, rules: Rules):
        self.facts, self.rules = facts, rules

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def edges(self, p: str, s: list[str] | None = None, o: list[str] | None = None, path: tuple = (), back: str | None = None) -> DataFrame:
        """s, o, o_kind of p, bound to constants where given. back: the inverse from which the goal comes."""
        if ("p", p) in path:
            raise Recursive(p)
        path, rules = (*path, ("p", p)), self.rules
        own = self.facts.where(F.col("p") == p)
        own = own if s is None else own.where(F.col("s").isin(s))
        out = [(own if o is None else own.where(F.col("o").isin(o))).select("s", "o", "o_kind")]
        out += [self.edges(q, s, o, path) for q in sorted(rules.sub_prop.get(p, ()))]
        for q in sorted(rules.inverse.get(p, set()) - {back}):
            turned = self.edges(q, o, s, path, p).where("o_kind = 'iri'")
            out.append(turned.select(F.col("o").alias("s"), F.col("s").alias("o"), "o_kind"))
        for p1, p2 in sorted(rules.chain.get(p, ())):
            left = self.edges(p1, s, None, path).where("o_kind = 'iri'").select("s", F.col("o").alias("y")).distinct()
            right = self.edges(p2, None, o, path).select(F.col("s").alias("y"), "o", "o_kind").distinct()
            out.append(left.join(right, "y").select("s", "o", "o_kind"))
        return self._union(out)

    def members(self, cls: str, path: tuple = ()) -> DataFrame:
        """s of the class."""
        if ("c", cls) in path:
            raise Recursive(cls)
        path, rules = (*path, ("c", cls)), self.rules
        out = [self.facts.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s")]
        out += [self.members(c, path) for c in sorted(rules.sub_class.get(cls, ()))]
        out += [self.edges(q, path=path).select("s") for q in sorted(rules.domain.get(cls, ()))]
        out += [self.edges(q, path=path).where("o_kind = 'iri'").select(F.col("o").alias("s")) for q in sorted(rules.range.get(cls, ()))]
        for q, filler in sorted(rules.some.get(cls, ())):
            held = self.members(filler, path).select(F.col("s").alias("o")).distinct()
            out.append(self.edges(q, path=path).join(held, "o", "left_semi").select("s"))
        for c, q in sorted(rules.every.get(cls, ())):
            given = self.edges(q, path=path).where("o_kind = 'iri'")
            out.append(given.join(self.members(c, path).distinct(), "s", "left_semi").select(F.col("o").alias("s")))
        return self._union(out)


def ask_edges(facts: DataFrame, rules: Rules, p: str, s: list[str] | None = None, o: list[str] | None = None) -> DataFrame:
    """s, p, o of all edges of a property that hold, asserted or not, bound to constants where given.

    The rules are unfolded backwards from the goal; where it needs itself or very many others, the slice that it needs is materialised.
    """
    try:
        if sum(map(len, needed(rules, [p]))) > UNFOLD:
            raise Recursive
        found = Unfolded(facts, rules).edges(p, s, o)
    except Recursive:
        found = materialise(*slice_of(facts, rules, [p])).where(F.col("p") == p)
        found = found if s is None else found.where(F.col("s").isin(s))
        found = found if o is None else found.where(F.col("o").isin(o))
    return found.select("s", F.lit(p).alias("p"), "o").distinct()


def ask_members(facts: DataFrame, rules: Rules, classes: Iterable[str]) -> DataFrame:
    """s, cls of all members of some classes, asserted or not."""
    classes = sorted(classes)
    try:
        if sum(map(len, needed(rules, (), classes))) > UNFOLD:
            raise Recursive
        unfolded = Unfolded(facts, rules)
        found = reduce(DataFrame.unionByName, [unfolded.members(c).select("s", F.lit(c).alias("cls")) for c in classes])
    except Recursive:
        found = materialise(*slice_of(facts, rules, (), classes)).where((F.col("p") == TYPE) & F.col("o").isin(classes)).select("s", F.col("o").alias("cls"))
    return found.distinct()
