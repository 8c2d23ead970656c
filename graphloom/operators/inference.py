"""Materialising ontology inferences to a fixpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.closure import held, shared_path

TYPE = "rdf:type"
FACT = ["s", "p", "o", "o_kind"]
#: Given facts for each part of a round, so that parts stay small enough to sort and group in memory.
A_PART = 500_000
#: Axiom kinds that reasoning leaves out; functional properties are checked instead.
SKIPPED = ("functional", "inverse_functional", "cardinality", "same_as")


@dataclass
class Ontology:
    """The axioms as small tables."""

    sub_class: DataFrame
    sub_prop: DataFrame
    prop: DataFrame
    inverse: DataFrame
    chain: DataFrame
    some_values: DataFrame
    all_values: DataFrame
    disjoint: DataFrame


def small(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A schema-sized table as a local relation: reading it takes no job. fields: name and string, int or boolean, comma-separated."""
    names, kinds = zip(*(f.strip().split(" ") for f in fields.split(",")), strict=True)
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [pa.array([r[k] for r in rows], types[kind]) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True))))


def example_ontology(spark: SparkSession) -> Ontology:
    """An ontology of one axiom of each kind for the derived graph."""
    make = lambda rows, fields: small(spark, rows, fields)
    return Ontology(
        make([("kg:FootballPlayer", "kg:Athlete"), ("kg:Athlete", "kg:Person"), ("kg:Person", "up:Agent"), ("kg:NationalTeamPlayer", "kg:FootballPlayer"),
              ("kg:FootballClub", "kg:Team"), ("kg:NationalTeam", "kg:Team"), ("kg:Team", "up:Agent"), ("kg:FormerProvince", "kg:Province"), ("kg:Province", "kg:Place"),
              ("kg:Country", "kg:Place"), ("kg:Stadium", "kg:Place"), ("kg:ClubStation", "kg:CareerStation"), ("kg:YouthStation", "kg:CareerStation"),
              ("kg:NationalTeamStation", "kg:CareerStation")], "sub string, sup string"),
        make([("kg:birthProvince", "kg:birthPlace"), ("kg:province", "kg:locatedIn")], "sub string, sup string"),
        make([("kg:birthProvince", "object", "kg:Person", "kg:Province", True), ("kg:birthPlace", "object", "kg:Person", "kg:Place", False),
              ("kg:careerStation", "object", "kg:Athlete", "kg:CareerStation", False), ("kg:team", "object", "kg:CareerStation", "kg:Team", False),
              ("kg:ground", "object", "kg:Team", "kg:Stadium", False), ("kg:capacity", "datatype", "kg:Stadium", "xsd:integer", True),
              ("kg:successor", "object", "kg:Province", "kg:Province", False), ("kg:predecessor", "object", None, None, False),
              ("kg:province", "object", None, "kg:Province", False), ("kg:locatedIn", "object", None, "kg:Place", False),
              ("kg:playedFor", "object", "kg:Athlete", "kg:Team", False), ("kg:hasPlayer", "object", None, None, False),
              ("kg:startYear", "datatype", "kg:CareerStation", "xsd:gYear", True)],
             "p string, kind string, domain string, range string, functional boolean"),
        make([("kg:playedFor", "kg:hasPlayer"), ("kg:successor", "kg:predecessor")], "p string, q string"),
        make([("kg:playedFor", "kg:careerStation", "kg:team")], "p string, p1 string, p2 string"),
        make([("kg:careerStation", "kg:NationalTeamStation", "kg:NationalTeamPlayer")], "p string, filler string, cls string"),
        make([("kg:ClubStation", "kg:team", "kg:FootballClub"), ("kg:NationalTeamStation", "kg:team", "kg:NationalTeam")], "cls string, p string, filler string"),
        make([(1, "kg:Person"), (1, "kg:Team"), (1, "kg:Place"), (2, "kg:FootballClub"), (2, "kg:NationalTeam")], "grp int, cls string"),
    )


def skeleton(triples: DataFrame, own: str, once: bool = True) -> DataFrame:
    """What enters reasoning: types and own properties of own subjects; each once, unless fixpoint() does that."""
    rows = triples.where(F.col("s").startswith(own) & ((F.col("p") == TYPE) | F.col("p").startswith(own))).select(*FACT)
    return rows.distinct() if once else rows


def _tag(*frames: DataFrame) -> list[str]:
    """The column id if all frames have it: facts of different proposals are kept apart."""
    return ["id"] if all("id" in df.columns for df in frames) else []


def _types(df: DataFrame, s: str, cls: str) -> DataFrame:
    return df.select(*_tag(df), F.col(s).alias("s"), F.lit(TYPE).alias("p"), F.col(cls).alias("o"), F.lit("iri").alias("o_kind"))


def rule_sub_class(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """x a C, C below D: x a D. classes is the closure (sub, sup)."""
    return _types(facts.where(F.col("p") == TYPE).join(F.broadcast(classes), F.col("o") == F.col("sub")), "s", "sup")


def rule_sub_property(facts: DataFrame, props: DataFrame) -> DataFrame:
    """x p y, p below q: x q y, literals too. props is the closure (sub, sup)."""
    return facts.join(F.broadcast(props), F.col("p") == F.col("sub")).select(*_tag(facts), "s", F.col("sup").alias("p"), "o", "o_kind")


def rule_domain(facts: DataFrame, prop: DataFrame) -> DataFrame:
    """x p y: x a domain of p."""
    return _types(facts.join(F.broadcast(prop.where("domain is not null").select("p", "domain")), "p"), "s", "domain")


def rule_range(facts: DataFrame, prop: DataFrame) -> DataFrame:
    """x p y, y an IRI: y a range of p."""
    return _types(facts.where("o_kind = 'iri'").join(F.broadcast(prop.where("range is not null and kind = 'object'").select("p", "range")), "p"), "o", "range")


def rule_inverse(facts: DataFrame, inverse: DataFrame) -> DataFrame:
    """x p y: y q x, both ways."""
    both = inverse.select("p", "q").union(inverse.select("q", "p"))
    return facts.where("o_kind = 'iri'").join(F.broadcast(both), "p").select(*_tag(facts), F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), "o_kind")


def _meet(a: DataFrame, b: DataFrame, keys: list[str], how: tuple[str | None, str | None]) -> DataFrame:
    """a joined to b; how has a join hint for either, or None."""
    a, b = (df.hint(h) if h else df for df, h in zip((a, b), how, strict=True))
    return a.join(b, keys)


def rule_chain(left: DataFrame, right: DataFrame, chain: DataFrame, how: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """x p1 y, y p2 z: x p z. In this rule and the next two, an id of either side stays; where both have one, they must agree. how has join hints for the two sides."""
    axioms = chain.select(F.col("p").alias("q"), F.col("p1"), "p2")
    a = left.where("o_kind = 'iri'").join(F.broadcast(axioms), F.col("p") == F.col("p1")).select(*_tag(left), "s", F.col("o").alias("y"), "p2", "q")
    b = right.select(*_tag(right), F.col("s").alias("y"), F.col("p").alias("p2"), "o", "o_kind")
    return _meet(a, b, [*_tag(left, right), "y", "p2"], how).select(*(_tag(left) or _tag(right)), "s", F.col("q").alias("p"), "o", "o_kind")


def rule_some_values(edges: DataFrame, types: DataFrame, some: DataFrame, how: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """x p y, y a filler: x a class."""
    a = edges.join(F.broadcast(some), "p").select(*_tag(edges), "s", F.col("o").alias("y"), "filler", "cls")
    b = types.where(F.col("p") == TYPE).select(*_tag(types), F.col("s").alias("y"), F.col("o").alias("filler"))
    return _types(_meet(a, b, [*_tag(edges, types), "y", "filler"], how), "s", "cls")


def rule_all_values(types: DataFrame, edges: DataFrame, every: DataFrame, how: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """x a class, x p y: y a filler. The axioms go to the types, so that an edge meets them once, whatever the number of axioms."""
    a = types.where(F.col("p") == TYPE).select(*_tag(types), "s", F.col("o").alias("cls")).join(F.broadcast(every), "cls").select(*_tag(types), "s", "p", "filler")
    b = edges.where("o_kind = 'iri'").select(*_tag(edges), "s", "p", "o")
    return _types(_meet(a, b, [*_tag(types, edges), "s", "p"], how), "o", "filler")


def schema_closure(edges: DataFrame) -> DataFrame:
    """sub, sup of every pair that the edges (sub, sup) of an ontology connect, but for a term with itself. The axioms are schema-sized: they come to the driver as they are broadcast to every task anyway."""
    up: dict[str, set[str]] = {}
    for r in edges.select("sub", "sup").distinct().collect():
        up.setdefault(r.sub, set()).add(r.sup)
    pairs = []
    for start in up:
        seen, todo = set(), [start]
        while todo:
            fresh = up.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        pairs += [(start, x) for x in sorted(seen - {start})]
    return small(edges.sparkSession, pairs, "sub string, sup string")


@contextmanager
def parted(spark: SparkSession, parts: int) -> Iterator[None]:
    """Shuffles of what is run inside have so many parts at least as the session has, and adaptive execution joins small ones only: large ones would be sorted and grouped on disk."""
    names = {"spark.sql.shuffle.partitions": str(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts_of(df: DataFrame, more: int = 0) -> int:
    """Parts of about A_PART rows (with so many more than df has), as many as shuffles have at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (df.count() + more) // A_PART)


class Known:
    """The facts found so far, in one table by round, predicate and kind (k: the class, of types whose class the axioms name).

    What a round finds is combined in its tasks and shuffled once. It meets only known facts of the predicates and
    classes that the rules of the round conclude (`heads`; None: any); where there are none, nothing is compared.
    Given facts of predicates that no rule concludes cannot be found again: they are written as they come, without a
    shuffle. A predicate that is known as the inverse of one concluded predicate only (`mirrors`) is not written
    either: it is read from that one.
    """

    def __init__(self, spark: SparkSession, classes: Iterable[str] = ()):
        self.spark, self.classes, self.parts = spark, sorted(classes), 0
        self.table, self.rounds = f"facts_{uuid.uuid4().hex}", 0
        self.path = shared_path(spark, "facts")
        self.predicates: set[str] = set()
        self.named: set[str] = set()
        self.fresh: set[str] = set()
        self.heads: tuple[set[str], set[str] | None] | None = None
        self.mirrors: dict[str, str] = {}
        self.turned: list[tuple[int, DataFrame]] = []
        self.given: DataFrame | None = None

    def give(self, facts: DataFrame, heads: set[str]) -> set[str]:
        """Keep the given facts as round 0; heads are the predicates that rules conclude. The predicates of the facts."""
        headed = F.col("p").isin(sorted(heads))
        self.given = held(facts.select(*FACT).where(~headed), "given", "zstd")
        self.parts = self.given.count() // A_PART
        self.predicates = {r.p for r in self.given.select("p").distinct().collect()}
        return self.predicates | self.add(facts.where(headed))

    def add(self, found: DataFrame) -> set[str]:
        """Keep what is new of found, as one more round; the predicates of the new facts. Their classes that the axioms name are in `fresh`."""
        predicates, classes = self.heads or (self.predicates, None)
        old, found = self.predicates & predicates, found.select(*FACT)
        if self.rounds and (old - {TYPE} or TYPE in old and (classes is None or self.named & classes)):
            known = self._found(0, self.rounds).where(F.col("p").isin(sorted(old)))
            known = known if classes is None else known.where((F.col("p") != TYPE) | F.col("k").isin(sorted(classes)))
            marked = found.withColumn("known", F.lit(0)).unionByName(known.select(*FACT, F.lit(1).alias("known")))
            fresh = marked.groupBy(*FACT).agg(F.max("known").alias("known")).where("known = 0").select(*FACT)
        else:
            fresh = found.distinct()
        kind = F.when((F.col("p") == TYPE) & F.col("o").isin(self.classes), F.col("o"))
        rows = fresh.select("s", "o", "o_kind", F.lit(self.rounds).alias("round"), "p", kind.alias("k"))
        with parted(self.spark, self.parts):
            rows.write.mode("append").format("parquet").option("compression", "zstd").partitionBy("round", "p", "k").option("path", self.path).saveAsTable(self.table)
        written = [r.partition.split("/") for r in self.spark.sql(f"show partitions {self.table}").collect()]
        here = [(unquote(p.removeprefix("p=")), unquote(k.removeprefix("k="))) for n, p, k in written if n == f"round={self.rounds}"]
        new = {p for p, _ in here}
        turns = [(p, q) for q, p in self.mirrors.items() if p in new]
        if turns:
            facts = self._found(self.rounds, self.rounds).where(F.col("p").isin([p for p, _ in turns])).select(*FACT)
            self.turned.append((self.rounds, rule_inverse(facts, small(self.spark, turns, "p string, q string")).select(*FACT)))
            new |= {q for _, q in turns}
        self.rounds += 1
        self.fresh = {k for p, k in here if p == TYPE} & set(self.classes)
        self.predicates, self.named = self.predicates | new, self.named | self.fresh
        return new

    def _found(self, first: int, last: int) -> DataFrame:
        return self.spark.table(self.table).where(F.col("round").between(first, last))

    def written(self) -> int:
        """Facts of the rounds after the given ones, those read from their inverse left out."""
        return self._found(1, self.rounds).count()

    def facts(self, first: int = 0, last: int | None = None, predicates: Iterable[str] | None = None, mirrored: bool = True) -> DataFrame:
        """FACT of the rounds from first to last, of some predicates only if given, without those read from their inverse if not `mirrored`. Given facts of other predicates than those concluded are repeated as they came."""
        last = self.rounds if last is None else last
        df = self._found(first, last).select(*FACT)
        df = df.unionByName(self.given) if first == 0 and self.given is not None else df
        df = reduce(DataFrame.unionByName, [rows for n, rows in self.turned if mirrored and first <= n <= last], df)
        return df if predicates is None else df.where(F.col("p").isin(sorted(predicates)))


def fixpoint(facts: DataFrame, tbox: Ontology, semantics: str = "owl") -> Known:
    """Apply the rules to what the last round found, until nothing is new; round 0 holds the given facts.

    An axiom is applied only if the last round has a predicate or class that it starts from, and reads no others.
    semantics: owl, rdfs (no inverse, chain or restriction) or none.
    """
    rows = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.collect()]  # noqa: E731  axioms, schema-sized
    classes, props = schema_closure(tbox.sub_class), schema_closure(tbox.sub_prop)
    sub_class, sub_prop = rows(classes, "sub", "sup"), rows(props, "sub", "sup")
    domain, range_ = rows(tbox.prop.where("domain is not null"), "p", "domain"), rows(tbox.prop.where("range is not null and kind = 'object'"), "p", "range")
    inverse, chain = rows(tbox.inverse, "p", "q"), rows(tbox.chain, "p", "p1", "p2")
    some, every = rows(tbox.some_values, "p", "filler", "cls"), rows(tbox.all_values, "cls", "p", "filler")
    named = {c for pair in sub_class for c in pair} | {c for _, c in domain + range_} | {c for _, *cs in some for c in cs} | {c for a, _, b in every for c in (a, b)}
    known = Known(facts.sparkSession, named)
    if semantics == "none":
        known.give(facts, set())
        return known
    others = {TYPE} | {q for _, q in sub_prop} | {p for p, _, _ in chain}  # concluded by other rules than the inverse
    pairs = {x for p, q in inverse for x in ((p, q), (q, p))} if semantics == "owl" else set()
    new, first = known.give(facts, others | {p for pair in inverse for p in pair}), True
    given, fresh = known.predicates, known.fresh
    # what is only known as the inverse of one other predicate leads back to facts that are there
    only = {q: p for p, q in pairs if q not in others | given and p != q and sum(b == q for _, b in pairs) == 1}
    known.mirrors = {q: p for q, p in only.items() if p in others - given}  # facts of p are told apart, so these are
    pairs -= {(q, p) for q, p in only.items()} | {(p, q) for q, p in known.mirrors.items()}
    turns = small(facts.sparkSession, sorted(pairs), "p string, q string")
    while new:
        last = known.rounds - 1
        delta = lambda want: known.facts(last, last, want)  # noqa: E731,B023
        whole = lambda want: known.facts(0, None, want)
        of = lambda df, want: df.where(F.col("o").isin(sorted(want)))
        found, predicates, types = [], set(), set()
        for rule, pairs_, axioms in ((rule_sub_property, sub_prop, props), (rule_inverse, sorted(pairs), turns)):
            if use := {p for p, _ in pairs_} & new:
                found.append(rule(delta(use), axioms))
                predicates |= {q for p, q in pairs_ if p in use}
        if use := {c for c, _ in sub_class} & fresh:
            found.append(rule_sub_class(of(delta([TYPE]), use), classes))
            types |= {d for c, d in sub_class if c in use}
        for rule, pairs_ in ((rule_domain, domain), (rule_range, range_)):
            if use := {p for p, _ in pairs_} & new:
                found.append(rule(delta(use), tbox.prop))
                types |= {c for p, c in pairs_ if p in use}
        for turn in (0, 1) if semantics == "owl" else ():  # which premise is new; in the first round both are
            if turn and first:
                break
            one, two = (delta, whole) if turn == 0 else (whole, delta)
            (p_one, c_one), (p_two, c_two) = ((new, fresh), (known.predicates, known.named))[:: -1 if turn else 1]
            if use := [x for x in chain if x[1] in p_one and x[2] in p_two]:
                found.append(rule_chain(one({x[1] for x in use}), two({x[2] for x in use}), tbox.chain, ("merge", "merge")))
                predicates |= {x[0] for x in use}
            if use := [x for x in some if x[0] in p_one and x[1] in c_two]:
                found.append(rule_some_values(one({x[0] for x in use}), of(two([TYPE]), {x[1] for x in use}), tbox.some_values, ("merge", "merge")))
                types |= {x[2] for x in use}
            if use := [x for x in every if x[0] in c_one and x[1] in p_two]:
                found.append(rule_all_values(of(one([TYPE]), {x[0] for x in use}), two({x[1] for x in use}), tbox.all_values, ("merge", "merge")))
                types |= {x[2] for x in use}
        if not found:
            break
        known.heads = predicates | ({TYPE} if types else set()), None if TYPE in predicates else types
        new, first = known.add(reduce(DataFrame.unionByName, found)), False
        fresh = known.fresh
    return known


def materialise(facts: DataFrame, tbox: Ontology, semantics: str = "owl") -> DataFrame:
    """All facts that follow (with the given ones), s, p, o, o_kind; see fixpoint()."""
    return fixpoint(facts, tbox, semantics).facts().distinct()


#: Namespaces of the properties of useful facts.
KEPT = ("kg:", "up:", "geo:")


def inferred(facts: DataFrame, tbox: Ontology, terms: DataFrame | None = None, keep: tuple[str, ...] = KEPT, semantics: str = "owl") -> DataFrame:
    """New and useful facts only: not asserted, subject no ontology term or blank node, no same-as, properties of the kept namespaces."""
    return useful(fixpoint(facts, tbox, semantics), terms, keep)


def _useful(p: Column, s: Column, o: Column, keep: tuple[str, ...]) -> Column:
    ok = (p == TYPE) | reduce(lambda a, b: a | b, [p.startswith(k) for k in keep])
    return ok & (p != "owl:sameAs") & ~s.startswith("_:") & ~((p == TYPE) & o.isin("owl:Thing", "rdfs:Resource"))


def useful(known: Known, terms: DataFrame | None = None, keep: tuple[str, ...] = KEPT) -> DataFrame:
    """The useful ones of the facts that a fixpoint has found; see inferred()."""
    if known.rounds < 2:
        return known.facts().limit(0)
    new = known.facts(1).where(_useful(F.col("p"), F.col("s"), F.col("o"), keep))
    return new if terms is None else new.join(terms.select(F.col("term").alias("s")), "s", "left_anti")


def useful_once(known: Known, keep: tuple[str, ...] = KEPT) -> DataFrame:
    """FACT and names: the useful facts that a fixpoint has found, with a fact and its mirrored inverse as one row.

    names has p and turned for each fact that the row stands for: s p o, or o p s if it is turned.
    """
    if known.rounds < 2:
        new = known.facts().limit(0)
    else:
        new = known.facts(1, mirrored=False)
    p, s, o = F.col("p"), F.col("s"), F.col("o")
    name = lambda p, turned: F.struct(p.alias("p"), F.lit(turned).alias("turned"))
    names = [F.when(_useful(p, s, o, keep), name(p, False))]
    names += [F.when((p == of) & (F.col("o_kind") == "iri") & _useful(F.lit(q), o, s, keep), name(F.lit(q), True)) for q, of in sorted(known.mirrors.items())]
    return new.withColumn("names", F.filter(F.array(*names), lambda x: x.isNotNull())).where(F.size("names") > 0)


def disjointness(facts: DataFrame, disjoint: DataFrame) -> DataFrame:
    """s, a, b: subjects in two classes of one disjoint group, a before b."""
    types = facts.where(F.col("p") == TYPE).join(F.broadcast(disjoint), F.col("o") == F.col("cls")).select("s", "grp", "cls").distinct()
    x, y = types.alias("x"), types.alias("y")
    return x.join(y, ["s", "grp"]).where("x.cls < y.cls").select("s", F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
