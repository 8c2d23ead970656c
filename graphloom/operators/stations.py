"""Careers: stations from numbered keys of infoboxes or from memberships, their triples, notes and intervals over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import terms as T
from graphloom.functions import wikitext as X
from graphloom.operators.fusion import with_fallback
from graphloom.operators.records import fact, facts_of, link_iris
from graphloom.operators.views import lanes

STATION = ["entity", "idx", "kind", "team", "label", "start", "end", "apps", "goals", "loan"]


@dataclass(frozen=True)
class Family:
    """Keys of one kind of station, each before its number, and the class of its teams."""

    kind: str
    team: str
    years: str
    apps: str | None
    goals: str | None
    allow: str


CLUB, NATIONAL = "kg:ClubStation", "kg:NationalTeamStation"
# Keys of the families, in the order in which their stations are numbered.
FAMILIES = (
    Family("kg:YouthStation", "youthclubs", "youthyears", None, None, "kg:FootballClub"),
    Family(CLUB, "clubs", "years", "caps", "goals", "kg:FootballClub"),
    Family(NATIONAL, "nationalteam", "nationalyears", "nationalcaps", "nationalgoals", "kg:NationalTeam"),
)
# What stands before and after a team that a player is lent to.
LOAN_SIGN, LOAN_NOTES = "→", ("(mượn)", "(cho mượn)")
#: Words of notes: appearances, goals, on loan.
WORDS = ("trận", "bàn", "cho mượn")


def _lookup(pairs: dict[str, str | int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _plain(team: Column) -> Column:
    """The text of a rendered team without the marks of a loan."""
    t = F.trim(team)
    t = F.when(t.startswith(LOAN_SIGN), F.ltrim(F.substring(t, F.lit(len(LOAN_SIGN) + 1), F.length(t)))).otherwise(t)
    for note in LOAN_NOTES:
        t = F.when(F.lower(t).endswith(note), F.rtrim(F.left(t, F.length(t) - len(note)))).otherwise(t)
    return t


def box_stations(fields: DataFrame, targets: DataFrame, classes: DataFrame, namespace: str, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """STATION rows from infobox fields (entity, key, value): one per number of a family that has a team.

    Keys count in any case, with numbers of any size without leading zeros; of a key in several cases the largest
    value counts. The team is the first link to an allowed or unknown class that is no disambiguation page, its
    label the page's title; without one, the label is the text. targets is that of `link_iris`, by normalised
    titles; classes has iri, cls. Stations are numbered by family, then by number.
    """
    names = {name: (f.kind, field) for f in families for field in ("team", "years", "apps", "goals") if (name := getattr(f, field))}
    low = F.lower("key")
    stem, n = F.regexp_extract(low, r"^([^0-9]+)[1-9][0-9]*$", 1), F.regexp_extract(low, r"^[^0-9]+([1-9][0-9]*)$", 1).try_cast("long")
    rows = fields.where(stem.isin(list(names))).select("entity", "value", n.alias("n"), stem.alias("stem"))
    rows = rows.withColumn("kind", _lookup({k: v[0] for k, v in names.items()}, F.col("stem"))).withColumn("field", _lookup({k: v[1] for k, v in names.items()}, F.col("stem")))
    st = rows.groupBy("entity", "kind", "n").agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in ("team", "years", "apps", "goals")]).where("team is not null")
    rank = _lookup({f.kind: k for k, f in enumerate(families)}, F.col("kind"))
    st = st.withColumn("idx", F.row_number().over(Window.partitionBy("entity").orderBy(rank, "n")).cast("long"))

    st = st.select("*", F.posexplode_outer(X.links(F.col("team"))).alias("pos", "title"))
    apart = F.concat(F.lit("\u0000"), F.xxhash64("entity", "idx").cast("string"))  # stations without links are dealt evenly
    st = link_iris(st.withColumn("raw", F.coalesce("title", apart)), targets, namespace)
    st = st.withColumn("iri", F.when(F.col("title").isNotNull(), F.col("iri"))).withColumn("_iri", F.coalesce("iri", apart))
    st = st.join(classes.select(F.col("iri").alias("_iri"), "cls").hint("merge"), "_iri", "left").join(targets.select("raw", F.col("title").alias("page")).hint("merge"), "raw", "left")
    fits = F.col("iri").isNotNull() & (F.col("cls").isNull() | (F.col("cls") == _lookup({f.kind: f.allow for f in families}, F.col("kind"))))
    first = F.min(F.when(fits, F.struct("pos", "iri", T.norm_title(F.coalesce("page", "title")).alias("label")))).alias("first")
    st = st.groupBy("entity", "idx", "kind", "team", "years", "apps", "goals").agg(first)
    shown = F.struct(X.render(F.coalesce("years", F.lit(""))).alias("years"), *[X.render(F.col(c)).alias(c) for c in ("apps", "goals")], F.when(F.col("first").isNull(), X.render(F.col("team"))).alias("label"))
    st = st.select("entity", "idx", "kind", "first", F.col("team").alias("raw"), F.inline(F.array(shown)))  # a step of its own: each value is rendered once
    st = st.select("*", F.inline(F.array(T.year_range(F.col("years")))))
    return st.select(
        "entity", "idx", "kind", F.col("first.iri").alias("team"), F.coalesce("first.label", _plain(F.col("label"))).alias("label"), "start", "end",
        T.integer(F.col("apps")).alias("apps"), T.integer(F.col("goals")).alias("goals"), T.on_loan(F.col("raw")).alias("loan"),
    )


def member_stations(memberships: DataFrame, classes: DataFrame, taken: DataFrame, order: tuple[str, ...] = ("team", "end", "apps", "goals")) -> DataFrame:
    """STATION rows from memberships (entity, team, label, start, end, apps, goals; the last four as text) of entities without a club station in `taken`.

    Teams of a class that is neither a club's nor a national team's are left out, unknown ones are clubs. Numbers go
    on after those taken, by start (none first), then by the columns `order` (which memberships may have beside those
    named): text would put Club 10 before Club 9.
    """
    have = taken.groupBy("entity").agg(F.max("idx").alias("last"), F.bool_or(F.col("kind") == CLUB).alias("club"))
    m = memberships.join(classes.select(F.col("iri").alias("team"), "cls").hint("merge"), "team", "left").where("cls is null or cls in ('kg:FootballClub', 'kg:NationalTeam')")
    m = m.join(have.hint("merge"), "entity", "left").where("not coalesce(club, false)")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.coalesce("start", F.lit("")), *order))
    kind, number = F.when(F.col("cls") == "kg:NationalTeam", NATIONAL).otherwise(CLUB), lambda c: F.col(c).try_cast("double").cast("long").alias(c)
    return m.withColumn("idx", F.coalesce("last", F.lit(0)) + place).select(
        "entity", "idx", kind.alias("kind"), "team", F.coalesce("label", F.lit("")).alias("label"), T.leading_year(F.col("start")).alias("start"), T.leading_year(F.col("end")).alias("end"), number("apps"), number("goals"), F.lit(False).alias("loan")
    )


def _span(start: Column, end: Column) -> Column:
    return F.concat(F.coalesce(start.cast("string"), F.lit("?")), F.lit("–"), F.coalesce(end.cast("string"), F.lit("")))


def station_triples(stations: DataFrame, titles: DataFrame, lang: str = "vi") -> DataFrame:
    """s, p, o, o_kind, dt, lang of STATION rows: the player's link, type, label, team, years, appearances, goals and loan. titles has entity, title."""
    at = F.concat("entity", F.lit("__"), F.col("idx").cast("string"))
    st = stations.join(titles.select("entity", "title").hint("merge"), "entity").withColumn("player", F.col("entity")).withColumn("entity", at)
    label = F.concat(T.norm_title(F.col("title")), F.lit(" – "), "label", F.lit(" ("), _span(F.col("start"), F.col("end")), F.lit(")"))
    count = "xsd:nonNegativeInteger"
    own = facts_of(
        st,
        [
            fact("rdf:type", F.col("kind"), "iri"), fact("rdfs:label", label, lang=lang), fact("kg:team", F.col("team"), "iri"), fact("kg:startYear", F.col("start"), dt="xsd:gYear"), fact("kg:endYear", F.col("end"), dt="xsd:gYear"),
            fact("kg:appearances", F.col("apps"), dt=count), fact("kg:goals", F.col("goals"), dt=count), fact("kg:onLoan", F.when(F.col("loan"), "true"), dt="xsd:boolean"),
        ],
    )
    none = F.lit(None).cast("string")
    return own.unionByName(st.select(F.col("player").alias("s"), F.lit("kg:careerStation").alias("p"), F.col("entity").alias("o"), F.lit("iri").alias("o_kind"), none.alias("dt"), none.alias("lang")))


def current_clubs(stations: DataFrame, given: DataFrame) -> DataFrame:
    """entity, club: the clubs given (entity, club), else the team of the last club station that has a team and a start and no end."""
    open_ = stations.where((F.col("kind") == CLUB) & F.col("team").isNotNull() & F.col("start").isNotNull() & F.col("end").isNull())
    return with_fallback(given.select("entity", "club").distinct(), open_.groupBy("entity").agg(F.max_by("team", "idx").alias("club")), ["entity"])


def notes(stations: DataFrame, kinds: dict[str, str], words: tuple[str, str, str] = WORDS) -> DataFrame:
    """entity, idx, note: years, appearances with goals, loan and the kind's name, as far as they are known."""
    apps, goals, loan = words
    years = F.when(F.col("start").isNotNull() | F.col("end").isNotNull(), _span(F.col("start"), F.col("end")))
    games = F.concat(F.col("apps").cast("string"), F.lit(f" {apps}"), F.coalesce(F.concat(F.lit(", "), F.col("goals").cast("string"), F.lit(f" {goals}")), F.lit("")))
    return stations.select("entity", "idx", F.concat_ws(" · ", years, games, F.when(F.col("loan"), loan), _lookup(kinds, F.col("kind"))).alias("note"))


def timeline(stations: DataFrame, now: int) -> DataFrame:
    """entity, kind, idx, start, until, open, lane, beside of the stations with a start: until is the year after the last one, that after `now` of open ones."""
    until = F.greatest(F.coalesce("end", F.lit(now)) + 1, F.col("start") + 1)
    st = stations.where("start is not null").select("entity", "kind", "idx", "start", until.alias("until"), F.col("end").isNull().alias("open"))
    placed = lanes(st.select("entity", "kind", F.col("idx").alias("id"), "start", F.col("until").alias("end")), ["entity", "kind"])
    return st.join(placed.withColumnRenamed("id", "idx").hint("merge"), ["entity", "kind", "idx"])


def spans(stations: DataFrame, now: int) -> DataFrame:
    """entity, first, last: the years that an entity's stations with a start cover; open ones last until `now`."""
    return stations.where("start is not null").groupBy("entity").agg(F.min("start").alias("first"), F.max(F.coalesce("end", F.lit(now))).alias("last"))
