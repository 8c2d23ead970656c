"""Personal data by patterns, extended by bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Starts are held to where a leftmost match can begin, and repeats are possessive, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
#: Tokens that patterns may discover: at least six characters with a digit or @.
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])[^\s]{6,}+"
#: Code points of context on either side.
CONTEXT = 48
#: Rounds of scoring between two additions of seeds; distinct seed entities that a pattern needs; confidence from which a pattern or an instance counts as found.
ROUNDS, SUPPORT, FOUND = 3, 3, 0.6


def _matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    found = F.aggregate(
        F.arrays_zip(hits.alias("value"), F.slice(between, 1, F.size(hits)).alias("gap")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.length(m["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    ok = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(ok, found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        - F.when((i % 2 == 0) & (F.substring(digits, -i, F.lit(1)).cast("int") > 4), 9).otherwise(0),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.concat(F.lit("0"), F.substring(short(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda m: _valid(kind, m["value"])


def _numbered(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the base patterns, by start and then kind; kind is its place in KINDS."""
    per = []
    for k, kind in enumerate(KINDS):
        guard = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else None
        hits = F.filter(_matches(text, PATTERNS[kind], guard), _checker(kind))
        per.append(F.transform(hits, _numbered(k)))
    return F.array_sort(F.concat(*per))


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _lexical(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns of a place: two words before it; the word before it and the word after it."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[0-9]", "0"))
    left = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    right = F.substring(text, end + 1, F.lit(CONTEXT))
    near = plain(F.regexp_extract(left, r"(\S+)\s*$", 1))
    two = plain(F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1))
    after = plain(F.regexp_extract(right, r"^\S*\s*(\S+)", 1))
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.regexp_replace(two, r"\s+", " "), F.lit(" *"))),
            F.when((near != "") & (after != ""), F.concat(near, F.lit(" * "), after)),
        ),
        lambda p: p.isNotNull(),
    )


def _scored(edges: DataFrame, width: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Patterns (pattern, kind, confidence) and unseen instances (instance, kind, score) after ROUNDS of scoring each other; None without a pattern of enough seeds."""
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("weight").alias("mass"))
    usable = written(seeds.where(F.col("seeds") >= SUPPORT).join(width.hint("merge"), "pattern"), "usable")
    if usable.isEmpty():
        return None
    open_ = written(edges.where("kind is null").select("pattern", "instance").join(usable.select("pattern").distinct().hint("merge"), "pattern", "left_semi"), "open")
    patterns = usable.withColumn("gained", F.lit(0.0))
    for _ in range(ROUNDS):
        confident = written(patterns.select("pattern", "kind", ((F.col("mass") + F.col("gained")) / (F.col("n") + 1)).alias("confidence")), "patterns")
        scores = (
            open_.join(confident.hint("merge"), "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            .groupBy("instance")
            .agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
            .select("instance", (-F.col("best.col2")).alias("kind"), "best.score")
        )
        scores = written(scores, "scores")
        gained = open_.join(scores.hint("merge"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        patterns = usable.join(gained.hint("merge"), ["pattern", "kind"], "left").withColumn("gained", F.coalesce("gained", F.lit(0.0)))
    return confident, scores


def discover(mentions: DataFrame) -> DataFrame:
    """Mentions that high-confidence patterns find: row, start, end, kind.

    mentions has row, start, end, kind (null if no base pattern matches), instance, patterns. In each
    round a pattern's confidence for a kind is the sum of its instances' scores over their number plus
    one, and an unseen instance's score the noisy-or of its patterns' confidences, for its best kind; seeds
    stay at 1. Patterns with fewer than SUPPORT distinct seeds of the kind do not count. Instances of high
    score that patterns of high confidence meet become seeds, with their scores for weights, and induce
    patterns of their own: scoring starts anew until no instance is added.
    """
    edges = written(mentions.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    edges = edges.withColumn("weight", F.lit(1.0))
    width = written(edges.groupBy("pattern").agg(F.count("*").alias("n")), "width")
    sure = found = None
    now = edges
    while scored := _scored(now, width):
        confident, scores = scored
        confident = confident.where(F.col("confidence") >= FOUND).select("pattern", "kind")
        sure = confident if sure is None else written(sure.union(confident).distinct(), "sure")
        met = now.where("kind is null").select("pattern", "instance").join(confident.hint("merge"), "pattern").select("instance", "kind").distinct()
        fresh = written(scores.where(F.col("score") >= FOUND).join(met.hint("merge"), ["instance", "kind"], "left_semi").select("instance", "kind", "score"), "fresh")
        if fresh.isEmpty():
            break
        found = fresh if found is None else written(found.union(fresh), "found")
        made = found.select("instance", F.col("kind").alias("made"), "score")
        weight = F.when(F.col("kind").isNull() & F.col("made").isNotNull(), F.col("score")).otherwise(F.col("weight"))
        now = written(edges.join(made.hint("merge"), "instance", "left").select("pattern", "instance", F.coalesce("kind", "made").alias("kind"), weight.alias("weight")), "grown")
    plain = mentions.where("kind is null").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    if found is None:
        return plain.where("false").select("row", "start", "end", F.lit(0).alias("kind"))
    return (
        plain.join(sure.hint("merge"), "pattern")
        .join(found.select("instance", "kind").hint("merge"), ["instance", "kind"], "left_semi")
        .select("row", "start", "end", "kind")
        .distinct()
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in every text.

    The base patterns give seed entities. Words around them become lexical patterns; patterns and the
    instances they meet (seeds and other identifier-like tokens) score each other over the whole corpus
    (discover), and what patterns of high confidence find is added under the seeds' kind.

    Returns one row per input row: id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans
    (base and found), n_found. Null text counts as empty: no spans, the digest of the empty string. Repeated
    rows give equal results; an empty table gives an empty result; other columns are ignored.
    """
    text, base = F.col("text"), F.col("base")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(text)).withColumn("tokens", _matches(text, CANDIDATE))
    free = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    bare = F.transform(free, lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(F.regexp_replace(t["value"], r"[^\p{L}\p{N})\]]+$", ""))).alias("end"), t["value"].alias("value")))
    seed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lower(b["value"]).alias("instance"), _lexical(text, b["start"], b["end"]).alias("patterns")))
    other = F.transform(
        F.filter(bare, lambda t: t["end"] - t["start"] >= 6),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(None).cast("int").alias("kind"), F.lower(F.substring(t["value"], F.lit(1), t["end"] - t["start"])).alias("instance"), _lexical(text, t["start"], t["end"]).alias("patterns")),
    )
    rows = written(
        rows.select("id", F.transform("base", lambda b: b.dropFields("value")).alias("base"), F.concat(seed, other).alias("mentions")).withColumn("row", F.monotonically_increasing_id()),
        "mentions",
    )
    found = discover(rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*"))
    found = written(found.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found")), "found")
    out = rows.select("id", "row", "base").join(found.hint("merge"), "row", "left")
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<start: int, kind: int, end: int>>"))))
    return out.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"),
    )
