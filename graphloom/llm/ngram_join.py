"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import components, release, sized_join, small_batches, written
from graphloom.llm.exact_dedup import tree_merge
from graphloom.llm.shingles import distinct, mix, shingle_sets, slices

#: A size band ends at so many times its start.
BAND = 1.6
#: Documents of a leaf, tokens of a leaf (a document with more has one of its own), and nodes below an inner node.
LEAF, TOKENS, FAN = 128, 1 << 15, 32
#: Documents from which on a signature is a home before rarer ones, so that crowds fill whole leaves.
CROWD = 16
#: Words of a node's bitmap (64 bits each).
MAP = 16
#: Signatures (one long each) up to which those that occur repeatedly are broadcast to drop the others.
SIGNATURES = 2_000_000


class Bands:
    """Size bands, and how many segments a set is cut into in each.

    Sets of sizes n <= m that link differ in at most (n + m) (den - num) / (den + num) elements. Cut into
    segments by hash, alike for both, at most so many segments differ; so if each set keeps, in one fixed
    order, one segment more than that, both keep a common one.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        self.cuts: dict[int, int] = {}

    def differ(self, n: int, m: int) -> int:
        """Most elements in which linked sets of these sizes differ."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        """Segments of a band: as few as hardly ever leave too many empty."""
        if band not in self.cuts:
            high = self.edges[band + 1] - 1
            need, k = self.differ(high, high) + 1, self.differ(high, high) + 1
            while True:
                empty = k * math.exp(-high / k)
                if k - empty - 3 * math.sqrt(empty) >= need or k > 4 * high + 64:
                    break
                k += max(1, k // 64)
            self.cuts[band] = k
        return self.cuts[band]

    def of(self, n: int) -> Iterator[tuple[int, int]]:
        """(band, most differences) for each band of sets not smaller that a set of size n can link with."""
        band = int(np.searchsorted(self.edges, n, "right")) - 1
        largest = n * self.den // self.num
        while self.edges[band] <= largest:
            yield band, self.differ(n, min(self.edges[band + 1] - 1, largest))
            band += 1


def signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a set: in each band the segments that it keeps, each hashed with its place.

    In a band where sets have no more segments than they may differ in, they keep all of them and one
    common signature besides. Sets that link only if they are equal have none.
    """
    out = []
    for band, most in bands.of(len(tokens)):
        if not most:
            continue
        k = bands.segments(band)
        at = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(tokens, starts)
            signed = np.sort(mix(sums ^ (at[starts] * np.uint64(1000003) + np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15))))
        out.append(signed[: most + 1])
        if len(signed) <= most:
            out.append(mix(np.array([band], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _features(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id, size, digest (of the set), sigs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch, texts in slices(batches, 1):
            sets = shingle_sets(texts, n)
            signed = [signatures(s, bands) if len(s) else s for s in sets]
            flat = np.concatenate(signed).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in signed])].astype(np.int32)), pa.array(flat))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists], names=["id", "size", "digest", "sigs"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, size long, digest binary, sigs array<long>")


def table(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of some sets, and a matrix of which set has which: near copies take little room."""
    values = distinct(np.concatenate(sets))
    has = np.zeros((len(sets), len(values)), bool)
    for k, s in enumerate(sets):
        has[k, np.searchsorted(values, s)] = True
    return values, has


def bitmaps(values: np.ndarray, has: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (a power of two of bits) of each set of a table."""
    bits = np.zeros((len(has), width), bool)
    row, column = np.nonzero(has)
    bits[row, (values & np.uint64(width - 1)).astype(np.int64)[column]] = True
    return bits


def plausible(num: int, den: int, nx: np.ndarray, bits_x: np.ndarray, ny: np.ndarray, bits_y: np.ndarray) -> np.ndarray:
    """Which pairs of sets may link by their sizes and the largest overlap that their bitmaps leave room for."""
    width = min(bits_x.shape[1], bits_y.shape[1])
    bits_x, bits_y = (b.reshape(len(b), -1, width).any(axis=1) for b in (bits_x, bits_y))
    common = (bits_x.astype(np.float32) @ bits_y.T.astype(np.float32)).astype(np.int64)
    n, m = nx[:, None], ny[None, :]
    most = np.minimum(n - bits_x.sum(axis=1)[:, None], m - bits_y.sum(axis=1)[None, :]) + common
    return most * (den + num) >= num * (n + m)


def overlaps(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of one table with those of another."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    hit = x[at] == y
    return (has_x[:, at[hit]].astype(np.float32) @ has_y[:, hit].T.astype(np.float32)).astype(np.int64)


def joined(link: np.ndarray, xs: list, ys: list) -> list[tuple]:
    """(id, smallest id of its part) for the parts that a matrix of links makes of its rows and columns."""
    least = sorted({*xs, *ys})
    place = {i: k for k, i in enumerate(least)}
    lx, ly = np.array([place[i] for i in xs]), np.array([place[i] for i in ys])
    none = len(least)
    while True:
        new_y = np.minimum(ly, np.where(link, lx[:, None], none).min(axis=0))
        new_x = np.minimum(lx, np.where(link, new_y[None, :], none).min(axis=1))
        if (new_x == lx).all() and (new_y == ly).all():
            break
        lx, ly = new_x, new_y
    return sorted({(i, least[k]) for i, k in [*zip(xs, lx.tolist(), strict=True), *zip(ys, ly.tolist(), strict=True)] if i != least[k]})


def compared(num: int, den: int, ids_x, part_x, nx, x, has_x, ids_y, part_y, ny, y, has_y) -> list[tuple]:
    """Links between the documents of two leaves (or of one with itself) that are not of one part yet, as joined() gives them."""
    may = (part_x[:, None] != part_y[None, :]) & (nx[:, None] * den >= ny[None, :] * num) & (ny[None, :] * den >= nx[:, None] * num)
    if not may.any():
        return []
    common = overlaps(x, has_x, y, has_y)
    link = may & (common * den >= num * (nx[:, None] + ny[None, :] - common))
    return joined(link, ids_x, ids_y) if link.any() else []


#: Columns of a leaf that its comparison with another one takes.
LOAD = ("ids", "parts", "sizes", "tokens", "has")
NODE = "node long, home long, pure long, ids array<{0}>, parts array<{0}>, sizes array<long>, tokens binary, has binary, maps binary, small long, large long, least long, " + ", ".join(f"b{k} long" for k in range(MAP)) + ", links array<struct<a: {0}, b: {0}>>"


def _leaves(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Cut documents, sorted by (home, pure, size, id) in ranges, into leaves; a row per leaf (NODE).

    docs has id, text, home, pure (its component if that is large, else -1), part (its component). A leaf
    holds documents of one home and one pure. links are those between its own documents.
    """
    id_type, id_kind = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId() << 32, 0
        key, ids, parts, sets = None, [], [], []
        out: list[dict] = []

        def close() -> None:
            nonlocal count
            if not ids:
                return
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens, has = table(sets)
            maps = bitmaps(tokens, has, 1 << max(8, (2 * int(sizes.max()) - 1).bit_length()))
            both = np.packbits(maps.any(axis=0).reshape(-1, min(maps.shape[1], 64 * MAP)).any(axis=0), bitorder="little")
            both = np.tile(both, 8 * MAP // len(both)).view(np.int64)
            links = []
            if len(ids) > 1 and key[1] == -1:
                part = np.array(parts)
                links = compared(num, den, ids, part, sizes, tokens, has, ids, part, sizes, tokens, has)
            least = int(maps.reshape(len(maps), -1, min(maps.shape[1], 64 * MAP)).any(axis=1).sum(axis=1).min())
            row = {"node": task | count, "home": key[0], "pure": key[1], "ids": list(ids), "parts": list(parts), "sizes": sizes.tolist(), "tokens": tokens.tobytes(), "has": np.packbits(has, axis=1).tobytes(), "maps": np.packbits(maps, axis=1).tobytes()}
            row |= {"small": int(sizes.min()), "large": int(sizes.max()), "least": least} | {f"b{k}": int(both[k]) for k in range(MAP)}
            out.append(row | {"links": [{"a": a, "b": b} for a, b in links]})
            count += 1
            ids.clear(), parts.clear(), sets.clear()

        def packed() -> pa.RecordBatch:
            fields = [("node", pa.int64()), ("home", pa.int64()), ("pure", pa.int64()), ("ids", pa.list_(id_kind)), ("parts", pa.list_(id_kind)), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("has", pa.binary()), ("maps", pa.binary())]
            fields += [(c, pa.int64()) for c in ("small", "large", "least", *(f"b{k}" for k in range(MAP)))] + [("links", pa.list_(pa.struct([("a", id_kind), ("b", id_kind)])))]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

        for batch, texts in slices(batches, 1):
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "home", "pure", "part")), shingle_sets(texts, n), strict=True)
            for id_, home, pure, part, s in rows:
                if ids and (key != (home, pure) or len(ids) == LEAF or sum(map(len, sets)) + len(s) > TOKENS):
                    close()
                if ids and ids[-1] == id_:  # a repeated row
                    continue
                key = home, pure
                ids.append(id_), parts.append(part), sets.append(s)
            if len(out) >= 64:
                yield packed()
                out.clear()
        close()
        if out:
            yield packed()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["home", "pure", "size", "id"]
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text", "home", "pure", "part")
    return dealt.mapInArrow(run, NODE.format(id_type))


def _loaded(pairs: DataFrame, nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (x, y) of leaves with some columns of both, each named after its side."""
    load = lambda z: nodes.select(F.col("node").alias(z), *[F.col(c).alias(f"{c}_{z}") for c in columns]).hint("merge")
    return pairs.join(load("x"), "x").join(load("y"), "y")


def _room(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of leaves with two documents, not of one component yet, whose own bitmaps leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                side = []
                for z in ("x", "y"):
                    parts, sizes, maps = (batch.column(f"{c}_{z}")[k].as_py() for c in ("parts", "sizes", "maps"))
                    bits = np.unpackbits(np.frombuffer(maps, np.uint8).reshape(len(parts), -1), axis=1)
                    side.append((np.array(parts), np.array(sizes, np.int64), bits.astype(bool)))
                (px, nx, bx), (py, ny, by) = side
                keep.append(bool((plausible(num, den, nx, bx, ny, by) & (px[:, None] != py[None, :])).any()))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return written(_loaded(pairs, nodes, ("parts", "sizes", "maps")).select("x", "y", *[f"{c}_{z}" for z in "xy" for c in ("parts", "sizes", "maps")]).mapInArrow(run, "x long, y long"), "room")


def _leaf_links(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the documents of pairs (x, y) of leaves, compared by their whole sets where their bitmaps leave room."""
    kind = nodes.schema["ids"].dataType.elementType.simpleString()
    pairs = _room(pairs, nodes, num, den)
    needed = written(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "needed")
    both = _loaded(pairs, sized_join(nodes, needed, "node", "left_semi"), LOAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                side = []
                for z in ("x", "y"):
                    ids, parts, sizes, tokens, has = (batch.column(f"{c}_{z}")[k].as_py() for c in LOAD)
                    values = np.frombuffer(tokens, np.uint64)
                    bits = np.unpackbits(np.frombuffer(has, np.uint8).reshape(len(ids), -1), axis=1)[:, : len(values)]
                    side += [ids, np.array(parts), np.array(sizes, np.int64), values, bits.astype(bool)]
                found += compared(num, den, *side)
            t = batch.column("ids_x").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j in (0, 1)], names=["a", "b"])

    links = written(both.mapInArrow(run, f"a {kind}, b {kind}"), "links")
    release(pairs, needed)
    return links


def _homes(entries: DataFrame) -> DataFrame:
    """id, size, part, pure and home, the signature that a document shares with the largest crowd, or else the smallest that it shares: near copies mostly agree on it."""
    least = F.min(F.struct(F.when(F.col("n") >= CROWD, -F.col("n")).otherwise(0).alias("crowd"), "sig"))
    return entries.groupBy("id", "size", "part", "pure").agg(least.alias("h")).select("id", "size", "part", "pure", F.col("h.sig").alias("home"))


def _forest(entries: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, (sig, node, top) of the signatures under which each leaf hangs; top is its inner node)."""
    homes = written(_homes(entries), "homes")
    nodes = written(_leaves(sized_join(docs, homes, "id"), n, num, den), "nodes")
    place = nodes.select(F.explode("ids").alias("id"), "node")
    top = F.shiftleft(F.shiftright("node", 32), 32).bitwiseOR(F.shiftright(F.col("node").bitwiseAND(F.lit((1 << 32) - 1)), FAN.bit_length() - 1))
    hung = written(entries.select("id", "sig").join(place.hint("merge"), "id").select("sig", "node").distinct().withColumn("top", top), "hung")
    release(homes)
    return nodes, hung


def _summary(nodes: DataFrame, by: str) -> DataFrame:
    """OR of the bitmaps, the least number of bits, the size range and the pure component (-1 if not one) of nodes by a column."""
    return nodes.groupBy(by).agg(
        *(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(MAP)),
        F.min("small").alias("small"), F.max("large").alias("large"), F.min("least").alias("least"),
        F.when(F.min("pure") == F.max("pure"), F.min("pure")).otherwise(-1).alias("pure"),
    )


def _met(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes that may hold a link, by component, sizes and largest possible overlap."""
    side = lambda z: nodes.select(F.col(nodes.columns[0]).alias(z), *[F.col(c).alias(f"{c}_{z}") for c in nodes.columns[1:]])
    few = nodes.count() <= 100_000  # rows of fixed width
    c = F.col
    common = sum((F.bit_count(c(f"b{k}_x").bitwiseAND(c(f"b{k}_y"))) for k in range(MAP)), F.lit(0))
    room = (
        ((c("pure_x") != c("pure_y")) | (c("pure_x") == -1))
        & (c("large_x") * den >= c("small_y") * num) & (c("large_y") * den >= c("small_x") * num)
        & ((c("least_x") - common) * den <= c("large_x") * (den - num))
        & ((c("least_y") - common) * den <= c("large_y") * (den - num))
    )
    how = "broadcast" if few else "merge"
    return pairs.join(side("x").hint(how), "x").join(side("y").hint(how), "y").where(room).select(*pairs.columns)


def _descend(nodes: DataFrame, hung: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of leaves that hang under a common signature and may hold a link: inner nodes first, then their leaves."""
    tops = hung.select("sig", "top").distinct()
    inner = written(
        tops.select("sig", F.col("top").alias("x")).join(tops.select("sig", F.col("top").alias("y")).hint("merge"), "sig").where("x <= y"), "inner"
    )
    top_of = hung.select("node", "top").distinct()
    above = written(_summary(nodes.join(top_of.hint("merge"), "node"), "top"), "above")
    met = written(_met(inner, above, num, den), "met")
    x = hung.select("sig", F.col("top").alias("x"), F.col("node").alias("leaf_x"))
    y = hung.select("sig", F.col("top").alias("y"), F.col("node").alias("leaf_y"))
    below = met.join(x.hint("merge"), ["sig", "x"]).join(y.hint("merge"), ["sig", "y"]).where("leaf_x < leaf_y").select(F.col("leaf_x").alias("x"), F.col("leaf_y").alias("y")).distinct()
    below = written(below, "below")
    out = written(_met(below, _summary(nodes, "node"), num, den), "pairs")
    release(inner, above, met, below)
    return out


def _stars(hung: DataFrame) -> DataFrame:
    """One pair (x, y) per leaf: with that one, among the first leaves of its signatures, under which it hangs most often."""
    first = hung.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("last")).where("x < last").select("sig", "x")
    return (
        hung.join(first.hint("merge"), "sig")
        .where("node <> x")
        .groupBy("node", "x")
        .agg(F.count("*").alias("shared"))
        .groupBy("node")
        .agg(F.max(F.struct("shared", "x")).alias("best"))
        .select("best.x", F.col("node").alias("y"))
    )


def ngram_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by Jaccard similarity num/den or more of their n-word shingle sets.

    A-Z are lowered; words are runs of characters other than ASCII white space; a text with fewer words
    has one shingle, its whole sequence. Documents with equal sets are one class and compared once.
    1. Each class cuts its set into segments by hash and keeps some of them as signatures (see Bands);
       linked classes keep a common one.
    2. Classes with the same home (the signature of the largest crowd, else the smallest one) are dealt to leaves of bounded size, in order of size;
       leaves hang under the signatures of their documents. A leaf's documents are compared with each
       other, and each leaf with the first one of its signatures; most crowds are one component then.
    3. The classes under signatures that still join several components are dealt anew, large components
       apart. Inner nodes and leaves hold OR-combined bitmaps, size ranges and their component. Pairs of
       inner nodes under one signature, then pairs of the leaves below them, are pruned by the largest
       overlap possible, then by the bitmaps of their documents; leaves that are left are compared by their whole sets, with a row per document
       that gets a new link and none per pair.

    Returns one row per input row: id, n_shingles, component_id (smallest id that links reach). Null and
    empty texts have no shingles and no links; a null id belongs to nothing else (component null); ids
    may be of any type that can be ordered, are expected to name one text, and repeated rows give equal results; an empty table gives an empty
    result; other columns are ignored. Exact but for collisions of 64-bit hashes.
    """
    with small_batches(docs.sparkSession):
        return _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, num, den).withColumnRenamed("id", id_col)


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    features = written(_features(docs, n, num, den), "features")
    used: list[DataFrame] = []
    classes = written(
        tree_merge(features.select("id", "size", "digest"), ["digest", "size"], fan_in=64, used=used).select("id", "size", F.when(F.col("size") > 0, F.col("keep.id")).otherwise(F.col("id")).alias("class")),
        "classes",
    )
    release(*used)
    copies = written(classes.where("id <> class").select("id"), "copies")
    signed = sized_join(features.where("id is not null and size > 0").select("id", "size", "sigs"), copies, "id", "left_anti")
    often = written(signed.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "often")
    entries = sized_join(signed.select("id", "size", F.explode("sigs").alias("sig")), often, "sig", "inner", SIGNATURES)
    entries = written(entries.withColumns({"part": F.col("id"), "pure": F.lit(-1).cast("long")}), "entries")
    release(features, copies, often)

    nodes, hung = _forest(entries, docs, n, num, den)
    inside = nodes.select(F.explode("links").alias("l")).select("l.a", "l.b")
    links = written(inside.union(_leaf_links(_stars(hung), nodes, num, den)), "links")
    release(nodes, hung)

    found = components(links)
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    found = written(found.join(sizes.hint("merge"), "component"), "components")
    large = F.when(F.col("members") >= LEAF, F.xxhash64("component").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(-1)
    grouped = sized_join(entries.select("id", "size", "sig", "n"), found, "id", "left").withColumns({"part": F.coalesce("component", "id"), "pure": F.coalesce(large, F.lit(-1))})
    grouped = written(grouped.select("id", "size", "sig", "n", "part", "pure"), "grouped")
    mixed = written(grouped.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("sig"), "mixed")
    open_ = written(sized_join(grouped, mixed, "sig", "left_semi", SIGNATURES), "open")
    release(entries, found, grouped, mixed)

    nodes, hung = _forest(open_, docs, n, num, den)
    inside = nodes.select(F.explode("links").alias("l")).select("l.a", "l.b")
    last = links.union(inside).union(_leaf_links(_descend(nodes, hung, num, den), nodes, num, den))
    last = written(components(last).withColumnRenamed("id", "class"), "components")
    release(open_, nodes, hung, links)
    return sized_join(classes, last, "class", "left").select("id", F.col("size").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
