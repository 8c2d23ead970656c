"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shingles import mix, sequence_hashes, slices, words_of

#: Cells of a fingerprint.
CELLS = 16
HASHES = 3
#: A retry takes ROOM cells for each digest of both texts, every further one twice as many as the one before.
ROOM = 1.5
#: A paragraph ends at a line break, at a sentence end, and after one word in CUT, which the word's own hash chooses.
CUT = 16
_LOW, _BITS, _HIGH = np.uint64((1 << 21) - 1), np.uint64(21), np.uint64(43)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def digests(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the paragraphs of a batch of texts, one text after the other, and where each text's begin.

    Cuts depend on nearby words only, so edits stay local. The n-th repeat of a paragraph in a text has a
    digest of its own.
    """
    words = words_of(texts, lower=False)
    count, n = len(words.hashes), len(texts)
    if not count:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    lines = np.flatnonzero(words.data == 10)  # a line break lies between any two texts
    ends = _STOP[words.data[words.ends - 1]] | (words.hashes % np.uint64(CUT) == 0)
    ends[:-1] |= np.searchsorted(lines, words.ends[:-1]) < np.searchsorted(lines, words.starts[1:])
    ends[-1] = True
    stop = np.flatnonzero(ends) + 1
    start = np.r_[0, stop[:-1]]
    keys = sequence_hashes(words.hashes, start, stop)
    bounds = np.searchsorted(start, words.bounds)
    text = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((keys, text))
    same = np.r_[False, (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])]
    place = np.arange(len(keys))
    repeat = np.empty(len(keys), np.int64)
    repeat[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    with np.errstate(over="ignore"):
        return np.where(repeat > 0, mix(keys + repeat.astype(np.uint64) * _ODD), keys), bounds


def _check(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * _ODD) >> np.uint64(32)


class Sketches:
    """Invertible Bloom lookup tables, one after the other; each key is counted and XOR-ed, with its check, into HASHES cells of its table."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.start = cells, np.r_[0, np.cumsum(cells)]
        total = int(self.start[-1])
        self.count, self.key, self.check = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def put(self, keys: np.ndarray, table: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
        """Add keys (or take them out, by sign) to their tables; returns the cells touched."""
        cells = self.cells[table].astype(np.uint64)
        third = cells // np.uint64(HASHES)
        with np.errstate(over="ignore"):
            h = mix(keys + cells * _ODD)
        one = (h & _LOW) * third >> _BITS
        two = ((h >> _BITS) & _LOW) * third >> _BITS
        three = (h >> _HIGH) * (cells - third * np.uint64(HASHES - 1)) >> _BITS
        at = np.concatenate((one, two + third, three + third * np.uint64(2))).astype(np.int64) + np.tile(self.start[table], HASHES)
        check = np.tile(_check(keys), HASHES)
        np.add.at(self.count, at, 1 if signs is None else np.tile(signs, HASHES))
        np.bitwise_xor.at(self.key, at, np.tile(keys, HASHES))
        np.bitwise_xor.at(self.check, at, check)
        return at

    def minus(self, other: Sketches) -> Sketches:
        """The cells' differences: what both hold cancels."""
        out = Sketches.__new__(Sketches)
        out.cells, out.start = self.cells, self.start
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def pick(self, tables: np.ndarray, size: int) -> Sketches:
        """Some of the tables, all of one size."""
        out = Sketches.__new__(Sketches)
        out.cells, out.start = self.cells[tables], np.arange(len(tables) + 1) * size
        out.count, out.key, out.check = (x.reshape(-1, size)[tables].ravel() for x in (self.count, self.key, self.check))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take the keys of cells that hold a single one out of their tables until none is left.

        Returns the recovered keys, their tables and signs (1 in the first only, -1 in the second only), and
        for each table whether it is empty now, which means that all its keys are recovered.
        """
        found, tables, signs = [], [], []
        look = np.arange(len(self.count))
        for _ in range(1000):  # a wrong check could go on for ever
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            if not len(pure):
                break
            table = np.searchsorted(self.start, pure, "right") - 1
            with np.errstate(over="ignore"):
                first = np.unique(self.key[pure] + table.astype(np.uint64) * _ODD, return_index=True)[1]
            keys, table, sign = self.key[pure][first], table[first], self.count[pure][first]
            look = np.unique(self.put(keys, table, -sign))
            found.append(keys), tables.append(table), signs.append(sign)
        left = np.searchsorted(self.start, np.flatnonzero((self.count != 0) | (self.key != 0)), "right") - 1
        empty = np.ones(len(self.cells), bool)
        empty[left] = False
        none = np.empty(0, np.int64)
        return (np.concatenate(found) if found else none.astype(np.uint64)), np.concatenate(tables or [none]), np.concatenate(signs or [none]), empty

    def texts(self, size: int) -> list[str]:
        """Hexadecimal forms of tables of one size: count, key and check of each cell."""
        rows = np.stack([self.count.astype(np.uint64), self.key, self.check], axis=1).astype("<u8").reshape(-1, size * 3)
        return [r.tobytes().hex() for r in rows]


def _gather(keys: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the given texts, one after the other, and the place of each one's text in docs."""
    n = np.diff(bounds)[docs]
    at = np.repeat(bounds[docs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return keys[at], np.repeat(np.arange(len(docs)), n)


class Batch:
    """The paragraph digests of a batch of texts and their fingerprints' sketches."""

    def __init__(self, texts: list[bytes | None]):
        self.keys, self.bounds = digests(texts)
        self.sizes = np.diff(self.bounds)
        self.small = self.sketches(np.arange(len(texts)), np.full(len(texts), CELLS))

    def sketches(self, docs: np.ndarray, cells: np.ndarray) -> Sketches:
        """A sketch of each of the texts."""
        out = Sketches(cells)
        out.put(*_gather(self.keys, self.bounds, docs))
        return out

    def texts(self) -> list[str]:
        """Each text's fingerprint: number of digests and the cells."""
        return [f"{n}:{t}" for n, t in zip(self.sizes.tolist(), self.small.texts(CELLS), strict=True)]

    def differences(self, docs: np.ndarray, other: Batch, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many digests each text has and another one has not, and the other way round.

        The fingerprints are subtracted and peeled; pairs that this leaves cells of are tried anew by larger
        sketches until none is left.
        """
        only, lacks = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        open_ = np.arange(len(docs))
        rest = self.small.pick(docs, CELLS).minus(other.small.pick(others, CELLS))
        cells = np.maximum(2 * CELLS, (ROOM * (self.sizes[docs] + other.sizes[others])).astype(np.int64) + 8)
        while len(open_):
            _, table, sign, empty = rest.peel()
            plus, less = (np.bincount(table[sign == s], minlength=len(open_)) for s in (1, -1))
            only[open_[empty]], lacks[open_[empty]] = plus[empty], less[empty]
            open_ = open_[~empty]
            rest = self.sketches(docs[open_], cells[open_]).minus(other.sketches(others[open_], cells[open_]))
            cells = cells * 2
        return only, lacks

    def likeness(self, docs: np.ndarray, other: Batch, others: np.ndarray) -> np.ndarray:
        """Share of both texts' digests that the other has too, from the recovered difference; 1.0 for two empty texts."""
        total = self.sizes[docs] + other.sizes[others]
        only, lacks = self.differences(docs, other, others)
        return np.where(total > 0, 1 - (only + lacks) / np.maximum(total, 1), 1.0)


def edited_by(text: str, other: str) -> str:
    """The text with its last floor(n / 3) code points replaced by the first as many (or all) of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, part, head: rows in ranges of descending id, each followed by the first row of the next range (head).

    Ranges are those of a range partitioning of ids and text hashes alone; a row per range goes to the driver.
    Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    ranges = rows.select("id", "h").repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("id", "h")).alias("top"))
    tops = [r["top"] for r in ranges.orderBy("p").collect()]
    kind = rows.schema["id"].dataType.simpleString()
    key = F.struct("id", "h")
    bounds = F.array(*[F.struct(F.lit(t["id"]).cast(kind).alias("id"), F.lit(t["h"]).cast("long").alias("h")) for t in tops]) if tops else F.array().cast(f"array<struct<id: {kind}, h: bigint>>")
    rows = rows.withColumn("part", F.greatest(F.size(F.filter(bounds, lambda b: b >= key)) - 1, F.lit(0)))
    heads = rows.where(key == F.element_at(bounds, F.col("part") + 1)).groupBy("part", "id", "h").agg(F.min("text").alias("text"))
    heads = heads.select("id", "text", "h", F.pmod(F.col("part") - 1, F.lit(max(1, len(tops)))).cast("int").alias("part"))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads.where(F.lit(bool(tops))).withColumn("head", F.lit(True)))
    return both.repartitionById(max(1, len(tops)), F.col("part")).sortWithinPartitions("part", "head", *order).select("id", "text", "part", "head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and the text as edited from the next document (descending id, first after last).

    Documents are dealt to ranges of the id and sorted inside; the first row of each range also goes to the
    end of the range before, so that every document meets its next one without a sort in one task.

    Returns one row per input row: id (of any type with an order), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null text counts as empty; null ids come last; rows with one
    id, or with none, are ordered by a hash of the text; a single row is its own next; an empty table gives
    an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, list[bytes]] | None = None
        for batch, texts in slices(batches, 1):
            ids, part, head = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if held:
                ids = pa.concat_arrays([held[0].column(0), ids])
                part, head, texts = held[0].column(2).to_pylist() + part, held[0].column(3).to_pylist() + head, held[1] + texts
            held = batch.slice(batch.num_rows - 1), texts[-1:]
            pair = [k for k in range(len(texts) - 1) if not head[k] and part[k] == part[k + 1]]
            if not pair:
                continue
            plain = [t.decode("utf-8", "replace") for t in texts]
            edited = [edited_by(plain[k], plain[k + 1]).encode("utf-8", "surrogatepass") for k in pair]
            old, new, at = Batch(texts), Batch(edited), np.array(pair)
            prints = old.texts()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at)), pa.array([len(plain[k]) for k in pair], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([prints[k] for k in pair]), pa.array(new.texts()),
                    pa.array(old.likeness(at, new, np.arange(len(at)))), pa.array(old.likeness(at, old, at + 1)),
                ],
                names=names,
            )

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
