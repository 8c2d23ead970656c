"""Token ids in grammar-compressed shards (Re-Pair) that can be read at any place."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import release, small_batches, written
from graphloom.llm.shingles import mix, powers, slices

#: Ids after which a shard is closed (a document is never cut).
SHARD = 1 << 20
#: Units (words or parts of them) that a Python worker remembers before it starts anew, and the bits of its table of slots.
UNITS, TABLE = 1_000_000, 21
#: A shard's value begins with MAGIC and HEAD: first nonterminal, rules, symbols, bytes of a symbol, ids. Then follow, all little-endian:
#: left and right symbol and expansion length of each rule (u32), ids before every STEP-th symbol (u64), the symbols (u16 or u32).
MAGIC, HEAD, STEP = b"RPG1", struct.Struct("<IIIIQ"), 256
#: A round replaces pairs that occur at least 1 / NEAR times as often as the commonest one, at most PAIRS of them.
NEAR, PAIRS = 64, 2048
#: Pairs that occur less often stay; rounds end when they save less than one part in SAVES of the sequence.
LEAST, SAVES = 16, 30


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 white space, 1 letter (or part of a Latin one), 2 digit, 3 other sign, 4 what only the library judges."""
    out = np.full(256, 3, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[0x80:] = 4
    return out


_KIND, _ODD = _kinds(), np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class UnitEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each different unit.

    The vocabulary's normaliser and pre-tokeniser drop white space and never look across it, so the ids of a text
    are those of its words. Words of ASCII and Latin-1 letters (UTF-8 C3 80 to C3 BF), digits and signs are lowered
    and cut into runs of letters, single digits and runs of signs, as the pre-tokeniser cuts them; words with an
    apostrophe or with any other character are one unit each. Units are found, hashed and looked up a batch at a
    time; only new ones become strings. Texts that may hold a special token go to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Know nothing but unit 0, the mark of a document's end."""
        self.slots, self.unit_of = np.zeros(1 << TABLE, np.uint64), np.zeros(1 << TABLE, np.int32)
        self.others: dict[int, int] = {}  # units whose two slots are taken
        self.starts, self.sizes, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends, lowered bytes) of the units of a text of many."""
        kind, low = _KIND[data], data.copy()
        low[(data >= ord("A")) & (data <= ord("Z"))] += 32
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        latin = (after != 0x97) & (after != 0xB7)
        kind[lead[latin]] = kind[lead[latin] + 1] = 1
        low[lead[latin & (after < 0x9F)] + 1] += 32
        space = kind == 0
        begin = np.empty(len(data), bool)
        begin[0] = not space[0]
        begin[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~space[1:]
        whole = (kind == 4) | (data == 0x27)
        if whole.any():
            word = np.empty(len(data), bool)
            word[0], word[1:] = begin[0], space[:-1] & ~space[1:]
            number = np.cumsum(word, dtype=np.int32)
            flagged = np.zeros(int(number[-1]) + 1, bool)
            flagged[number[whole]] = True
            begin &= word | ~flagged[number]
        edges = np.flatnonzero(begin | space)
        first = begin[edges]
        starts, ends = edges[first], np.r_[edges[1:], len(data)][first]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[low] * up[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD) | np.uint64(1), starts, ends, low

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two slots of each hash."""
        return (hashes >> np.uint64(64 - TABLE)).astype(np.intp), (hashes >> np.uint64(1) & np.uint64((1 << TABLE) - 1)).astype(np.intp)

    def _known(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are learnt."""
        one, two = self._places(hashes)
        out = np.where(self.slots[one] == hashes, self.unit_of[one], -1)
        rest = np.flatnonzero(out < 0)
        at = two[rest]
        out[rest] = np.where(self.slots[at] == hashes[rest], self.unit_of[at], -1)
        rest = rest[out[rest] < 0]
        if len(rest):
            fresh, first, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            found = np.array([self.others.get(h, -1) for h in fresh.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = self._learn(fresh[new], [low[starts[k] : ends[k]].tobytes().decode() for k in rest[first[new]].tolist()])
            out[rest] = found[back]
        return out

    def _learn(self, hashes: np.ndarray, units: list[str]) -> np.ndarray:
        """Number new units and remember their ids."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.array([len(g) for g in got], np.int64)
        numbers = np.arange(len(self.sizes), len(self.sizes) + len(got))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, np.array([i for g in got for i in g], np.uint32)]
        seated = np.zeros(len(numbers), bool)
        for place in self._places(hashes):
            free = ~seated & (self.slots[place] == 0)
            self.slots[place[free]], self.unit_of[place[free]] = hashes[free], numbers[free]
            seated |= free & (self.slots[place] == hashes)  # of several for one slot, the last has it
        for k in np.flatnonzero(~seated).tolist():
            self.others[int(hashes[k])] = int(numbers[k])
        return numbers

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with its end id; how many each text has)."""
        if len(self.sizes) > UNITS or len(self.ids) > 8 * UNITS:
            self.forget()
        odd = [k for k, t in enumerate(texts) if any(m in t for m in self.special)]
        data = b" ".join([b"", *texts, b""]) if not odd else b" ".join([b"", *(b"" if k in set(odd) else t for k, t in enumerate(texts)), b""])
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        sizes[odd] = 1
        hashes, starts, ends, low = self._units(np.frombuffer(data, np.uint8))
        units = self._known(hashes, starts, ends, low)
        after = np.searchsorted(starts, 1 + np.cumsum(sizes) - 1)
        units = np.insert(units, after, 0)
        wide = self.sizes[units]
        out = self.ids[gathered(self.starts[units], wide)]
        bounds = np.r_[0, np.cumsum(wide)][after + np.arange(1, len(texts) + 1)]
        counts = np.diff(bounds, prepend=0)
        if odd:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[k].decode() for k in odd], add_special_tokens=False)]
            out = np.insert(out, np.repeat(bounds[odd] - 1, [len(g) for g in got]), np.concatenate(got))
            counts[odd] += [len(g) for g in got]
        return out, counts


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of many ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _chosen(left_of: list[int], right_of: list[int]) -> list[int]:
    """Which of these pairs, commonest first, a round replaces: no symbol is the left one of a pair and the right one of another, so occurrences never overlap."""
    left, right, alone, out = set(), set(), set(), []
    for k, (a, b) in enumerate(zip(left_of, right_of, strict=True)):
        if a in alone or b in alone or a in right or b in left or a == b and (a in left or a in right):
            continue
        if a == b:
            alone.add(a)
        else:
            left.add(a), right.add(b)
        out.append(k)
    return out


def _every_other(place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first, third, ... place of each run."""
    step = np.arange(len(place))
    return (step - np.maximum.accumulate(np.where(begins, step, 0))) % 2 == 0


def repair(ids: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(symbols, first nonterminal, rules as rows of left and right symbol) of a grammar that makes ids.

    Each round counts pairs of neighbours in a table of hashed slots, gives the commonest ones nonterminals
    and replaces every occurrence; of a run of one symbol, every other pair. Of pairs that share a slot only
    one is replaced in a round; the hash is another one in each round.
    """
    first = int(ids.max(initial=0)) + 1
    seq, rules, made, odd = ids.astype(np.uint32), [], first, 0x9E3779B1
    while len(seq) > LEAST:
        narrow = made + PAIRS <= 1 << 16  # then a pair fits 32 bits
        kind, bits = (np.uint32, 32) if narrow else (np.uint64, 64)
        key = seq[:-1].astype(kind) << kind(bits // 2) | seq[1:]
        width = max(10, min(17, len(key).bit_length() - 1))
        slot = (key * kind(odd if narrow else odd * 0x100000001 & (1 << 64) - 1 | 1) >> kind(bits - width)).astype(np.intp)
        slots = np.bincount(slot, minlength=1 << width)
        often = np.flatnonzero(slots >= max(LEAST, int(slots.max()) // NEAR))
        if not len(often):
            break
        often = often[np.argsort(-slots[often], kind="stable")[:PAIRS]]
        number = np.zeros(1 << width, np.int16)
        number[often] = np.arange(1, len(often) + 1)
        number = number[slot]
        place = np.flatnonzero(number)
        number, near = number[place] - 1, key[place]
        held = np.zeros(len(often), kind)
        held[number] = near
        own = held[number] == near  # the occurrences of each slot's own pair
        place, number = place[own], number[own]
        a, b = (held >> kind(bits // 2)).tolist(), (held & kind((1 << bits // 2) - 1)).tolist()
        rank = np.argsort(-np.bincount(number, minlength=len(often)), kind="stable").tolist()
        chosen = [rank[k] for k in _chosen([a[k] for k in rank], [b[k] for k in rank])]
        rule = np.zeros(len(often), np.uint32)
        rule[chosen] = np.arange(made, made + len(chosen), dtype=np.uint32)
        new = rule[number]
        place, new = place[new > 0], new[new > 0]
        twin = seq[place] == seq[place + 1]
        if twin.any():  # runs of one symbol
            run = place[twin]
            keep = ~twin
            keep[twin] = _every_other(run, np.r_[True, (np.diff(run) != 1) | (seq[run[1:]] != seq[run[:-1]])])
            place, new = place[keep], new[keep]
        seq[place] = new
        left = np.ones(len(seq), bool)
        left[place + 1] = False
        seq = seq[left]
        rules += [(a[k], b[k]) for k in chosen]
        made += len(chosen)
        odd = odd * 0x2C1B3C6D + 0x3C6EF372 & 0xFFFFFFFF | 1
        if len(place) * SAVES < len(seq):
            break
    return seq, first, np.array(rules, np.int64).reshape(-1, 2)


def rule_lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def packed(ids: np.ndarray) -> bytes:
    """The value of a shard that holds ids."""
    symbols, first, rules = repair(ids)
    sizes = rule_lengths(first, rules)
    kind = np.dtype("<u2") if first + len(rules) <= 1 << 16 else np.dtype("<u4")
    wide = np.r_[np.ones(first, np.int64), sizes][symbols]
    before = (np.cumsum(wide) - wide)[::STEP]
    head = MAGIC + HEAD.pack(first, len(rules), len(symbols), kind.itemsize, len(ids))
    return head + rules.T.astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + before.astype("<u8").tobytes() + symbols.astype(kind).tobytes()


class Shard:
    """A shard's value, read without expanding it."""

    def __init__(self, value: bytes):
        if value[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.first, n, symbols, width, self.n_ids = HEAD.unpack_from(value, 4)
        at = 4 + HEAD.size
        self.rules = np.frombuffer(value, "<u4", 2 * n, at).reshape(2, n).T
        self.sizes = np.frombuffer(value, "<u4", n, at + 8 * n).astype(np.int64)
        steps = -(-symbols // STEP)
        self.before = np.frombuffer(value, "<u8", steps, at + 12 * n).astype(np.int64)
        self.symbols = np.frombuffer(value, f"<u{width}", symbols, at + 12 * n + 8 * steps)
        self.expanded: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: each id and each rule's expansion lies once in one array, from which they are gathered."""
        if self.expanded is None:
            self.starts = np.r_[np.arange(self.first), self.first + np.cumsum(self.sizes) - self.sizes]
            self.wide = np.r_[np.ones(self.first, np.int64), self.sizes]
            flat = np.empty(self.first + int(self.sizes.sum()), np.uint32)
            flat[: self.first] = np.arange(self.first)
            starts, wide = self.starts.tolist(), self.wide.tolist()
            for k, (a, b) in enumerate(self.rules.tolist(), self.first):
                at, cut = starts[k], starts[k] + wide[a]
                flat[at:cut] = flat[starts[a] : starts[a] + wide[a]]
                flat[cut : at + wide[k]] = flat[starts[b] : starts[b] + wide[b]]
            self.expanded = flat
        return self.expanded[gathered(self.starts[symbols], self.wide[symbols])]

    def ids(self) -> np.ndarray:
        """All ids."""
        return self._expand(self.symbols)

    def part(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: only symbols that cover them are expanded, by their expansion lengths."""
        step = max(int(np.searchsorted(self.before, start, "right")) - 1, 0)
        last = int(np.searchsorted(self.before, stop, "left"))
        symbols = self.symbols[step * STEP : last * STEP].astype(np.int64)
        if stop <= start or not len(symbols):
            return np.empty(0, np.uint32)
        wide = np.r_[np.ones(self.first, np.int64), self.sizes][symbols]
        ends = self.before[step] + np.cumsum(wide)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - int(ends[lo] - wide[lo])
        return self._expand(symbols[lo:hi])[skip : skip + stop - start]


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def _encoder(path: str, end_id: int) -> UnitEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = UnitEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Encode every text and write all ids in the order of the documents' ids; the files, read back: a row per shard.

    Documents are dealt by ranges of (id, hash of the text), so that an id that repeats very often has many
    ranges, and sorted; a task encodes its range a batch at a time and closes a shard after about `shard` ids.
    Columns: part and shard (order of the shards), ids, counts (ids of each document), n_ids, value (see MAGIC).
    Null ids come first; null texts are empty and have the end id alone; of equal ids, texts come by their hash.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    names = ["part", "shard", "ids", "counts", "n_ids", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path, end_id), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        done = size = 0

        def close() -> pa.RecordBatch:
            nonlocal done, size, held
            ids, counts = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            value = packed(np.concatenate([h[2] for h in held]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), x) for x in (ids, pa.array(counts))]
            row = [pa.array([part], pa.int32()), pa.array([done]), *lists, pa.array([size]), pa.array([value], pa.binary())]
            done, size, held = done + 1, 0, []
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch, texts in slices(batches, 1):
            ids, counts = encoder.encode(texts)
            ends, at = np.r_[0, np.cumsum(counts)], 0
            while at < len(counts):
                to = min(at + int(np.searchsorted(ends[at + 1 :], ends[at] + shard - size)) + 1, len(counts))
                held.append((batch.column(0).slice(at, to - at), counts[at:to], ids[ends[at] : ends[to]]))
                size, at = size + int(ends[to] - ends[at]), to
                if size >= shard:
                    yield close()
        if held:
            yield close()

    with small_batches(spark):
        dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return written(dealt.mapInArrow(run, f"part int, shard long, ids array<{kind}>, counts array<long>, n_ids long, value binary"), "tokens")


def _before(shards: DataFrame) -> DataFrame:
    """part, shard and how many ids all shards before it hold: sums inside a part, and of the parts before (one row each)."""
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(parts.hint("broadcast"), "part").select("part", "shard", (F.col("earlier") + F.col("inside")).alias("before"))


def token_digests(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read all shards: id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = memoryview(Shard(batch.column("value")[k].as_py()).ids().astype("<u4")).cast("B")
                counts = batch.column("counts")[k].values.to_numpy()
                ends = np.cumsum(counts)
                starts = ends - counts
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(starts + batch.column("before")[k].as_py()), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    before = written(_before(shards), "before")
    placed = shards.join(before.hint("broadcast" if before.count() <= 1_000_000 else "merge"), ["part", "shard"])
    with small_batches(shards.sparkSession):
        out = written(placed.select("ids", "counts", "value", "before").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long"), "digests")
    release(before)
    return out.withColumnRenamed("id", id_col)


def read_tokens(shards: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids (array of int) of the documents whose id is in the one column of `wanted`: only the symbols that cover them are expanded."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, places = Shard(batch.column("value")[k].as_py()), batch.column("places")[k].as_py()
                ends = np.cumsum(batch.column("counts")[k].values.to_numpy())
                got = [shard.part(int(ends[p - 1]) if p else 0, int(ends[p])).tolist() for p in places]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values.take(pa.array(places)), pa.array(got, pa.list_(pa.int32()))], names=["id", "ids"])

    asked = written(wanted.toDF("id").distinct(), "asked")
    spread = shards.select("part", "shard", F.posexplode("ids").alias("place", "id"))
    found = spread.join(asked.hint("broadcast" if asked.count() <= 1_000_000 else "merge"), "id", "left_semi").groupBy("part", "shard").agg(F.collect_list("place").alias("places"))
    found = written(found, "found")
    hit = shards.join(found.hint("broadcast" if found.count() <= 10_000 else "merge"), ["part", "shard"])
    with small_batches(shards.sparkSession):
        return written(hit.select("ids", "counts", "value", "places").mapInArrow(run, f"id {kind}, ids array<int>"), "read").withColumnRenamed("id", id_col)
