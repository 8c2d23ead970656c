"""The prefix trie of conversations, finished in sorted shards but for a skeleton of splitter paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, word_count, written

#: Ids in one piece of the list of a skeleton node's ends, and rows that a task gives at once.
PIECE, ROWS = 4096, 8192
FIELDS = "kind int, conv_id long, depth long, parent_conv_id long, skeleton long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, piece long, ends string"
NODE, PARTIAL, ENDS = 0, 1, 2
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


@dataclass
class Skeleton:
    """The trie of the splitter paths, in preorder; node 0 is the root. child: (node, digest) to node."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=lambda: [0])
    children: list[int] = field(default_factory=lambda: [0])
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)

    def add(self, path: list[bytes], words: list[int]) -> None:
        """Add a path; paths come in order."""
        at = 0
        for digest, n in zip(path, words, strict=True):
            digest = bytes(digest)
            if (at, digest) not in self.child:
                self.child[at, digest] = len(self.parent)
                self.children[at] += 1
                self.parent.append(at), self.depth.append(self.depth[at] + 1), self.words.append(n), self.children.append(0)
            at = self.child[at, digest]


def rebuilt(turns: DataFrame, group: int, most: int, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, path (a 16-byte digest of each turn), words (of each turn's text), as conversation_trie() rebuilds them.

    Turns are dealt by c - c % group, so one shuffle gathers both a conversation and the one it begins with.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(id_col).cast("long")
    rows = turns.where(conv.isNotNull()).select(conv.alias("conv"), (conv - conv % group).alias("base"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    turn = F.struct("turn", digest.alias("digest"), word_count(F.col("text")).alias("words"))
    convs = rows.select("conv", "base", turn.alias("t")).repartition("base").groupBy("base", "conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = convs.where("conv = base").select("base", F.slice("turns", 1, most - 1).alias("first"))
    shared = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    own = F.slice("turns", shared + 1, F.greatest(F.size("turns") - shared, F.lit(0)))
    none = F.slice("turns", 1, 0)
    made = convs.join(first.hint("merge"), "base", "left").select("conv", F.concat(F.slice(F.coalesce("first", none), F.lit(1), shared), own).alias("turns"))
    return made.select("conv", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words"))


def shared_prefix(a: list[bytes], b: list[bytes]) -> int:
    """How many first turns two paths share."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


def _skeleton(ranges: DataFrame) -> Skeleton:
    """The trie of what each range's first path shares with the last path of the range before.

    Two paths per range come to the driver, and at most (ranges x turns that neighbours share) nodes are made:
    the size depends on the number of ranges and the longest shared conversation, not on the number of conversations.
    """
    ends = ranges.groupBy("part").agg(F.min(F.struct("path", "conv", "words")).alias("first"), F.max(F.struct("path", "conv")).alias("last"))
    out, before = Skeleton(), None
    for r in ends.orderBy("part").collect():
        if before is not None:
            k = shared_prefix(before, r.first.path)
            out.add(r.first.path[:k], r.first.words[:k])
        before = r.last.path
    return out


class _Open:
    """A node of the path that is being read: what is known of it so far."""

    __slots__ = ("words", "conv", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, words: int):
        self.words, self.conv, self.n, self.children, self.leaves, self.saved = words, None, 0, 0, 0, 0
        self.ends, self.below = None, []


class Shard:
    """Reads the conversations of one range in order of (path, id); rows holds what is ready to go out."""

    def __init__(self, skeleton: Skeleton, part: int, rows: list[tuple]):
        self.skeleton, self.part, self.rows = skeleton, part, rows
        self.path: list[bytes] = []
        self.chain, self.stack = [0], []  # skeleton nodes of the path, and local ones below them
        self.partial: dict[int, list] = {}
        self.ends: dict[int, list[int]] = {}
        self.pieces: dict[int, int] = {}

    def read(self, conv: int, path: list[bytes], words: list[int]) -> None:
        """Take the next conversation."""
        same = shared_prefix(self.path, path)
        while self.stack and len(self.chain) - 1 + len(self.stack) > same:
            self._close()
        if not self.stack:
            del self.chain[same + 1 :]
            while (d := len(self.chain) - 1) < len(path) and (s := self.skeleton.child.get((self.chain[-1], path[d]))) is not None:
                self.chain.append(s)
        self.stack += map(_Open, words[len(self.chain) - 1 + len(self.stack) :])
        self.path = path
        if self.stack:
            top = self.stack[-1]
            top.n += 1
            top.conv = conv if top.conv is None else min(top.conv, conv)
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(b",%d" % conv)
        else:
            self._gain(self.chain[-1], 1, conv)
            held = self.ends.setdefault(self.chain[-1], [])
            held.append(conv)
            if len(held) == PIECE:
                self._piece(self.chain[-1])

    def _gain(self, s: int, n: int, conv: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        held = self.partial.setdefault(s, [0, conv, 0, 0, 0])
        held[:] = held[0] + n, min(held[1], conv), held[2] + children, held[3] + leaves, held[4] + saved

    def _piece(self, s: int) -> None:
        self.rows.append((ENDS, None, None, None, s, None, None, None, None, None, self.part, self.pieces.get(s, 0), ",".join(map(str, self.ends.pop(s)))))
        self.pieces[s] = self.pieces.get(s, 0) + 1

    def _close(self) -> None:
        """The last open node is whole: its children's rows can go out, its own once its parent is known."""
        depth, v = len(self.chain) - 1 + len(self.stack), self.stack.pop()
        leaves, saved = v.leaves or 1, v.saved + (v.n - 1) * v.words
        self.rows += [(*r[:3], v.conv, *r[4:]) for r in v.below]
        row = (NODE, v.conv, depth, None, None, v.n, v.children, leaves, saved, (v.ends or hashlib.sha256()).hexdigest(), None, None, None)
        if self.stack:
            up = self.stack[-1]
            up.n, up.conv = up.n + v.n, v.conv if up.conv is None else min(up.conv, v.conv)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            up.below.append(row)
        else:
            self._gain(self.chain[-1], v.n, v.conv, 1, leaves, saved)
            self.rows.append((*row[:4], self.chain[-1], *row[5:]))

    def finish(self) -> None:
        """Close all local nodes and give the partial aggregates of the skeleton nodes, those of a node included in its ancestors'."""
        while self.stack:
            self._close()
        for s in list(self.ends):
            self._piece(s)
        for s in list(self.partial):
            conv, up = self.partial[s][1], self.skeleton.parent[s]
            while up >= 0 and up not in self.partial:
                self.partial[up] = [0, conv, 0, 0, 0]
                up = self.skeleton.parent[up]
        for s in sorted(self.partial, reverse=True):  # parents have smaller numbers
            n, conv, children, leaves, saved = self.partial[s]
            if s:
                self._gain(self.skeleton.parent[s], n, conv, 0, leaves, saved)
            self.rows.append((PARTIAL, conv, None, None, s, n, children, leaves, saved, None, None, None, None))


def _finished(skeleton: Skeleton, partials: DataFrame) -> list[list]:
    """conv_id, depth, parent_conv_id, skeleton, n_convs, n_children, n_leaves, saved_tokens of the skeleton nodes.

    Spark reduces the partial aggregates to a row per node; what a skeleton node adds itself (a leaf, its own
    saved words) then goes up from child to parent.
    """
    got = {r.skeleton: r for r in partials.groupBy("skeleton").agg(F.min("conv_id").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).collect()}
    more_leaves, more_saved, out = [0] * len(skeleton.parent), [0] * len(skeleton.parent), []
    for s in range(len(skeleton.parent) - 1, -1, -1):
        if s not in got:
            continue
        r, up = got[s], skeleton.parent[s]
        children = r.n_children + skeleton.children[s]
        more_leaves[s] += not children
        more_saved[s] += (r.n_convs - 1) * skeleton.words[s]
        if up >= 0:
            more_leaves[up] += more_leaves[s]
            more_saved[up] += more_saved[s]
        out.append([r.conv, skeleton.depth[s], got[up].conv if up >= 0 else None, s, r.n_convs, children, r.n_leaves + more_leaves[s], r.saved_tokens + more_saved[s]])
    return out


def _hashed(pieces: DataFrame) -> DataFrame:
    """skeleton, ends_sha256 of the lists of ends that are cut into pieces; a task reads the pieces of a list one after the other and keeps none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, ([], [])
        for batch in batches:
            for s, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if s != at:
                    if state is not None:
                        out[0].append(at), out[1].append(state.hexdigest())
                    at, state = s, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if state is not None:
            out[0].append(at), out[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["skeleton", "ends_sha256"])

    dealt = pieces.select("skeleton", "part", "piece", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "part", "piece")
    return dealt.mapInArrow(run, "skeleton long, ends_sha256 string")


def conversation_trie(turns: DataFrame, group: int = 20, most: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all rebuilt conversations, a row per node.

    Conversation c is rebuilt as the first h turns of conversation c - c % group, then its own turns after its
    first h; h = crc32 of the decimal id modulo `most`. Turns are ordered by turn (null first), those of one
    turn number by a digest of role and text. A node is a distinct sequence of first turns (role, text).

    1. Every conversation becomes a path of digests; paths are dealt by ranges of (path, id), so that many copies of one
       conversation have many ranges.
    2. What neighbouring ranges share of their splitter paths makes the skeleton, the only nodes that can lie in
       several ranges; its trie is sent to all tasks.
    3. Each range is read in order: nodes that are not in the skeleton are finished there, skeleton nodes get
       partial aggregates, which Spark reduces; the list of the ids that end at one is hashed in pieces.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Null roles and texts are empty; rows without an id are left out; ids are integers; repeated rows are turns of their
    own; an empty table gives an empty result, without a root; other columns are ignored. The turns of one
    conversation are one row (32 bytes a turn). Exact but for collisions of 128 bits of SHA-256.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = written(rebuilt(turns, group, most, id_col, turn_col, role_col, text_col), "paths")
    ranges = written(paths.repartitionByRange(parts, "path", "conv").withColumn("part", F.spark_partition_id()), "ranges")
    skeleton = _skeleton(ranges)
    shared = spark.sparkContext.broadcast(skeleton)
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    types = [TYPES[f.split(" ")[1]] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard = None

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for part, conv, path, words in zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "path", "words")), strict=True):
                if shard is None or shard.part != part:
                    if shard is not None:
                        shard.finish()
                    shard = Shard(shared.value, part, rows)
                shard.read(conv, path, words)
                if len(rows) >= ROWS:
                    yield out()
        if shard is not None:
            shard.finish()
        if rows:
            yield out()

    dealt = ranges.select("part", "conv", "path", "words").repartitionByRange(parts, "part").sortWithinPartitions("part", "path", "conv")
    made = written(dealt.mapInArrow(run, FIELDS), "trie")
    release(paths, ranges)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = spark.createDataFrame(_finished(skeleton, made.where(F.col("kind") == PARTIAL)), "conv_id long, depth long, parent_conv_id long, skeleton long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = _hashed(made.where(F.col("kind") == ENDS))
    top = written(top.join(ends.hint("merge"), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "skeleton")
    parents = top.select(F.col("skeleton"), F.col("conv_id").alias("above")).hint("broadcast")  # the skeleton's size is bounded, see _skeleton
    local = made.where(F.col("kind") == NODE).join(parents, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*columns).unionByName(top.select(*columns))
