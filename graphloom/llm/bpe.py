"""BPE encoding and decoding by per-prefix dynamic programming."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a task remembers; the memory is emptied when it is full.
PIECES = 200_000


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file in the tokenizers library's JSON form.

    encode_piece keeps, for every prefix of a piece, the only token that the prefix's encoding can end
    with: of the vocabulary tokens that are suffixes of the prefix (an automaton finds them), the one that
    BPE leaves unmerged beside the last token of what is before it. The ids follow from back-pointers.
    """

    def __init__(self, path: str):
        import ahocorasick

        spec = json.load(open(path, encoding="utf-8"))
        byte = _byte_chars()
        raw = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in raw.items()} | {i: t.encode() for t, i in special.items()}
        self.rank = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[raw[a], raw[b]] = k, raw[a + b]
        self.single = [raw[bytes([b])] for b in range(256)]
        self.whole = {}
        self.beside = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in raw.items():
            if self._merged(t) == [i]:  # others never come out of BPE
                self.whole[t] = i
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.split = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        # the same pattern where all characters are ASCII
        self.ascii = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
        self.special = special
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: lowest rank first, leftmost among equals."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE of both tokens' bytes gives just these two tokens."""
        pair = a, b
        if (known := self.beside.get(pair)) is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            known = self.beside[pair] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (one := self.whole.get(data)) is not None:
            return [one]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0 and (end == n or last[end - n] >= 0 and self.fits(last[end - n], token)):
                last[end], size[end] = token, n
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.encode_piece(piece.encode())
        if len(self.known) >= PIECES:
            self.known.clear()
        out = ",".join(map(str, ids)), len(ids), b"".join(self.bytes_of[i] for i in ids)
        if len(piece) < 64:
            self.known[piece] = out
        return out

    def pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        """(ids joined by commas, their number, bytes they decode to) of each piece of a text."""
        get, made = self.known.get, self._piece
        if self.marks and any(t in text for t in self.special):
            out = []
            for part in self.marks.split(text):
                if part in self.special:
                    i = self.special[part]
                    out.append((str(i), 1, self.bytes_of[i]))
                else:
                    out += [get(p) or made(p) for p in self.split.findall(part)]
            return out
        return [get(p) or made(p) for p in (self.ascii if text.isascii() else self.split).findall(text)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.bytes_of[i] for i in ids if i in self.bytes_of).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once in a Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return id, n_tokens, ids_sha256, decoded_sha256.

    No row leaves its partition and no text is held beyond its batch. Null text counts as empty: 0 tokens
    and the digests of the empty string. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                n, ids_, texts = [], [], []
                for text in batch.column(1).to_pylist():
                    ids, count, back = zip(*got) if (got := c.pieces(text)) else ((), (), ())
                    n.append(sum(count))
                    ids_.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                    texts.append(hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, with the token ids of each text as `ids` (array of int)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return texts.map(c.encode)

    return docs.withColumn("ids", ids(F.coalesce(F.col(text_col), F.lit(""))))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of rows, with the text of each array of ids as `decoded`; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode([int(i) for i in x]))

    return rows.withColumn("decoded", text(ids_col))
