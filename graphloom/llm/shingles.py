"""Words and word windows of a batch of texts as 64-bit hashes (numpy helpers used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: Bytes that are hashed at once; a longer word takes a longer piece.
PIECE = 1 << 18
#: Rows and bytes of text that are worked on at once.
ROWS, BYTES = 1000, 4_000_000
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _POWERS[k] = np.r_[np.uint64(1), np.cumprod(np.full(n + n // 4, base, np.uint64))]
    return _POWERS


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWERED = _BYTE.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """The words of a batch: hashes, where each text's words begin (one more bound at the end), and each word's bytes in data."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def words_of(texts: list[bytes | None], lower: bool) -> Words:
    """Words (runs of bytes other than ASCII white space, A-Z lowered if asked) of all texts, hashed together.

    The hash of a word is a polynomial of its bytes, read off the prefix sums of a piece of text, so that no
    Python object is made of any word.
    """
    data = np.frombuffer(b"\n" + b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    first = 1 + np.r_[0, np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))]
    table = _LOWERED if lower else _BYTE
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:  # a piece ends after white space
            more = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = min(end + (int(more[0]) + 1 if len(more) else 4096), len(data))
        piece = data[at:end]
        word = ~_SPACE[piece]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.r_[0, edges]
        a, b = edges[0::2], edges[1::2]
        up, down = powers(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[piece] * up[: len(piece)], out=sums[1:])
            hashes.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD))
        starts.append(a + at), ends.append(b + at)
        at = end
    pos = np.concatenate(starts)
    return Words(np.concatenate(hashes), np.searchsorted(pos, first), pos, np.concatenate(ends), data)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of Arrow batches of bounded size, each with the texts of one column as bytes."""
    for batch in batches:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < ROWS and (size := size + len(texts[end] or b"")) <= BYTES:
                end += 1
            end = max(end, at + 1)
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash (a polynomial modulo 2**64) of every n consecutive hashes, scrambled; windows double in length."""
    if len(hashes) < n or n < 1:
        return np.empty(0, np.uint64)
    base = int(_ODD)
    with np.errstate(over="ignore"):
        have, done = None, 0
        part, size, left = hashes, 1, n
        while left:
            if left & 1:
                have = part.copy() if have is None else have[: len(part) - done] * np.uint64(pow(base, size, 1 << 64)) + part[done:]
                done += size
            left >>= 1
            if left:
                part = part[: len(part) - size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
                size *= 2
    return mix(have[: len(hashes) - n + 1])


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of hashes[start:end] for arrays of bounds, by prefix sums."""
    up, down = powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(hashes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of the whole sequence if it has fewer words."""
    words = words_of(texts, lower=True)
    every = windows(words.hashes, n)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        out.append(distinct(every[a : b - n + 1]) if b - a >= n else windows(words.hashes[a:b], b - a))
    return out
