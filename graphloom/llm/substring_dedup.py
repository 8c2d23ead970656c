"""Substring dedup by Rabin-Karp hashes of fixed-length word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, sized_join, written
from graphloom.llm.shingles import Words, sequence_hashes, slices, windows, words_of

WINDOW = 20
#: Words of the grams that stand for windows in the first count.
GRAM = 8
#: Repeated grams (one long each) up to which they are broadcast.
GRAMS = 4_000_000
#: Bytes of packed runs up to which they are broadcast.
BYTES = 64_000_000


def _least(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every n consecutive values and its place, the leftmost of equal ones; spans double in length."""
    size, v, at = 1, values, np.arange(len(values))
    while size < n:
        step = min(size, n - size)
        a, b = v[: len(v) - step], v[step:]
        right = b < a
        v, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        size += step
    return v, at


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, text, first window start among all words, windows) for each run of windows that share their smallest gram.

    The choice depends on a window's words only, so equal windows have equal grams wherever they stand.
    """
    starts = len(words.hashes) - window + 1
    if starts <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    least, at = _least(windows(words.hashes, gram), window - gram + 1)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = text[:starts] == text[window - 1 :]  # windows of one text
    new = np.r_[True, (at[1:starts] != at[: starts - 1]) | ~inside[: starts - 1]] & inside
    first = np.flatnonzero(new)
    run = np.cumsum(new)[inside] - 1
    return least[first], text[first], first, np.bincount(run, minlength=len(first))


def _run_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, key, row, start, n of each run of windows with one smallest gram; key hashes all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            words = words_of(texts, lower=False)
            g, text, first, n = anchors(words, window, gram)
            key = sequence_hashes(words.hashes, first, first + n + window - 1)
            row = batch.column(0).to_numpy(zero_copy_only=False)[text]
            start = (first - words.bounds[text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(key.view(np.int64)), pa.array(row), pa.array(start), pa.array(n.astype(np.int32))],
                names=["gram", "key", "row", "start", "n"],
            )

    return docs.select("row", "text").mapInArrow(run, "gram long, key long, row long, start int, n int")


def _per_row(runs: DataFrame) -> DataFrame:
    """row, runs: binary of int32 pairs (start, n), sorted; the pairs of one document meet, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(sorted({(r["start"], r["n"]) for r in x}), np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "runs"])

    return runs.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs")).mapInArrow(run, "row long, runs binary")


def _bytes_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on row with a written right side; broadcast if its counted bytes are few, else sort-merge."""
    size = right.agg(F.sum(F.length("runs") + 48)).first()[0] or 0
    return left.join(right.hint("broadcast" if size <= BYTES else "merge"), "row", how)


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """h, g (hashes), row, start of the windows in `runs` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            words = words_of(texts, lower=False)
            runs = [np.frombuffer(r, np.int32).reshape(-1, 2).astype(np.int64) for r in batch.column(2).to_pylist()]
            text = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            start, n = np.concatenate(runs).T
            of = np.repeat(text, n)
            at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            place = at + words.bounds[of]
            h, g = windows(words.hashes, window)[place], sequence_hashes(words.hashes, place, place + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 pa.array(batch.column(0).to_numpy(zero_copy_only=False)[of]), pa.array(at.astype(np.int32))],
                names=["h", "g", "row", "start"],
            )

    return docs.select("row", "text", "runs").mapInArrow(run, "h long, g int, row long, start int")


def cover(runs: bytes, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of the words that the windows of packed runs cover."""
    out: list[tuple[int, int]] = []
    for s, n in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist():
        end = s + n - 1 + window
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((s, end))
    return out


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row, runs (packed pairs of start and n) of the windows of each document that also start earlier.

    docs has row (long, in order of document) and text. Consecutive windows with the same smallest gram
    are a run. 1. Grams seen once in all rows belong to no repeated window; their runs go. 2. Runs with
    the same words are copies: all but the first repeat wholly. 3. Of grams whose runs differ, the first
    runs' windows are hashed one by one by Rabin-Karp, and all but the first place of a window repeat.
    Each count combines before the shuffle and each join may be split, so that a passage of very many
    documents never meets in one task.
    """
    runs = _run_rows(docs, window, gram)
    often = written(runs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    runs = written(sized_join(runs, often, "gram", "left_semi", GRAMS), "runs")
    firsts = written(runs.groupBy("gram", "key").agg(F.count("*").alias("c"), F.min(F.struct("row", "start", "n")).alias("first")), "firsts")
    copies = (
        runs.join(firsts.where("c > 1").select("gram", "key", "first").hint("merge"), ["gram", "key"])
        .where(F.struct("row", "start", "n") > F.col("first"))
        .select("row", "start", "n")
    )
    mixed = written(firsts.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "mixed")
    partly = written(_per_row(sized_join(firsts, mixed, "gram", "left_semi", GRAMS).select("first.*")), "partly")
    places = written(_window_rows(_bytes_join(docs, partly, "inner"), window), "windows")
    seen = places.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("row", "start")).alias("first")).where("c > 1").select("h", "g", "first")
    later = places.join(seen.hint("merge"), ["h", "g"]).where(F.struct("row", "start") > F.col("first")).select("row", "start", F.lit(1).alias("n"))
    out = written(_per_row(copies.union(later)), "repeated")
    release(often, runs, firsts, mixed, partly, places)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts earlier in the corpus.

    Words are runs of characters other than ASCII white space, unchanged; "earlier" is a smaller id, or
    the same document at an earlier start. Windows are judged on the input.

    Returns one row per input row: id, n_words, n_removed, spans (removed word intervals), kept (the words
    that stay, joined by one space). Null and empty texts have no words; a text with fewer words than a
    window stays whole. Ids are integers that name one text: repeated rows are one document and give equal
    results. Rows with a null id come after all others, in the order of a hash of their text; those of one text
    are one document. Ids of other types than whole numbers raise TypeError, those from 2**62 on are not
    told from nulls. An empty table gives an empty result; other columns are ignored. Exact but for collisions
    of 96-bit hashes.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = t.schema["id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint") and not re.fullmatch(r"decimal\(\d+,0\)", kind):
        raise TypeError(f"ids are {kind}, not whole numbers")
    last = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))  # from 2**62 on
    keyed = t.withColumn("row", F.coalesce(F.col("id").cast("long"), last))
    runs = repeated_runs(keyed.select("row", "text"), window, gram)

    kind_ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            total, gone, kept, cuts = [], [], [], []
            for text, cut in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if not cut:
                    cuts.append([]), total.append(len(words)), gone.append(0), kept.append(b" ".join(words))
                    continue
                stay, at = [], 0
                spans = cover(cut, window)
                for start, end in spans:
                    stay += words[at:start]
                    at = end
                stay += words[at:]
                cuts.append([{"start": a, "end": b} for a, b in spans])
                total.append(len(words)), gone.append(len(words) - len(stay)), kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, kind_), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "spans", "kept"],
            )

    full = _bytes_join(keyed, runs, "left").select("id", "text", "runs")
    return full.mapInArrow(run, f"id {kind}, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string").withColumnRenamed("id", id_col)
