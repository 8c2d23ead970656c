"""Quality classifier by importance resampling of hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sized_join, uniform, written
from graphloom.llm.shingles import mix, slices, windows, words_of

#: Hash buckets of the word 1- and 2-grams.
BUCKETS = 1 << 14
#: The target's model is smoothed by the raw one's, which counts as so many times the target's grams.
PRIOR = 0.5
SEED = 7


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-grams and of the 2-grams of a batch of texts, and the bounds of each text's among them."""
    words = words_of(texts, lower=True)
    a, b = words.bounds[:-1], words.bounds[1:]
    one = (mix(words.hashes) % np.uint64(BUCKETS)).astype(np.int64)
    two = (windows(words.hashes, 2) % np.uint64(BUCKETS)).astype(np.int64)
    return one, two, np.stack([a, b]), np.stack([np.minimum(a, len(two)), np.minimum(np.maximum(b - 1, a), len(two))])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for the bounds of each text."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[bounds[1]] - total[bounds[0]]


def gram_models(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio of each bucket's probability in the target texts, smoothed by that in all texts, to the latter.

    docs has id and text, target the ids of the target documents. Every text is counted; a task adds up
    its own counts and sends one row per bucket, and the driver holds two numbers per bucket.
    """
    marked = sized_join(docs, target.select("id", F.lit(True).alias("good")), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch, texts in slices(batches, 0):
            is_good = batch.column(1).to_numpy(zero_copy_only=False)
            one, two, at_one, at_two = grams(texts)
            for f, (a, b) in ((one, at_one), (two, at_two)):
                step = np.zeros(len(f) + 1, np.int64)  # +1 where a text's grams begin, -1 where they end
                np.add.at(step, a, 1), np.add.at(step, b, -1)
                raw += np.bincount(f[np.cumsum(step)[:-1] > 0], minlength=BUCKETS)
                step[:] = 0
                np.add.at(step, a[is_good], 1), np.add.at(step, b[is_good], -1)
                good += np.bincount(f[np.cumsum(step)[:-1] > 0], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    counts = np.zeros((2, BUCKETS))
    total = marked.mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    for r in total.toPandas().itertuples(index=False):  # BUCKETS rows at most
        counts[:, r.bucket] = r.raw, r.good
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    raw = (counts[0] + 1) / (counts[0].sum() + BUCKETS)
    prior = PRIOR * counts[1].sum()
    return np.log((counts[1] + prior * raw) / (counts[1].sum() + prior)) - np.log(raw)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a written table's column, by histograms that narrow; no sort, a row per bin to the driver."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while True:
        step = (high - low) / bins
        if step <= 0 or low + step <= low:
            return low
        at = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        got = {r["b"]: r for r in df.where(F.col(col).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()}
        for b in sorted(got, reverse=True):
            if k <= got[b]["n"]:
                break
            k -= got[b]["n"]
        if (got[b]["low"], got[b]["high"]) == (low, high):
            return low if k > 1 else high
        low, high = got[b]["low"], got[b]["high"]
        if low == high:
            return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score documents by how much more likely the target's n-grams make them, and draw the best by Gumbel top-k.

    The target texts are those with a label of quality 1 and toxic 0; the raw texts are all. A document's
    log weight is the log ratio of its likelihoods under the two models, the sum over its grams; with Gumbel
    noise (from id and seed) added, the k largest keys are a sample without replacement by weight. k is `share` of the documents that have
    a word; by default the share of labelled documents with quality 1.

    Returns one row per input row: id, log_weight, key, selected, and the columns of `keep`. A text without words has null weight and
    is not selected; without labels all weights are 0 and all documents with words are selected; ties with
    the k-th key are all selected; repeated rows get equal results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    kept = rows.columns[2:]
    labels = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("quality is not null")
    target = written(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and id is not null").select("id").distinct(), "target")
    if share is None:
        n, good = labels.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("int"))).first()
        share = good / n if n else 1.0
    ratio = docs.sparkSession.sparkContext.broadcast(gram_models(rows, target).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            one, two, at_one, at_two = grams(texts)
            total = _sums(ratio.value[one], at_one) + _sums(ratio.value[two], at_two)
            weight = pa.array(total, mask=at_one[0] == at_one[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), weight, *batch.columns[2:]], names=["id", "log_weight", *kept])

    kind = rows.schema["id"].dataType.simpleString()
    noise = -F.log(-F.log(uniform("id", F.lit(seed)) + F.lit(2.0**-54)))
    scored = written(rows.mapInArrow(run, ", ".join([f"id {kind}, log_weight double", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]])).withColumn("key", F.col("log_weight") + noise), "scored")
    n = scored.where("key is not null").count()
    k = round(share * n)
    low = kth_largest(scored.where("key is not null"), "key", k) if 0 < k else float("inf")
    return scored.select(F.col("id").alias(id_col), "log_weight", "key", F.coalesce(F.col("key") >= F.lit(low), F.lit(False)).alias("selected"), *[F.col(c).alias(k) for c, k in zip(kept, keep, strict=True)])
