"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams (1 to 3 characters).
DIMS = 4096
#: Centroids per language; about so many documents per language, drawn by a hash of the text, fit them (the bound of the sample).
CENTROIDS = 4
SAMPLE = 2000
#: A prediction is marked as rejected if its cosine is below this share of what the training documents reach.
REJECT = 0.5
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of the lowered text, digits and white space unified."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c <= 32) | (c == 160), 32, c)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    out = np.zeros(DIMS)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, 4):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            out += np.bincount(((h * odd) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (logarithmic term frequency)."""
    x = np.log1p(np.array([counts(t) for t in texts]).reshape(-1, DIMS)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of normalised rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    """Centroids by row, their languages, the IDF weights and each language's usual cosine."""

    languages: list[str]
    of: np.ndarray
    centre: np.ndarray
    idf: np.ndarray
    usual: np.ndarray

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of each text's nearest centroid."""
        s = vectors(texts, self.idf) @ self.centre.T
        best = s.argmax(axis=1)
        return self.of[best], s[np.arange(len(best)), best]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", k: int = CENTROIDS, sample: int = SAMPLE) -> Model | None:
    """Fit on rows of docs that have a language and a letter; None if there are none.

    Document frequencies cover all of them; the centroids are fitted on `sample` documents per language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit(5)).alias("h")
    )

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df += counts(t) > 0
                n += 1
        yield pd.DataFrame({"dim": np.r_[np.arange(DIMS), -1], "n": np.r_[df, n]})

    n = np.zeros(DIMS + 1, np.int64)
    for r in known.select("text").mapInPandas(frequency, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        n[r["dim"]] = r["n"]
    if not n[-1]:
        return None
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "text"])
        x = vectors(rows["text"].tolist(), idf)
        c = centroids(x, k)
        usual = float(np.median((x @ c.T).max(axis=1)))
        return pd.DataFrame({"lang": key[0], "j": np.arange(len(c)), "usual": usual, "centre": list(c.astype(np.float32))})

    spread = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect()  # a row per language
    share = F.create_map(*[x for r in spread for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.2 * sample / r["n"])))])
    # equal texts have equal hashes: one row of each, so that a text of very many copies is one row of a group
    drawn = known.where(F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    got = drawn.groupBy("lang").applyInPandas(one, "lang string, j int, usual double, centre array<float>").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["j"]))
    names = sorted({r["lang"] for r in got})
    return Model(names, np.array([names.index(r["lang"]) for r in got]), np.array([r["centre"] for r in got]), idf, np.array([next(r["usual"] for r in got if r["lang"] == m) for m in names]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine, 0 to 1), rejected.

    The nearest centroid's language; `und` with score 0 if the text is null or has no letter, or if the
    model is None. rejected: the cosine is below REJECT times the language's usual one, or no prediction.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = b.column(1).to_pylist()
                ok = np.array([m is not None and t is not None and _LETTER.search(t) is not None for t in texts], bool)
                lang, score, far = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if ok.any():
                    of, s = m.predict([t for t, o in zip(texts, ok, strict=True) if o])
                    lang[ok], score[ok], far[ok] = np.array(m.languages, object)[of], np.clip(s, 0, 1), s < REJECT * m.usual[of]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(far)], names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict every row: id, held_out, lang_pred, score, rejected.

    Repeated rows get equal results; rows without a language are predicted but not learned from; an empty
    table gives an empty result; of the other columns only `lang_col` is read, for learning.
    """
    model = fit(docs.where(~held_out(id_col)), lang_col, id_col, text_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
