"""The queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness."""
    from graphloom.llm.fingerprint import fingerprints

    return fingerprints(_docs(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed as repeats of an earlier 20-word window, and a digest of what is kept."""
    from graphloom.llm.substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir), 20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document for a mix by source weights."""
    from graphloom.llm.mixing import mix_to_weights

    return mix_to_weights(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in each text."""
    from graphloom.llm.pii import find_pii

    return find_pii(_docs(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each text."""
    from graphloom.llm.language import identify

    return identify(_docs(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts."""
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each document and whether the resampling selects it."""
    from graphloom.llm.quality import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    from graphloom.llm.html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    import public_tokenizers
    from graphloom.llm.bpe import bpe_digests

    return bpe_digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard similarity 0.9 or more."""
    from graphloom.llm.ngram_join import ngram_components

    return ngram_components(_docs(spark, sf_dir), 3, 90, 100)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first four components."""
    from graphloom.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4, 256)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's token ids, read from the files they were written to."""
    import public_tokenizers
    from graphloom.llm.token_files import token_digests, write_tokens

    return token_digests(write_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    from graphloom.llm.conversation_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 20, 4)


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq FROM p WHERE i + 19 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 20) AS t(j)),
g AS (SELECT p.doc_id, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN p.ws[p.i] END, ' ' ORDER BY p.i), '') AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  least(t.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = t.doc_id), t.doc_id)) AS component_id
FROM documents t LEFT JOIN n ON n.doc_id = t.doc_id
"""


#: crc32 is written out: eight shifts a byte.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.k - 4 AS o, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
p AS (SELECT c.conv_id, list({'role': r.role, 'text': r.text} ORDER BY r.o) FILTER (WHERE r.o IS NOT NULL) AS p FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
q AS (SELECT conv_id, coalesce(p, []) AS p, coalesce(len(p), 0) AS n FROM p),
m AS (SELECT conv_id, n, d, p[1:d] AS key, coalesce(p[d].text, '') AS last FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM q)),
w AS (SELECT conv_id, d, n, last, min(conv_id) OVER (PARTITION BY d, key) AS node FROM m),
g AS (
  SELECT node, d, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends,
    any_value(len(list_filter(string_split_regex(last, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
  FROM w GROUP BY node, d),
a AS (SELECT g.node, g.d, g.n_convs, g.words, x.d AS up, x.node AS top FROM g JOIN w x ON x.conv_id = g.node AND x.d <= g.d),
f AS (SELECT top, up, count(*) FILTER (WHERE d = up + 1) AS n_children FROM a GROUP BY top, up),
s AS (
  SELECT a.top, a.up, sum((a.n_convs - 1) * a.words) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
  FROM a JOIN f ON f.top = a.node AND f.up = a.d GROUP BY a.top, a.up)
SELECT g.node AS conv_id, CAST(g.d AS BIGINT) AS depth, y.node AS parent_conv_id, g.n_convs, f.n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN f ON f.top = g.node AND f.up = g.d JOIN s ON s.top = g.node AND s.up = g.d
LEFT JOIN w y ON y.conv_id = g.node AND y.d = g.d - 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_fingerprint, op2_substring_dedup, op3_mixing, op4_pii, op5_language, op6_exact_dedup, op7_quality, op8_html_text, op9_bpe, op10_ngram_join, op11_whitening, op12_token_files, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op2_substring_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op10_ngram_join": OP10_SQL, "op13_conversation_trie": OP13_SQL}
