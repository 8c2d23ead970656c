"""Whitening, token files and the conversation trie against plain rules, with nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df, names):
    for c in names:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


# -- whitening


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(n=90, width=6, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) @ rng.normal(size=(width, width))
    rows = [(k, [float(c) for c in v], k % 3) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[k % 4][1], 0) for k in range(40)]  # a hot vector
    rows += [(None, rows[5][1], 1), (7, rows[7][1], 1)]
    return rows


ODD = [(2000, None, 0), (2001, [], 0), (2002, [1.0] * 5 + [None], 0), (2003, [math.nan] * 6, 0), (2004, [math.inf] + [0.0] * 5, 0), (2005, [1.0, 2.0], 0)]


def plain_whitening(rows, k):
    x = [(i, tuple(math.floor(256 * c) for c in v)) for i, v, _ in rows]
    fit = np.array(sorted({v for _, v in x}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    values, vecs = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    total = np.trace(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    out = []
    for i, v in x:
        w = (np.array(v) - fit.mean(0)) @ vecs / np.sqrt(values)
        d = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        out += [(i, c + 1, n, d, w[c], values[c] / total) for c in range(k)]
    return out


def test_whitening(spark):
    from graphloom.llm.whitening import whiten

    rows = vectors()
    df = clashing(spark.createDataFrame(rows + ODD, VECTORS), ("x", "id", "n", "component", "width", "i", "v")).repartition(5)
    got = whiten(df).collect()
    want = plain_whitening(rows, 4)
    assert len(got) == len(want) and all(r.identity_error < 1e-9 for r in got)
    key = lambda i, c, d: (-1 if i is None else i, c, d)
    got.sort(key=lambda r: key(r.vec_id, r.component, r.deviation))
    want.sort(key=lambda r: key(r[0], r[1], r[3]))
    sign = {}
    for r, (i, c, n, d, w, e) in zip(got, want, strict=True):
        assert (r.vec_id, r.component, r.n, r.deviation) == (i, c, n, d)
        assert abs(r.explained - e) < 1e-10
        s = sign.setdefault(c, 1 if abs(r.whitened - w) < abs(r.whitened + w) else -1)
        assert abs(r.whitened - s * w) < 1e-8


def test_whitening_edges(spark):
    from graphloom.llm.whitening import whiten

    assert whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame(ODD[:-1], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(1, [0.5, 0.25], 0)] * 3, VECTORS)).collect() == []  # one distinct vector has no spread
    flat = [(k, [k / 256, 2 * k / 256, 1.0], 0) for k in range(5)]  # one direction only
    got = whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(k, 1) for k in range(5)] and all(abs(r.explained - 1) < 1e-12 for r in got)
    huge = [(k, [1e300 * (-1) ** k, float(k)], 0) for k in range(4)]  # floor ends at the ends of long, the deviation is beyond it
    assert {r.deviation for r in whiten(spark.createDataFrame(huge, VECTORS)).collect()} == {None}


@pytest.mark.parametrize("width,n", [(1, 9), (5, 80), (9, 4), (33, 200)])
def test_eigen(width, n):
    from graphloom.llm.whitening import eigen, pivoted_cholesky

    x = np.random.default_rng(width).normal(size=(n, width))
    x -= x.mean(0)
    v = x.T @ x / n
    factor, order = pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v[order][:, order], atol=1e-12) and not np.triu(factor, 1).any()
    values, vecs = eigen(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-10) and np.allclose(vecs.T @ vecs, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ vecs, vecs * values, atol=1e-12)


# -- token files


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return path, lambda t: [*(tok.encode(t, add_special_tokens=False).ids if t else []), 1]


PARTS = ["a", "Don't", "'s", "we'll", "É", "ß", "Ÿ", "×", "--", "<|endoftext|>", "<|", "\n", " ", " ", " ", "́", "İ", "日本", "я", "\x1c", "\x85", "\x00", "1", "42", "...", "²", "ﬁ", " ", "K", "!?"]


def test_unit_encoder(tokens):
    from graphloom.llm.token_files import UnitEncoder

    path, encode = tokens
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "x" * 5000]
    encoder = UnitEncoder(path, 1)
    for k in range(0, len(texts), 500):
        ids, counts = encoder.encode([t.encode() for t in texts[k : k + 500]])
        at = 0
        for t, n in zip(texts[k : k + 500], counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == encode(t), t
            at += n


def test_grammar_round_trip():
    from graphloom.llm.token_files import Shard, packed

    rng = np.random.default_rng(4)
    for k in range(60):
        ids = np.repeat(rng.integers(0, int(rng.choice([1, 3, 9, 70_000])) + 1, rng.integers(0, 900)), rng.integers(1, 5)).astype(np.uint32)
        shard = Shard(packed(ids))
        assert (shard.ids() == ids).all() and shard.n_ids == len(ids)
        for _ in range(8):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (Shard(packed(ids)).part(a, b) == ids[a:b]).all()
    repeated = np.tile(rng.integers(0, 500, 400), 200).astype(np.uint32)
    assert len(packed(repeated)) < len(repeated) / 4 and len(Shard(packed(repeated)).rules)


def test_token_files(spark, tokens):
    from graphloom.llm.token_files import read_tokens, token_digests, write_tokens

    path, encode = tokens
    rng = random.Random(6)
    words = ["one", "Two,", "três", "naïve", "x1y22"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "long " * 20_000), (None, "no id"), (-5, "first")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ("ids", "counts", "part", "shard", "value", "id", "start"))
    shards = write_tokens(df, path, shard=500)
    assert shards.count() > 4
    got = sorted(token_digests(shards).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = encode(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wanted = spark.createDataFrame([(3,), (203,), (201,), (999,), (3,)], "k long")
    assert {r.doc_id: r.ids for r in read_tokens(shards, wanted).collect()} == {i: encode(t) for i, t in rows if i in (3, 203, 201)}


def test_token_files_edges(spark, tokens):
    from graphloom.llm.token_files import token_digests, write_tokens

    path, encode = tokens
    assert token_digests(write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)).collect() == []
    hot = [("same", f"text {k % 7}") for k in range(60)] + [("other", "x")]  # string ids, one of which repeats
    got = token_digests(write_tokens(spark.createDataFrame(hot, "doc_id string, text string"), path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in hot)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


# -- conversation trie


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - c % 20, [])[:h] + path[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def turns_of(seed=8):
    rng = random.Random(seed)
    rows = []
    for c in range(260):
        hot = c % 3 == 0
        for k in range(rng.randint(1, 7)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"hot turn {k}" if hot else f"t {rng.randint(0, 2)} of  {k}"))
    rows += [(300, None, "user", "null turn first"), (300, 0, None, None), (301, 0, "", ""), (301, 0, "", ""), (302, 5, "a", "tie"), (302, 5, "b", "tie"), (None, 0, "user", "no id")]
    rows += [(400, k, "user", f"deep {k % 3}") for k in range(300)] + [(403, k, "user", f"deep {k % 3}") for k in range(300)]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_conversation_trie(spark, parts):
    from graphloom.llm.conversation_trie import conversation_trie

    rows = turns_of()
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(5), ("path", "conv", "part", "words", "base", "depth", "skeleton", "kind"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = conversation_trie(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == plain_trie(rows)


def test_ends_in_pieces(spark, monkeypatch):
    from graphloom.llm import conversation_trie as module

    monkeypatch.setattr(module, "PIECE", 3)  # in the driver; tasks import their own
    rows = [(c, 0, "user", "same") for c in range(500)]
    got = module.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs, r.ends_sha256) for r in got) == [(a, b, d, h) for a, b, _, d, _, _, _, h in plain_trie(rows)]


def test_trie_of_nothing(spark):
    from graphloom.llm.conversation_trie import conversation_trie

    assert conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []
    one = conversation_trie(spark.createDataFrame([(5, 0, "user", "x")], TURNS)).collect()  # h of 5 is not 0: its only turn is dropped
    assert sorted((r.conv_id, r.depth, r.n_leaves) for r in one) == [(a, b, f) for a, b, _, _, _, f, _, _ in plain_trie([(5, 0, "user", "x")])]


# -- ids of any type in the n-gram join


@pytest.mark.parametrize("kind", ["decimal(10,2)", "date"])
def test_ngram_join_of_other_ids(spark, kind):
    from graphloom.llm.ngram_join import ngram_components

    same = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{same} x{k}" if k % 2 else f"other {k} text") for k in range(30)] + [(40, None), (41, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id int, text string"), ("id", "size", "home", "pure", "part", "sig", "node", "class", "component"))
    df = df.withColumn("doc_id", F.expr("date_add(date'2020-01-01', doc_id)") if kind == "date" else F.col("doc_id").cast(kind))
    groups = defaultdict(int)
    for r in ngram_components(df, 3, 90, 100).collect():
        groups[r.component_id] += 1
    assert sorted(groups.values())[-2:] == [1, 15] and sum(groups.values()) == 32


def test_mixing_reruns_agree_without_ids(spark):
    from graphloom.llm.mixing import mix_to_weights

    rows = [(None, f"w{i % 40} " * (1 + i % 9), "a" if i % 3 else "b") for i in range(300)] + [(7, "x y z", "a")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = lambda df: sorted(map(str, mix_to_weights(df).select("doc_id", "source", "size", "taken").collect()))
    one = takes(docs.repartition(2))
    assert one == takes(docs.repartition(5, "text")) == takes(docs.orderBy(F.desc("text")).coalesce(1))
    assert len(one) == 500
