"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["The", "the", "été", "naïve,", "x."]
    passage = " ".join(rng.choice(words) for _ in range(45))
    out = []
    for k in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if k % 5 == 0:
            text = f"{text} {passage}\n{' '.join(rng.choice(words) for _ in range(9))}"
        if k % 7 == 0 and out:
            text = rng.choice(out)[1] or ""
        if k % 11 == 0 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[len(w) // 2] = "edit"
            text = " ".join(w)
        out.append((k, text, ["en", "fr", None][k % 3], f"s{k % 4}" if k % 9 else None, len(text)))
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n", "en", "s1", 3), (203, "a a " * 400, "en", "s1", 1600), (204, "long " + "z" * 60_000, "en", "s2", 60_005)]
    out += [(205, "tie tie tie", "en", "s0", 11), (206, "TIE tie  tie", "en", "s0", 12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, EMPTY)
    for c in ("id", "row", "run", "digest", "key", "kept", "size", "sig", "component", "_id", "part", "head"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def paragraph_set(text):
    """Paragraphs with the number of their repeat, by plain rules: line breaks, sentence ends, words whose own hash cuts."""
    from graphloom.llm.fingerprint import CUT
    from graphloom.llm.shingles import words_of

    out, held, seen = set(), [], defaultdict(int)
    for line in re.split("\n", text):
        for w in [*WORD.findall(line), None]:
            if w is not None:
                held.append(w)
            if held and (w is None or w[-1] in ".!?" or int(words_of([w.encode()], False).hashes[0]) % CUT == 0):
                p, held = tuple(held), []
                out.add((p, seen[p]))
                seen[p] += 1
    return out


def alike(x, y):
    a, b = paragraph_set(x), paragraph_set(y)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(spark, docs, rows, nothing):
    from graphloom.llm.fingerprint import fingerprints

    got = by_id(fingerprints(docs))
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        new = text[: len(text) - n] + other[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), sha(new))
        assert got[i].near_edited == pytest.approx(alike(text, new)) and got[i].near_next == pytest.approx(alike(text, other))
        assert int(got[i].fingerprint.split(":")[0]) == len(paragraph_set(text))
        prints[text].add(got[i].fingerprint), prints[new].add(got[i].edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) > 100
    assert fingerprints(nothing).count() == 0
    strings = fingerprints(docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))).collect()
    assert {(int(r.doc_id[1:]), *r[1:]) for r in strings} == {tuple(r) for r in got.values()}


BIG = (1 << 60) + 1


def test_ids_are_exact_beside_nulls(spark, sf_dir):
    import public_tokenizers
    from graphloom.llm.bpe import bpe_digests
    from graphloom.llm.fingerprint import fingerprints
    from graphloom.llm.html_text import extract
    from graphloom.llm.language import identify
    from graphloom.llm.ngram_join import ngram_components
    from graphloom.llm.quality import resample
    from graphloom.llm.substring_dedup import substring_dedup

    rows = [(BIG, "a. b. c."), (BIG + 2, "a. b. c."), (None, "x"), (None, "z"), (2, None), (BIG, "a. b. c.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "url": F.lit(None).cast("string")}).coalesce(1)
    want = sorted(str(r[0]) for r in rows)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for out in (fingerprints(d), identify(d), resample(d, labels), bpe_digests(d, public_tokenizers.path("byte_bpe_50k.json")), extract(d, "doc_id", "url", "text"), substring_dedup(d), ngram_components(d)):
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == want
        assert len({str(r) for r in got if r.doc_id == BIG}) == 1 or "fingerprint" in out.columns
    got = {r.doc_id: r for r in ngram_components(d).where("doc_id is not null").collect()}
    assert got[BIG + 2].component_id == BIG and got[2].component_id == 2 and got[2].n_shingles == 0


def test_fingerprints_of_odd_rows(spark):
    from graphloom.llm.fingerprint import fingerprints

    d = spark.createDataFrame([(1, "a. b. c."), (1, "a. b. c."), (None, "x"), (2, "y"), (None, None)], "doc_id long, text string")
    got = fingerprints(d).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 8), ("1", 8), ("2", 1), ("None", 0), ("None", 1)]
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0]  # the next of 2 is 1, of 1 is 1, then a null id
    one = fingerprints(d.where("doc_id = 2")).collect()
    assert len(one) == 1 and (one[0].near_next, one[0].near_edited) == (1.0, 1.0)


def test_peeling_recovers_differences():
    import numpy as np
    from graphloom.llm.fingerprint import Batch, Sketches

    texts = [" ".join(f"Sentence number {k}." for k in r).encode() for r in (range(300), range(5, 420), range(0), range(298))]
    b = Batch(texts)
    assert b.sizes[2] == 0 and b.sizes[0] >= 300
    only, lacks = b.differences(np.array([0, 0, 1, 2]), b, np.array([1, 3, 1, 0]))
    sets = [set(b.keys[b.bounds[k] : b.bounds[k + 1]].tolist()) for k in range(4)]
    assert only.tolist() == [len(sets[0] - sets[1]), len(sets[0] - sets[3]), 0, 0]
    assert lacks.tolist() == [len(sets[1] - sets[0]), 0, 0, len(sets[0])]
    rest = b.sketches(np.array([0]), np.array([512])).minus(b.sketches(np.array([3]), np.array([512])))
    keys, _, signs, empty = rest.peel()
    assert empty.all() and set(keys.tolist()) == sets[0] - sets[3] and (signs == 1).all()
    small = b.small.pick(np.array([0]), 16)
    assert not small.peel()[3].any() and isinstance(small, Sketches)  # too small: the caller retries larger


def brute_substring(rows, w):
    seen, out = {}, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - w + 1):
            seq = tuple(words[s : s + w])
            if seq in seen:
                gone.update(range(s, s + w))
            else:
                seen[seq] = (i, s)
        out[i] = (len(words), len(gone), sha(" ".join(x for k, x in enumerate(words) if k not in gone)))
    return out


def test_substring_dedup(docs, rows, nothing):
    from graphloom.llm.substring_dedup import substring_dedup

    got = substring_dedup(docs, 20).collect()
    want = brute_substring(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r.kept)) for r in got} == want
    assert any(v[1] for v in want.values())
    assert substring_dedup(nothing, 20).count() == 0


def test_mixing(docs, rows, nothing):
    from graphloom.llm.mixing import mix_to_weights, source_targets

    got = mix_to_weights(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_to_weights(docs).collect()))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    per, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        per[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, cap, free = sum(per.values()), {}, set(names)
    while True:
        level = (total - sum(cap.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 3 * per[s] < level * weight[s]}
        if not over:
            break
        free -= over
        cap |= {s: 3 * per[s] for s in over}
    want = {s: cap.get(s, level * weight[s]) for s in names}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == per[r.source]
    for s in names:
        assert abs(taken[s] - want[s]) <= most[s]
    assert mix_to_weights(nothing).count() == 0 and source_targets(nothing.select("source", F.lit(1).cast("long").alias("size"))).count() == 0


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def base_spans(t):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        n = re.sub(r"[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 14 <= len(n) <= 19 and luhn(n), "phone": lambda: 10 <= len(n) <= 15}[kind]()

    found = [(m.start(), k, m.end()) for k, (kind, form) in enumerate(forms.items()) for m in re.finditer(form, t) if ok(kind, m.group())]
    return ",".join(f"{list(forms)[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pii(spark, docs, nothing):
    from graphloom.llm.pii import find_pii

    rng = random.Random(5)
    texts = ["".join(rng.choice("a1.2-@+ 3(4)5_éb9.25\n0") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [None, "", "a@b.c_x@d.e 4111 1111-1111 1111 é +1 (555) 123-4567, 1.2.3.4.5.6.7.8 001.0255.3.4 256.1.1.1", "1" * 5000 + " " + "a." * 4000 + "@x.y" + ".z" * 3000]
    texts += [f"word{k} my login code is zz{k}yy@ok.com thanks and bye" for k in range(12)] + ["so my login code is zx9q81-77 thanks and bye"]
    got = by_id(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, t in enumerate(texts):
        base = base_spans(t or "")
        assert got[k].base_sha256 == sha(base)
        assert not base or set(base.split(",")) <= set(got[k].spans.split(","))
    assert got[len(texts) - 1].spans == "email:20:29" and got[len(texts) - 1].n_found == 1
    assert find_pii(docs).count() == 127 and find_pii(nothing).count() == 0


def test_pii_found_entities_induce_patterns(spark):
    from graphloom.llm.pii import find_pii

    texts = [f"please write to u{k}@mail.org soon" for k in range(20)]
    texts += [f"please write to acct#{k:05d}x soon" for k in range(6)]  # the context of the base matches
    texts += [f"signed off by acct#{k:05d}x yesterday" for k in range(6)] + ["signed off by acct#99999y yesterday"]  # a context of found ones only
    texts += [f"page numbered {k}00000 ends" for k in range(20)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].n_found for k in range(53)] == [0] * 20 + [1] * 13 + [0] * 20
    assert got[32].spans == "email:14:25" and got[32].n_email == 0


def test_language(spark, sf_dir, docs, nothing):
    from graphloom.llm.language import identify

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = by_id(identify(d))
    truth = {r.doc_id: r for r in d.collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.93
    odd = by_id(identify(docs))
    assert [odd[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd.values())
    assert identify(nothing).count() == 0


def test_exact_dedup(spark, docs, rows, nothing):
    from graphloom.llm.exact_dedup import drop_exact_copies, exact_dedup

    got = by_id(exact_dedup(docs))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g}
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in got.items()} == want
    assert sorted(r.doc_id for r in drop_exact_copies(docs).collect()) == sorted(min(g) for g in groups.values())
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    assert exact_dedup(twice).where("kept").count() == 2
    assert sorted(str(r.doc_id) for r in drop_exact_copies(twice).collect()) == ["1", "None"]
    assert exact_dedup(nothing).count() == 0


def brute_weights(rows, target):
    """Log ratio of the two gram models, gram by gram, in plain Python."""
    import math

    from graphloom.llm.quality import BUCKETS, PRIOR, grams

    raw, good, per = defaultdict(int), defaultdict(int), {}
    for r in rows:
        one, two, _, _ = grams([(r.text or "").encode()])
        per[r.doc_id] = [*one.tolist(), *two.tolist()]
        assert len(one) == len(WORD.findall(r.text or "")) and len(two) == max(0, len(one) - 1)
        for b in per[r.doc_id]:
            raw[b] += 1
            good[b] += r.doc_id in target
    n, m = sum(raw.values()), sum(good.values())
    p = {b: (raw[b] + 1) / (n + BUCKETS) for b in raw}
    ratio = {b: math.log((good[b] + PRIOR * m * p[b]) / (m + PRIOR * m)) - math.log(p[b]) for b in raw}
    return {i: sum(ratio[b] for b in bs) if bs else None for i, bs in per.items()}


def test_quality(spark, sf_dir, docs, nothing):
    from graphloom.llm.quality import kth_largest, resample

    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = by_id(resample(d, labels))
    truth = labels.collect()
    good = [got[r.doc_id].selected for r in truth if r.quality == 1 and r.toxic == 0]
    assert sum(good) / len(good) > 0.97
    big = sf_dir.replace("0.001", "0.1")  # held-out labels: fitted on the even ids, judged on the odd ones
    d_big, l_big = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    chosen = {r.doc_id: r.selected for r in resample(d_big, l_big.where("doc_id % 2 = 0")).collect()}
    held = l_big.where("doc_id % 2 = 1").collect()
    good = [chosen[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    bad = [chosen[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
    weights = brute_weights(d.collect(), {r.doc_id for r in truth if r.quality == 1 and r.toxic == 0})
    for i, w in weights.items():
        assert (got[i].log_weight is None) == (w is None) and (w is None or got[i].log_weight == pytest.approx(w, abs=1e-3, rel=1e-4))
    keys = sorted((r.key for r in got.values() if r.key is not None), reverse=True)
    share = sum(r.quality == 1 for r in truth if r.quality is not None) / sum(r.quality is not None for r in truth)
    low = keys[round(share * len(keys)) - 1]
    assert all(r.selected == (r.key is not None and r.key >= low) for r in got.values())
    twice = resample(d.union(d), labels).collect()  # ties at the k-th key: equal rows go the same way
    assert len({(r.doc_id, r.selected) for r in twice}) == len(got)
    no_labels = by_id(resample(docs, labels.where("false")))
    assert not no_labels[200].selected and no_labels[203].selected
    assert resample(nothing, labels).count() == 0
    v = [random.Random(k).choice([1.0, 2.5, -3.0, k / 7]) for k in range(500)]
    t = spark.createDataFrame([(x,) for x in v], "x double")
    assert [kth_largest(t, "x", k) for k in (1, 2, 250, 500)] == [sorted(v, reverse=True)[k - 1] for k in (1, 2, 250, 500)]


PAGE = "<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div>{0}<article><h1>Head &amp; more</h1><p><b>One&nbsp;&lt;x&gt;<br><p>Two {1}<!-- c --></article><div id=comments>Nice</div><footer>&copy; me</footer>"


def test_html(spark, sf_dir):
    from graphloom.llm.html_text import extract

    pages = [(k, f"http://h.example/{k}", PAGE.format("<div class=box>Same on all pages</div>", f"page {k}")) for k in range(30)]
    pages += [(100, None, None), (101, "x", ""), (102, "http://o.example/", PAGE.format("<div class=lead>Only here</div>", "&")[:-20]), (103, "http://p.example", "<p>" + "deep <i>" * 3000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in extract(d).collect()}
    assert got[3].text == "Head & more One <x> Two page 3" and got[3].n_chars == len(got[3].text)
    assert got[100].text == "" == got[101].text and got[102].text == "Only here Head & more One <x> Two &"
    assert got[103].text.startswith("deep deep") and extract(d.where("false")).count() == 0
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert extract(real).count() == real.count()


LAYOUTS = ["single has-sidebar", "content with-sidebar", "page no-sidebar", "post no-comments", "comments-open", "elementor-widget-container", "article-header", "widget"]


def test_html_keeps_articles_in_marked_branches(spark):
    from graphloom.llm.html_text import extract

    def text(k):
        return f"Story {k} with words of its own w{k * 7}"

    shapes = [
        "<body class='{0}'><article><h1>Head {2}</h1><p>{1}</article><div class=menu>Go</div>",
        "<body><article class='{0}'><h1>Head {2}</h1><p>{1}</article><aside>Go</aside>",
        "<body><div class='{0}'><h1>Head {2}</h1><p>{1}</div><div class='sidebar left'>Go</div>",
        "<body><form><div id=page class='{0}'><main><h1>Head {2}</h1><p>{1}</main></div></form><div role=navigation>Go</div>",
        "<body><article><h1>Head {2}</h1><div class=header>{1}</div></article><div class=header>Go</div><div class=comments><article>Go</article></div>",
    ]
    pages, want = [], {}
    for a, shape in enumerate(shapes):
        for b, name in enumerate(LAYOUTS):
            for k in range(12):  # hosts whose tree counts, and hosts of a single page
                host, i = f"h{a}-{b}" if k < 10 else f"h{a}-{b}-{k}", len(pages)
                pages.append((i, f"http://{host}/{k}", shape.format(name, text(i), i)))
                want[i] = f"Head {i} {text(i)}"
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(d).collect()}
    assert got == want


def test_html_confirms_doubtful_marks(spark):
    from graphloom.llm.html_text import extract

    page = "<body><div class=site-footer>Always the same {2}</div><div class=entry-header>Lead {0}</div><article><p>Story {0}</p><div class=share-links>Tell all</div></article>{1}"
    pages = [(k, "http://many/", page.format(k, "", k % 2)) for k in range(20)] + [(50, "http://one/", page.format(50, "", 0))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Lead 3 Story 3" and got[50] == "Always the same 0 Lead 50 Story 50 Tell all"


def test_html_judges_deep_blocks(spark):
    from graphloom.llm.html_text import extract

    div = "<body><div id=page><div class=wrap><div class=row><div class=col><div class=box>Join us</div><div class=text><h2>Head {0}</h2><p>Story {0}</p></div><ul><li>Go<li>Up</ul></div></div></div></div>"
    held = "<body><div id=page><div class=wrap><div class=row><div class=col><div>Join us</div><article><p>Same in all</p></article></div></div></div></div>"
    pages = [(k, "http://div/", div.format(k)) for k in range(20)] + [(k, "http://held/", held) for k in range(20, 40)] + [(40, "x", "<body>" + "<div>" * 2000 + "deep")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 Story 3" and got[25] == "Same in all" and got[40] == "deep"


def test_bpe(spark, docs, rows, nothing):
    import public_tokenizers
    from graphloom.llm.bpe import bpe_decode, bpe_digests, bpe_encode
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = [t for _, t, *_ in rows] + ["".join(rng.choice("ab eé'sS\n\t 12  $%<|endoftext|> 日本 ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>  ", "ab" * 1500, "\x1c\x85b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit(0))
    t = Tokenizer.from_file(path)
    got = by_id(bpe_digests(d, path))
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    back = bpe_decode(bpe_encode(d, path), path).where("not decoded <=> coalesce(text, '')")
    assert back.count() == 0 and bpe_digests(nothing, path).count() == 0


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = sorted((top(a), top(b)))
                at[v] = u
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_ngram_components(spark, rows, nothing, n, num):
    from graphloom.llm.ngram_join import ngram_components

    rng = random.Random(n)
    base = [f"v{k}" for k in range(60)]
    near = []
    for k in range(150):  # a chain of edits and a crowd of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        near.append((1000 + k, " ".join(w), None, None, 0))
    every = rows + near
    got = by_id(ngram_components(spark.createDataFrame(every, EMPTY).repartition(3), n, num, 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(every, n, num, 100)
    assert ngram_components(nothing, n, num, 100).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    raw = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in P.exact(spark, docs, sf_dir).collect()]
    first = {}
    for r in sorted(raw):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r[0])
    assert sorted(r[0] for r in kept) == sorted(first.values())
    comp = brute_components(raw, P.WORDS, P.SIMILAR, 100)
    assert sorted(r.doc_id for r in P.near(spark, docs, sf_dir).collect()) == sorted(i for i, (_, c) in comp.items() if c == i)
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 3 * len(raw)


def test_pipeline_judges_rows_not_ids(spark, sf_dir):
    import corpus_pipeline as P
    from graphloom.llm.mixing import mix_to_weights

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.text for r in P.quality(spark, docs, sf_dir).where("text <> ''").limit(40).collect()}
    clean = docs.where(F.col("text").isin(list(kept))).dropDuplicates(["text"]).limit(20)
    empty = clean.select("doc_id", F.lit("").alias("text"), "lang", "source", "n_chars")
    null = clean.withColumn("doc_id", F.lit(None).cast("long"))
    mixed = clean.unionByName(empty).unionByName(null).unionByName(empty.withColumn("doc_id", F.lit(None).cast("long")))
    got = P.quality(spark, mixed, sf_dir)
    assert got.where("text = ''").count() == 0 and got.where("doc_id is null").count() > 0 and got.where("doc_id is not null").count() > 0

    # one id, texts of many sizes: the mix takes each row as often as its own decision says
    rows = [(None if k % 2 else 7, " ".join(["w"] * (k % 9 + 1)) + f" r{k}", "en", f"s{k % 3}", 1) for k in range(300)]
    d = spark.createDataFrame(rows, EMPTY).repartition(3)
    out = P.mix(spark, d, sf_dir)
    words = {(r.source): r.w for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    for r in mix_to_weights(d).groupBy("source").agg(F.max("target").alias("t"), F.max("size").alias("m")).collect():
        assert abs(words.get(r.source, 0) - r.t) <= r.m
