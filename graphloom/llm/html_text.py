"""Main-text extraction by site style trees."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Branches of less importance are removed, on hosts with this many pages or more.
LOW, PAGES = 0.3, 8
#: Branches that a part of a class, id or role marks are removed below this importance.
DOUBTED = 0.6
CONTENT = 0.9

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that hold no main text.
APART = frozenset("nav header footer aside form button select menu dialog head".split())
#: Classes, ids and roles that mark branches without main text.
NOTED = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices popup modal newsletter subscribe nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side footer header masthead share social related recommended comment comments replies respond disqus "
    "login search toolbar skip widget".split()
)
#: Those of them whose branches often hold articles of their own, which are not the page's.
OTHERS = frozenset("related recommended comment comments replies respond disqus".split())
#: Before and after a part of a class, these say that the page has or lacks the thing, not that the branch is it.
STATED, STATES = frozenset("has no not with without".split()), frozenset("open closed on off enabled disabled".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: A start tag of the key closes open elements of the values, up to the nearest of the stops.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol menu dl table body html article section div main".split())
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+")
OUT, HELD, OPEN, DOUBT = range(4)
#: Style node of a whole page, and the path of the body.
PAGE, BODY = 0, 2


@lru_cache(1 << 14)
def noted(marks: str) -> tuple[bool, bool, bool]:
    """Whether the class, id and role names (lower case) name a branch without main text: surely (a whole name), in doubt (a part of one), and as OTHERS."""
    names = marks.split()
    sure = NOTED.intersection(names)
    doubt = False
    for name in names:
        parts = PARTS.findall(name)
        if STATED.isdisjoint(parts) and STATES.isdisjoint(parts):
            doubt = doubt or not NOTED.isdisjoint(parts)
    return bool(sure), doubt, bool(sure) and sure <= OTHERS


def blocks(page: str | None) -> Iterator[tuple[int, str, int]]:
    """(hash of the style path, text, state) of the text blocks of a page, in order.

    The state is OUT if markup alone rules a block out, DOUBT if only a part of a class, id or role does,
    HELD inside of an article or main, else OPEN. Marks of html, body, main and article, and of branches that
    hold a main, article or h1, do not count; but comments and related articles after the first of these do.

    Unclosed and wrongly nested elements are closed as browsers do: an end tag closes up to its element,
    a block start closes an open paragraph.
    """
    for path, text, out, inside, marks in list(_parsed(page)):
        open_ = [m for m in marks if not m[2]]
        if out or any(m[0] for m in open_):
            yield path, text, OUT
        else:
            yield path, text, DOUBT if open_ else HELD if inside else OPEN


def _parsed(page: str | None) -> Iterator[tuple[int, str, bool, bool, tuple]]:
    """(hash of the style path, text, ruled out by an element, inside of an article or main, marks above it) of the text blocks.

    A mark is a list of whether it is sure, whether it is of OTHERS, and whether its branch holds main text;
    the last is known at the end of the page only.
    """
    stack: list[tuple[str, int, bool, bool, tuple]] = [("html", BODY, False, False, ())]
    parts: list[str] = []
    held: dict[str, int] = defaultdict(int)  # open elements by name, so that an end tag without its start costs no walk
    text, at = page or "", 0
    begun = False

    def flush() -> tuple[int, str, bool, bool, tuple] | None:
        joined = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        return (stack[-1][1], joined, *stack[-1][2:]) if joined else None

    while at < len(text):
        m = _TOKEN.search(text, at)
        parts.append(text[at : m.start() if m else len(text)])
        if not m:
            break
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if m[1]:
            if held[name]:
                if name in BLOCK and (b := flush()):
                    yield b
                while True:
                    last = stack.pop()[0]
                    held[last] -= 1
                    if last == name:
                        break
            elif name == "p" and (b := flush()):
                yield b
            continue
        if name in BLOCK and (b := flush()):
            yield b
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name in VOID:
            continue
        if name in BLOCK and name != "br":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(name, ()):
                    for s in stack[k:]:
                        held[s[0]] -= 1
                    del stack[k:]
                    break
                if stack[k][0] in STOPS:
                    break
        marks = " ".join(x or y or z for x, y, z in _MARK.findall(m[3])).lower() if "=" in m[3] else ""
        _, path, out, inside, above = stack[-1]
        if name in ("article", "main", "h1"):
            for mark in above:
                mark[2] = mark[2] or not (begun and mark[1])
            begun = begun or not out
        out = out or name in APART and name != "form" and not (name == "header" and inside) or bool(m[3] and _HIDDEN.search(m[3]))
        if name == "form":
            above = (*above, [True, False, False])
        elif marks and name not in ("html", "body", "main", "article"):
            sure, doubt, others = noted(marks)
            if sure and inside and NOTED.intersection(marks.split()) == {"header"}:
                sure, doubt = False, True
            if sure or doubt:
                above = (*above, [sure, others, False])
        inside = inside or name in ("article", "main")
        label = name + ("." + ".".join(sorted(marks.split())) if marks else "")
        if name not in ("html", "body") and name in BLOCK:
            path = _below(path, label)
        stack.append((name, path, out, inside, above))
        held[name] += 1
    if b := flush():
        yield b


@lru_cache(1 << 16)
def _below(path: int, label: str) -> int:
    """The path of an element below another path: even, from 0 to 2 ** 62, so that a path of any depth is one number."""
    return xxhash.xxh3_64_intdigest(f"{path}/{label}") >> 3 << 1


def _node(path: int, state: int) -> int:
    """The style node of a block; blocks in doubt have (odd) nodes of their own."""
    return path + (state == DOUBT)


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def style_tree(nodes: DataFrame) -> DataFrame:
    """host, path, n (pages that have it), importance of the style nodes of each host.

    nodes has host, path, content (hash of a node's text on one page), pages (how many pages had it); the
    path PAGE stands for the page. A node's content importance is the entropy of its content over the pages
    that have it, its presentation importance that of being there at all, each as a share of the most
    possible; its importance is CONTENT parts the first and the rest the second. Equal contents are
    counted before they meet, so that a host of very many pages is never a group of rows.
    """
    per = nodes.groupBy("host", "path", "content").agg(F.sum("pages").alias("c"))
    stat = per.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    stat = written(stat, "nodes")
    total = stat.where(F.col("path") == PAGE).select("host", F.col("n").alias("pages"))
    p = F.col("n") / F.col("pages")
    content = F.when(F.col("n") > 1, (F.log2("n") - F.col("s") / F.col("n")) / F.log2("n")).otherwise(1.0)
    presence = F.when(p < 1, -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
    return (
        stat.where(F.col("path") != PAGE)
        .join(total.hint("merge"), "host")
        .select("host", "path", "n", (CONTENT * content + (1 - CONTENT) * presence).alias("importance"))
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    The pages of a host are merged into a style tree of element paths (name, class, id, role) of any depth,
    and each path is judged by its own text. Branches whose element or marks (whole names of class, id and
    role) name a menu, header, footer, sidebar, notice, advert, form or comments are no main text, unless
    they hold the article (see blocks()). Of the others, those outside an article whose content hardly varies
    over the host's pages (importance under LOW, nodes of PAGES pages or more) are removed, and those that a
    part of a name marks ("site-footer") if their importance is under DOUBTED. What is left is joined in page
    order.

    Returns one row per page: id, url, text, n_chars. Null html is empty; a null or odd url belongs to the
    host ''; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", _host("url"))

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int, int], int] = defaultdict(int)
        for b in batches:
            for host, page in zip(b["host"], b["html"], strict=True):
                whole: dict[int, list[str]] = defaultdict(list)
                for path, text, state in blocks(page):
                    if state in (OPEN, DOUBT):
                        whole[_node(path, state)].append(text)
                for path, texts in whole.items():
                    seen[host, path, xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1] += 1
                seen[host, PAGE, 0] += 1
            if len(seen) > 100_000:
                yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["host", "path", "content", "pages"])
                seen.clear()
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["host", "path", "content", "pages"])

    nodes = rows.select("host", "html").mapInPandas(survey, "host string, path long, content long, pages long")
    tree = style_tree(nodes)
    least = F.when(F.col("path") % 2 == 1, DOUBTED).otherwise(LOW)
    low = written(tree.where((F.col("importance") < least) & (F.col("n") >= PAGES)).groupBy("host").agg(F.collect_set("path").alias("low")), "low")
    size = low.agg(F.sum(F.length("host") + 8 * F.size("low") + 64)).first()[0] or 0
    joined = rows.join(low.select("host", "low").hint("broadcast" if size <= 32_000_000 else "merge"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = []
                for page, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    drop = set(low or ())
                    texts.append(" ".join([t for path, t, state in blocks(page) if state == HELD or state != OUT and _node(path, state) not in drop]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.select("id", "url", "html", "low").mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
