"""Templates, parameters and links of whole pages by matching brackets, page by page inside the tasks that read them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.wikitext import template_name

#: A token: a pair of brackets, a bar, an equals sign, other text, or a bracket alone.
TOKEN = r"\{\{|\}\}|\[\[|\]\]|[|=]|[^{}\[\]|=]+|[{}\[\]]"
#: Begins of template names that are infoboxes whatever their family.
INFOBOX = r"^(?:infobox|thông tin|hộp thông tin)(?![\p{L}\p{N}])"


_TOKEN, _COMMENT, _BLANKS = re.compile(TOKEN), re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"[ \t\n\x0b\f\r]+")
_WHITE = " \t\n\x0b\f\r"
#: Pages whose rows leave a task at once.
_AT_ONCE = 1000


def _pairs(toks: list[str], opens: str, closes: str, within: list[int] | None = None) -> dict[int, int]:
    """The place of each open bracket that is closed, with that of its close; others are text. Brackets match inside one value of `within` only."""
    waiting, out = {}, {}
    for pos, tok in enumerate(toks):
        if tok == opens:
            waiting.setdefault(within and within[pos], []).append(pos)
        elif tok == closes and (stack := waiting.get(within and within[pos])):
            out[stack.pop()] = pos
    return out


def _around(toks: list[str], pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """The innermost and the outermost pair around each token, by the place of its open (-1: none); brackets are inside their own pair."""
    ends, stack, inner, outer = set(pairs.values()), [], [], []
    for pos in range(len(toks)):
        if pos in pairs:
            stack.append(pos)
        inner.append(stack[-1] if stack else -1)
        outer.append(stack[0] if stack else -1)
        if pos in ends:
            stack.pop()
    return inner, outer


def _parsed(text: str) -> tuple[list[str], dict[int, int], list[int], list[int], dict[int, int], list[int]]:
    """Tokens of a text without comments; templates, the innermost and outermost around each token; links (each matched inside one template), the innermost of its template around each token."""
    toks = _TOKEN.findall(_COMMENT.sub("", text))
    braces = _pairs(toks, "{{", "}}")
    owner, root = _around(toks, braces)
    links = _pairs(toks, "[[", "]]", owner)
    ends, stacks, inside = set(links.values()), {}, []
    for pos, own in enumerate(owner):
        if pos in links:
            stacks.setdefault(own, []).append(pos)
        stack = stacks.get(own)
        inside.append(stack[-1] if stack else -1)
        if pos in ends:
            stack.pop()
    return toks, braces, owner, root, links, inside


def _template_parts(text: str) -> Iterator[tuple[int, int, str | None, str]]:
    """root, n, key, value of the parts of a text's outermost templates; see templates()."""
    toks, braces, owner, root, _, inside = _parsed(text)
    for start in (p for p in braces if root[p] == p):
        n, key, toks_of = 0, None, []
        for pos in range(start + 1, braces[start] + 1):
            own, tok = owner[pos] == start and inside[pos] == -1, toks[pos]
            if own and (tok == "|" or pos == braces[start]):
                if toks_of or key is not None:
                    yield start, n, key, "".join(toks_of).strip(_WHITE)
                n, key, toks_of = n + 1, None, []
            elif own and tok == "=" and n and key is None:
                key, toks_of = _BLANKS.sub(" ", "".join(toks_of)).strip(" "), []
            else:
                toks_of.append(tok)


def _boxes(text: str) -> list[dict]:
    """name, params (key, value) of a text's outermost templates in order: named, non-empty parameters, the last of a key."""
    boxes: dict[int, dict] = {}
    for root, n, key, value in _template_parts(text):
        box = boxes.setdefault(root, {"root": root, "name": None, "params": {}})
        if n == 0:
            box["name"] = value
        elif key and value:
            box["params"][key] = value
    return [b | {"params": [{"key": k, "value": v} for k, v in b["params"].items()]} for _, b in sorted(boxes.items())]


def _outer_links(text: str) -> Iterator[tuple[int, str, str]]:
    """pos, target, label of a text's links; see page_links()."""
    toks, _, owner, _, links, inside = _parsed(text)
    until = -1
    for start, end in sorted(links.items()):
        if start > until and end > start + 1:
            bar = next((p for p in range(start + 1, end) if toks[p] == "|" and owner[p] == owner[start] and inside[p] == start), None)
            target = "".join(toks[start + 1 : bar or end]).strip(" ")
            yield start, target, target if bar is None else "".join(toks[bar + 1 : end]).strip(" ")
        until = max(until, end)


def _of_pages(batches: Iterable[pa.RecordBatch], of: Callable[[str], Iterable], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """For each page and each row that `of` gives of its text: the page and the row."""
    for whole in batches:
        for k in range(0, whole.num_rows, _AT_ONCE):
            batch = whole.slice(k, _AT_ONCE)
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for row in of(text):
                        at.append(i)
                        rows.append(row)
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=[f"c{j}" for j in range(len(types) + 1)])


def _read(pages: DataFrame, page: str, text: str, of: Callable[[str], Iterable], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    rows = pages.select(F.col(page).alias("page"), F.col(text).alias("text"))
    names = ", ".join(f"c{j + 1} {sql}" for j, (_, sql, _) in enumerate(fields))
    out = rows.mapInArrow(partial(_of_pages, of=of, types=[kind for *_, kind in fields]), f"c0 {rows.schema['page'].dataType.simpleString()}, {names}")
    return out.toDF("page", *[name for name, *_ in fields])


def templates(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, root, n, key, value: the parts of the outermost templates; n = 0 is the name (in value), others are parameters.

    A part ends at a bar of the template itself, not at those of links or templates in it; its key ends at the first
    equals sign of the template itself (null: a parameter without a name). Values keep their markup. A page is read
    by one stack of open brackets in the task that has it, without a shuffle; root is the place of the template among
    the page's tokens. Unclosed brackets are text, comments are gone, null texts have no parts.
    """
    return _read(pages, page, text, _template_parts, [("root", "int", pa.int32()), ("n", "long", pa.int64()), ("key", "string", pa.string()), ("value", "string", pa.string())])


_BOX = pa.struct([("root", pa.int32()), ("name", pa.string()), ("params", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))])


def _one_row(text: str) -> list[tuple[list[dict]]]:
    return [(boxes,)] if (boxes := _boxes(text)) else []


def infobox_parameters(pages: DataFrame, aliases: tuple[str, ...] = (), page: str = "page", text: str = "text") -> DataFrame:
    """page, name, key, value: the named, non-empty parameters of each page's infobox; the last of a key wins.

    The infobox is the first outermost template with one of the names `aliases`, else the first whose name begins
    as INFOBOX says; pages without one have no rows, infoboxes without parameters neither. A page is one row, so
    nothing is shuffled.
    """
    rows = _read(pages, page, text, _one_row, [("boxes", "array<struct<root: int, name: string, params: array<struct<key: string, value: string>>>>", pa.list_(_BOX))])
    wanted = sorted({re.sub(r"\s+", " ", a.replace("_", " ")).strip().lower() for a in aliases})
    rank = lambda folded: F.when(folded.isin(wanted), 0).when(folded.rlike("(?iu)" + INFOBOX), 1)
    ranked = F.transform(F.transform("boxes", lambda b: template_name(b["name"])), lambda folded, i: F.struct(rank(folded).alias("rank"), i.alias("place")))
    best = F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["place"]
    chosen = rows.withColumn("place", best).where("place is not null").withColumn("box", F.get("boxes", F.col("place")))
    return chosen.select("page", F.col("box.name").alias("name"), F.inline("box.params"))


def page_links(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, pos, target, label: every closed link that is in no other one, with any number of bars: the label is all after the first bar, else the target. Pages are read as templates() does."""
    return _read(pages, page, text, _outer_links, [("pos", "int", pa.int32()), ("target", "string", pa.string()), ("label", "string", pa.string())])
