"""Column expressions that take fields out of article markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.terms import norm_title

#: While templates are worked on, control characters stand for a bar in a link, {{ and }}, [[ and ]], and {{ and }} of templates that are done.
BAR, OPEN, CLOSE, LINK, UNLINK, DONE, ENDED = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007"
# Keys that name images, kits or map styling; some also with a number, some whatever follows.
SKIPPED_KEYS = (
    "image", "logo", "hình", "ảnh", "caption", "chú thích", "image_size", "imagesize", "logo_size", "alt", "signature", "module", "medaltemplates", "pcupdate",
    "ntupdate", "club-update", "nhiều hình", "border", "total_width", "image_style", "caption_align", "perrow", "embedded",
)
SKIPPED_NUMBERED = ("image", "caption", "body", "shorts", "socks", "leftarm", "rightarm")
SKIPPED_STEMS = ("bản đồ", "map", "pushpin", "kit", "pattern")
# What stands before the colon of a link that leads to no article; other two- and three-letter prefixes (other languages) lead to none either.
OTHER_NAMESPACES = (
    "tập tin", "file", "hình", "image", "thể loại", "category", "bản mẫu", "template", "wikipedia", "wp", "wikt", "commons", "d", "en",
)
#: Named character references that texts of values have; others with a number are read as such.
ENTITIES = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·", "amp": "&"}
#: Endings of domains that count as an address without http.
DOMAINS = ("vn", "com", "org", "edu", "net", "gov")


def skipped(key: Column, keys=SKIPPED_KEYS, numbered=SKIPPED_NUMBERED, stems=SKIPPED_STEMS) -> Column:
    """Whether a raw key is one of `keys`, one of `numbered` with or without digits, or begins with one of `stems`."""
    low = F.lower(F.trim(key))
    out = low.isin(list(keys)) | F.regexp_replace(low, r"\d+$", "").isin(list(numbered))
    for stem in stems:
        out = out | low.startswith(stem)
    return out


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def template_name(name: Column) -> Column:
    """A template's name without prefix, in lower case, one space between words."""
    t = F.regexp_replace(F.translate(name, "_", " "), r"(?i)^\s*(?:template|bản mẫu)\s*:", "")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


# Fixed names of templates.
_NOT_DATE = r"(?!\s*(?:updated?\s*[|\x07]|cite|citation|chú thích))"
DATE = _NOT_DATE + r"\s*(?:[^|\x06\x07]*date[^|\x06\x07]*|(?:ngày|năm)(?![\p{L}\p{N}])[^|\x06\x07]*|bda\s*|dob\s*)"
SITE = r"\s*(?:url|official website|official url|website|trang web chính thức)\s*"
LIST = r"\s*(?:ubl|unbulleted list|plainlist|plain list|hlist|flatlist|bulleted list|danh sách)\s*"
FIRST = r"\s*(?:nowrap|nobr|small|big|nowrap begin|abbr|lang-vi|nobold|ill|sortname|vn|flagicon text)\s*"
SECOND = r"\s*(?:lang|sort|ngôn ngữ)\s*"
#: Named parameters, with the bar after each; and one without a name, or with a number for one.
NAMED, PLAIN = r"(?:\s*[\p{L}][\p{L}\p{N} _-]*=[^|\x06\x07]*\|)*", r"(?:\s*[0-9]+\s*=)?([^|\x06\x07]*)"
REST = r"[^\x06\x07]*\x07"


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{{"), F.lit(OPEN)), F.lit("}}"), F.lit(CLOSE))


def _depth(text: Column) -> Column:
    """How many levels of open and close marks a text nests, 1 at least."""
    step = lambda acc, x: F.when(x == OPEN, F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))).otherwise(F.struct(F.greatest(acc["now"] - 1, F.lit(0)).alias("now"), acc["most"].alias("most")))
    return F.aggregate(F.regexp_extract_all(text, F.lit("([\x02\x03])"), F.lit(1)), F.struct(F.lit(0).alias("now"), F.lit(1).alias("most")), step, lambda acc: acc["most"])


def _each_level(text: Column, step) -> Column:
    """Apply a step to a text as often as it has levels, so that templates of any depth are reached from the innermost on."""
    return _once(text, lambda whole: F.aggregate(F.sequence(F.lit(1), _depth(whole)), whole, lambda t, _: step(t)))


def _inner(text: Column) -> Column:
    """Interpret the innermost templates once."""
    t = F.regexp_replace(text, r"\x02([^\x02\x03]*)\x03", "\x06$1\x07")  # one level of them
    t = F.regexp_replace(t, rf"(?iu)\x06{DATE}\|{NAMED}\s*(\d{{4}})\s*\|{NAMED}\s*(\d{{1,2}})\s*\|{NAMED}\s*(\d{{1,2}})\s*(?=[|\x07]){REST}", "$1-\x080$2-\x080$3\x08")
    t = F.regexp_replace(t, rf"(?iu)\x06{DATE}\|{NAMED}\s*(\d{{4}})\s*\|{NAMED}\s*(\d{{1,2}})\s*(?=[|\x07]){REST}", "$1-\x080$2\x08")
    t = F.regexp_replace(t, r"\x080?(\d\d)(?=[-\x08])", "$1")  # months and days of two digits
    t = F.regexp_replace(t, r"\x08", "")
    t = F.regexp_replace(t, rf"(?iu)\x06{DATE}\|{NAMED}{PLAIN}{REST}", "$1")
    t = F.regexp_replace(t, rf"(?iu)\x06\s*(?:convert|cvt|đổi)\s*\|\s*([^|\x06\x07]*?)\s*\|\s*([^|\x06\x07=]*?)\s*(?=[|\x07]){REST}", "$1 $2")
    t = F.regexp_replace(t, rf"(?iu)\x06\s*(?:convert|cvt|đổi)\s*\|\s*([^|\x06\x07]*?)\s*(?=[|\x07]){REST}", "$1")
    t = F.regexp_replace(t, rf"(?iu)\x06\s*(?:height|chiều cao)\s*\|{NAMED}\s*m(?:eters)?\s*=\s*([0-9.,]+){REST}", "$1 m")
    t = F.regexp_replace(t, rf"(?iu)\x06\s*(?:height|chiều cao)\s*\|{NAMED}\s*cm\s*=\s*([0-9.,]+){REST}", "$1 cm")
    t = F.regexp_replace(t, rf"(?iu)\x06{SITE}\|(?:\s*(?:1|url)\s*=)?\s*([^|\x06\x07]*){REST}", "$1")
    t = F.regexp_replace(t, rf"(?iu)\x06{SECOND}\|{NAMED}[^|\x06\x07]*\|{NAMED}{PLAIN}{REST}", "$1")
    t = F.regexp_replace(t, rf"(?iu)\x06(?:{FIRST}|{SECOND})\|{NAMED}{PLAIN}{REST}", "$1")
    t = F.regexp_replace(t, rf"(?iu)\x06{LIST}\|([^\x06\x07]*)\x07", "\x04$1\x05")
    inside = r"(?=[^\x04-\x07]*\x05)"
    t = F.regexp_replace(t, rf"(?<=[\x04|])\s*[\p{{L}}][\p{{L}}\p{{N}} _-]*=[^|\x04-\x07]*{inside}", "")
    t = F.regexp_replace(t, rf"(?<=[\x04|])\s*[0-9]+\s*={inside}", "")
    t = F.regexp_replace(t, rf"(?:\||(?:^|\n|(?<=[\x04|]))\s*\*+){inside}", "; ")
    t = F.regexp_replace(t, rf"(?:;\s*)+(?:;\s*){inside}", "; ")
    t = F.regexp_replace(t, r"\x04[;\s]*|[;\s]*\x05", "")
    return F.regexp_replace(t, r"\x06[^\x06\x07]*\x07", "")


def interpret(text: Column) -> Column:
    """Interpret nested templates, innermost first and of any depth: dates, heights, addresses, lists and wrappers stay, others go."""
    def levels(text: Column) -> Column:
        t = F.regexp_replace(text, r"\|(?=[^\[\]]*\]\])", BAR)  # bars in a link are not those of its template
        t = _each_level(_braces(t), _inner)
        return F.replace(F.replace(F.translate(t, BAR, "|"), F.lit(OPEN), F.lit("{{")), F.lit(CLOSE), F.lit("}}"))

    return _once(text, lambda t: F.when(t.rlike(r"\{\{|[\x01-\x08]"), levels(t)).otherwise(t))  # texts without templates stay as they are


def outside(title: Column, namespaces: tuple[str, ...] = OTHER_NAMESPACES) -> Column:
    """Whether a link's target is no article: its prefix is one of the namespaces, or one of two or three letters."""
    prefix = F.lower(F.trim(F.split_part(title, F.lit(":"), F.lit(1))))
    return F.contains(title, F.lit(":")) & (prefix.isin(list(namespaces)) | F.lower(F.trim(title)).rlike("^:?[a-z]{2,3}:"))


def unescape(text: Column) -> Column:
    """Character references as characters: decimal, hexadecimal, and those of ENTITIES; others stay."""
    return _once(text, lambda t: F.when(F.contains(t, F.lit("&")), _unescape(t)).otherwise(t))


def _unescape(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    digits = lambda e: F.regexp_extract(e, r"([0-9a-fA-F]+);$", 1)
    number = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("long")
    valid = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    put = lambda t, e: F.when(valid(number(e)), F.replace(t, e, F.decode(F.unhex(F.lpad(F.hex(number(e)), 8, "0")), "UTF-32"))).otherwise(t)
    t = F.when(F.contains(text, F.lit("&#")), F.aggregate(found, text, put)).otherwise(text)
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return t


def render(text: Column, namespaces: tuple[str, ...] = OTHER_NAMESPACES) -> Column:
    """Text of a value: no comments, references, galleries or links outside of articles; links as their labels, line breaks as '; '."""
    return _once(text, lambda t: F.when(t.rlike(_MARKED), _render(t, namespaces)).otherwise(t))


#: What rendering may change; texts without it are their own rendering.
_MARKED = r"[\x00-\x1f\u00a0{}\[\]<>&'();|]|  |^[ ,]|[ ,]$"


def _render(text: Column, namespaces: tuple[str, ...]) -> Column:
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(?:ref|references|gallery)\b[^>]*/>|<(ref|references|gallery)\b.*?</\1\s*>", "")
    t = interpret(t)
    t = F.regexp_replace(t, rf"(?iu)\[\[\s*(?:{'|'.join(namespaces)}|:?[a-z]{{2,3}})\s*:[^\]]*\]\]", "")
    t = F.regexp_replace(t, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")  # all after the first bar
    t = F.regexp_replace(t, r"\[\[([^\]|]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://\S+\s+([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "; ")
    t = unescape(F.regexp_replace(t, r"<[^>]+>|'{2,}", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\(\s*[,;]?\s*\)", ""), r"[\s\u00a0]+", " ")
    return F.regexp_replace(F.replace(t, F.lit(" ;"), F.lit(";")), r"^[ ;,]+|[ ;,]+$", "")


def links(text: Column, namespaces: tuple[str, ...] = OTHER_NAMESPACES) -> Column:
    """Distinct article titles that a value links to, in order: no files, categories or other sites, no anchors."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~outside(x, namespaces) & (F.trim(x) != "")), norm_title))


def external_links(text: Column) -> Column:
    """Distinct addresses in the external-links section, those of official-site templates too (bare domains with http://)."""
    section = F.regexp_extract(text, r"(?isu)==\s*(?:external links|liên kết ngoài)\s*==(.*?)(?:\n==[^=]|\z)", 1)
    full = r"https?://[^\s\]|<>\"}]+"
    found = F.regexp_extract_all(section, F.lit(rf"(?iu)((?<=[{{]{{2}}){SITE}\|\s*+(?:(?:1|url)\s*=\s*)?+(?!https?://)[^\s|{{}}]+\.[^\s|{{}}]+|{full})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.when(x.rlike("^https?://"), x).otherwise(F.concat(F.lit("http://"), F.regexp_replace(x, r"(?iu)^[^|]*\|\s*(?:(?:1|url)\s*=)?\s*", "")))))


def first_url(text: Column, endings: tuple[str, ...] = DOMAINS) -> Column:
    """The first address of a text without the punctuation after it, else the first bare domain with one of the endings, with http://."""
    full = F.regexp_replace(F.regexp_extract(text, r"(https?://[^\s\]|<>\"]+)", 1), r"[.,;)]+$", "")
    words = F.filter(F.split(text, r"[\s\[\]|<>()\",;]+"), lambda w: w != "")
    host = lambda w: F.lower(F.regexp_extract(w, r"^((?:[A-Za-z0-9-]+\.)+[A-Za-z]+)(?:/|[.:]?$)", 1))
    bare = F.get(F.filter(words, lambda w: F.element_at(F.split(host(w), r"\."), -1).isin(list(endings))), F.lit(0))
    return F.when(full != "", full).when(bare.isNotNull(), F.concat(F.lit("http://"), F.regexp_replace(bare, r"[.:]+$", "")))


def _templates(text: Column, name: str) -> Column:
    """Bodies of the templates whose name begins as the pattern says, nested templates of any depth and all; unclosed ones are left out."""
    split = F.split(F.concat(F.lit(" "), _braces(text)), rf"(?iu)(?=\x02\s*(?:(?:template|bản mẫu)\s*:\s*)?(?:{name}))")
    rest = lambda pieces: F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda k: F.substring(F.array_join(F.slice(pieces, k, F.size(pieces)), ""), F.lit(2), F.length(text)))
    done = lambda t: F.regexp_replace(t, r"\x02([^\x02\x03]*)\x03", "\x06$1\x07")
    body = lambda t: F.regexp_extract(_each_level(t, done), r"^\s*([^\x02\x03]*)\x03", 1)
    shown = lambda t: F.replace(F.replace(t, F.lit(DONE), F.lit("{{")), F.lit(ENDED), F.lit("}}"))
    return _once(split, lambda pieces: F.when(F.size(pieces) > 1, F.filter(F.transform(rest(pieces), lambda t: shown(body(t))), lambda t: t != "")))


def infobox(text: Column, aliases: tuple[str, ...] = ()) -> Column:
    """The body of the first template with one of the names `aliases`, else of the first whose name begins with infobox; '' if there is none."""
    begins = _templates(text, r"(?:infobox|thông tin|hộp thông tin)(?![\p{L}\p{N}])")
    named = [r"[\s_]+".join(map(re.escape, a.replace("_", " ").split())) for a in aliases]
    known = [F.get(_templates(text, rf"(?:{'|'.join(named)})\s*[|\x03]"), F.lit(0))] if named else []
    return F.when(text.isNotNull(), F.coalesce(*known, F.get(begins, F.lit(0)), F.lit("")))


def params(body: Column) -> Column:
    """map of key to raw value of a template body; bars in links and nested templates do not split; the last of a key wins."""
    return _once(body, _params)


def _params(body: Column) -> Column:
    def hide(t: Column) -> Column:  # innermost links and templates first: their bars and brackets become control characters
        t = F.regexp_replace(t, r"\|(?=[^{}\[\]]*(?:\}\}|\]\]))", "\u0001")
        t = F.regexp_replace(t, r"\{\{([^{}|]*)\}\}", "\u0002\u0002$1\u0003\u0003")
        return F.regexp_replace(t, r"\[\[([^\[\]|]*)\]\]", "\u0004\u0004$1\u0005\u0005")

    levels = _depth(F.replace(F.replace(_braces(body), F.lit("[["), F.lit(OPEN)), F.lit("]]"), F.lit(CLOSE)))
    hidden = F.aggregate(F.sequence(F.lit(1), levels), body, lambda t, _: hide(t))
    shown = lambda c: F.translate(c, "\u0001\u0002\u0003\u0004\u0005", "|{}[]")
    pairs = F.filter(F.filter(F.split(hidden, r"\|"), lambda _, i: i > 0), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(strip(F.element_at(F.split(p, "=", 2), 1))).alias("k"), shown(strip(F.element_at(F.split(p, "=", 2), 2))).alias("v")))
    kept = F.filter(entries, lambda e: (e["k"] != "") & (e["v"] != ""))
    none = F.create_map().cast("map<string, string>")
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_entries(F.array(e)))
    return F.aggregate(kept, none, put)
