"""Brackets of any depth, links of any number of bars, unclosed ones; texts of values."""

import pytest

from graphloom.functions import wikitext as X
from graphloom.operators import markup as M
from pyspark.sql import functions as F

PLAYER = """{{short|note}} {{Thông tin tiểu sử bóng đá
| name = Nguyen A<!-- a | b = c -->
| birth_date = {{Ngày sinh và tuổi|1997|4|12}}
| birth_place = [[One]], [[Two|label]], [[Three#part|x]]
| height = {{height|m=1,68}}
| years1 = 2015–2019 | clubs1 = [[Club One|One]] | caps1 = 102
| image = [[File:x.jpg|thumb|left|200px|alt=a|link=b|text {{small|{{nowrap|deep = 1|2}}}}]]
| caps1 = 103
| empty =
| unnamed
}}
'''Nguyen A''' [[Category:z]]"""


def params(spark, text, aliases=()):
    rows = M.infobox_parameters(spark.createDataFrame([(1, text)], "page int, text string"), aliases).collect()
    return ({r.name for r in rows} or {None}).pop(), {r.key: r.value for r in rows}


def test_parameters(spark):
    name, p = params(spark, PLAYER)
    assert name == "Thông tin tiểu sử bóng đá"
    assert p == {
        "name": "Nguyen A", "birth_date": "{{Ngày sinh và tuổi|1997|4|12}}", "birth_place": "[[One]], [[Two|label]], [[Three#part|x]]", "height": "{{height|m=1,68}}", "years1": "2015–2019",
        "clubs1": "[[Club One|One]]", "caps1": "103", "image": "[[File:x.jpg|thumb|left|200px|alt=a|link=b|text {{small|{{nowrap|deep = 1|2}}}}]]",
    }


def test_which_template(spark):
    assert params(spark, "{{Hộp thông tin địa điểm|capacity=22.500}}") == ("Hộp thông tin địa điểm", {"capacity": "22.500"})
    assert params(spark, "{{Infobox a|x=1}} {{My_box|x=2}}", ("my box",)) == ("My_box", {"x": "2"})
    assert params(spark, "{{Information|x=1}} {{wrap|{{Infobox a|x=1}}}}") == (None, {})  # no word end; not outermost
    assert params(spark, "no template") == (None, {}) and params(spark, None) == (None, {}) and params(spark, "") == (None, {})


@pytest.mark.parametrize("text", ["{{broken | a = {{Infobox a|x=1|y=[[l|m]]}} tail", "}} }} ]] {{Infobox a|x=1|y=[[l|m]]}} {{", "{{Infobox a|x=1|y=[[l|m]]}}}}", "{ {{Infobox a|x=1|y=[[l|m]]}} [[ {{"])
def test_unclosed_brackets_are_text(spark, text):
    assert params(spark, text) == ("Infobox a", {"x": "1", "y": "[[l|m]]"})


def test_links_of_many_bars(spark):
    pages = spark.createDataFrame([(1, "a [[T|1|2|3|4|5|6]] [[U]] [[open {{x|[[V|w]]}} [[File:f|[[inner|i]] cap]] ]]"), (2, "[[a")], "page int, text string")
    got = sorted((r.page, r.target, r.label) for r in M.page_links(pages).collect())
    whole = "open {{x|[[V|w]]}} [[File:f|[[inner|i]] cap]]"
    assert got == [(1, "T", "1|2|3|4|5|6"), (1, "U", "U"), (1, whole, whole)]


def test_many_unclosed_braces_cost_little(spark):
    text = "{{a|" * 20_000 + "{{Infobox a|x=1}}"
    assert params(spark, text) == ("Infobox a", {"x": "1"})


@pytest.mark.parametrize("raw,want", [
    ("[[a|b|c|d|e|f|g]]", "b|c|d|e|f|g"), ("x [[wikipedia:y]] [[bản mẫu:z]] [[commons:X|lab]] w", "x w"), ("[[:vi:Trang|t]] a", "a"), ("a &amp; b&nbsp;c &#8211; &#x2013;", "a & b c – –"),
    ("Team (<ref>V</ref>)", "Team"), ("a ( , ) b", "a b"), ("a<br/>b<br>", "a; b"), ("x<gallery>\nf.jpg|t\n</gallery> y", "x y"), ("{{ubl|One|[[Two]]}}", "One; Two"), ("a &bogus; &#0; b", "a &bogus; &#0; b"),
])
def test_render(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(X.render(F.col("t")).alias("v")).first().v == want


def test_links_to_articles_only(spark):
    raw = "[[One]] [[template:x]] [[Wikipedia:y]] [[commons:X|l]] [[Thể loại:c]] [[fr:z]] [[Mission: Two]] [[one#part]]"
    assert spark.createDataFrame([(raw,)], "t string").select(X.links(F.col("t")).alias("v")).first().v == ["One", "Mission: Two"]


def test_pages_are_read_where_they_are(spark):
    """Neither parameters nor links move a page's tokens between tasks or sort them."""
    pages = spark.createDataFrame([(1, PLAYER)], "page int, text string")
    for df in (M.infobox_parameters(pages), M.page_links(pages), M.templates(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    parts = [(r.n, r.key, r.value) for r in M.templates(spark.createDataFrame([(1, "{{a|b|c=d=e||=f|[[g=|h]]=i}} {{j}}")], "page int, text string")).collect()]
    assert parts == [(0, None, "a"), (1, None, "b"), (2, "c", "d=e"), (4, "", "f"), (5, "[[g=|h]]", "i"), (0, None, "j")]


def test_values_are_worked_out_once(spark):
    """A value that rendering uses in several places is in the plan once: it was 16 times."""
    df = spark.createDataFrame([("x &amp; {{small|y}}",)], "t string").select(X.render(F.concat("t", F.lit("<marker>"))).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("<marker>") == 1 and df.first().v == "x & y"


def test_raw_properties_in_one_pass(spark):
    from graphloom.operators.fusion import raw_properties

    rows = [("a", "k", "[[One]] [[Two]]"), ("a", "n", "007"), ("a", "e", "<br>"), ("a", "z", None), ("a", "l", "x" * 501), ("a", "t", "{{small|t}}")]
    df = raw_properties(spark.createDataFrame(rows, "s string, key string, raw string"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("a", "k", "One", "iri", None), ("a", "k", "Two", "iri", None), ("a", "n", "7", "lit", "xsd:integer"), ("a", "t", "t", "lit", None)], key=str)
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
