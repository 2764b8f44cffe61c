import re

import pytest

from evenkeel.llm.html_text import extract, visible_text

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<p> a \n b </p>c": "a b\n\nc",
    "<div>a</div><div>b<span> c</span>d</div>": "a\nb cd",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li><p>d<p>e</ul>f": "- a\n- b\n  - c\n\n- d\n\n  e\n\nf",
    "<ol start=3><li>a</li><li value=7>b<li>c</ol>": "3. a\n7. b\n8. c",
    "<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>": "name    n\na       10\nlonger  2",
    "<table><td>a<td>b<tr><td colspan=2>wide cell<tr><td rowspan=2>x<td>y<tr><td>z</table>": "a  b\nwide cell\nx  y\n   z",
    "<table>lost<tr><td>in</table>": "lost\n\nin",
    "<table><caption>c</caption><tfoot><tr><td>f</tfoot><tbody><tr><td>b<br>b2<td>x</table>": "c\nb   x\nb2\nf",
    "<pre>\n a\n  b\n\nc</pre>d": " a\n  b\n\nc\n\nd",
    "<title>t</title><script>var a='</p>';</script><style>p{}</style>x": "x",
    "<head><title>t</title><p>x": "x",
    "x<script>never closed <b>y": "x",
    "<p hidden>a</p><p style='display : none'>b</p><div style='visibility:hidden'>c<b style='visibility:visible'>d</b></div>e": "d\ne",
    "<details><summary>s</summary>body</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<dialog>a</dialog><template>b</template><noscript>c</noscript><select><option>d</select>e": "e",
    "a &lt; b &amp c &copy; &nbsp; d": "a < b & c ©   d",
    "a < b <3 c": "a < b <3 c",
    "<!-- x --><!doctype html>a<!-- y": "a",
    "<a href='>'>l</a><b>b</i></b></div>": "lb",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n  d\n  e",
    "<h1>h<h2>i</h2>x": "h\n\ni\n\nx",
    "<blockquote>q<br>r</blockquote>s": "  q\n  r\n\ns",
    "</p></br>a</li>": "a",
    "": "",
    "<p>  </p>": "",
    "<a title=\"x > y": "y",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


FORMS = {
    "<table><form><tr><td>text</td></tr></form></table>": "text",
    "<table><tr><form><td>text<td>more</td></form></tr></table>": "text  more",
    "<table><tbody><form><tr><td>a<td><input name=q>b</form><tr><td>longer<td>c</table>d": "a       b\nlonger  c\n\nd",
    "<table><form hidden><tr><td>a</form></table>": "a",
    "<form>x<table><form><tr><td>a</form><td>b</table>y</form>z": "x\n\na  b\n\ny\nz",
    "<table><tr><td><form>a<p>b</form>c</table>": "a\n\nb\n\nc",
}


@pytest.mark.parametrize("page", FORMS)
def test_forms_between_the_parts_of_a_table(page):
    assert visible_text(page) == FORMS[page]


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert visible_text("<table><tr><td>" * 300 + "x").strip() == "x"
    assert visible_text("<p>a b " * 50_000).count("a b") == 50_000
    assert visible_text("<" * 3_000 + " x").endswith("x")
    visible_text("<a " + "x=' " * 20_000)


UNCLOSED = "<font><b><span>" * 500
DEEP = {
    UNCLOSED + "a<script>var x</script><style>p{}</style><noscript>n</noscript>b": "ab",
    UNCLOSED + "a<i hidden>h</i><i style='display:none'>h</i><template><b>t</b></template><select><option>o</select><svg><text>s</text></svg>b": "ab",
    UNCLOSED + "<table><tr><td>a<td>b<tr><td>longer<td>c</table>": "a       b\nlonger  c",
    "<div>a" + UNCLOSED + "<div>b</div>c</div>d": "a\nb\nc\nd",
    "<blockquote>" * 2_000 + "x": "x",
    "<ul><li>" * 2_000 + "x": "- x",
}


@pytest.mark.parametrize("page", DEEP, ids=range(len(DEEP)))
def test_nothing_changes_with_depth(page):
    assert visible_text(page).strip() == DEEP[page]


def test_deep_pages_take_linear_time_and_room():
    assert visible_text("<p>" + "<b>" * 50_000 + "<button>" + "<i>" * 50_000 + "<div>x</u></div>" * 20_000).count("x") == 20_000
    deep = visible_text("<blockquote>x" * 3_000)
    assert deep.count("x") == 3_000 and len(deep) < 3_000 * 250
    words = visible_text("<table><caption>x<tr><td>y<td hidden>n<td>z" * 2_000).split()
    assert sorted(words) == ["x"] * 2_000 + ["y"] * 2_000 + ["z"] * 2_000


def test_tables(spark):
    rows = spark.createDataFrame([(1, "<p>a", "t"), (None, None, "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted(map(str, extract(rows).collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text=None)"])
    assert extract(rows.limit(0)).count() == 0


def test_given_pages_keep_every_visible_word(spark):
    """These pages hide nothing in their bodies, so the words must be those between the tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        from html import unescape

        body = re.sub(r"(?is)<head>.*?</head>|<!--.*?-->", " ", row["html"])
        body = re.sub(r"(?i)</?(?:b|a)\b[^>]*>", "", body)
        plain = unescape(re.sub(r"<[^>]*(?:>|$)", " ", body)).split()
        assert [w for w in row["text"].split() if w != "-"] == [w for w in plain if w != "-"]
