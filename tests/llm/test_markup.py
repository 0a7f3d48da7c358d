from inkwell.llm import layout, markup, spam

PAGE = """<!DOCTYPE html>
<html><head><title>Some Post</title><style>p { color: red }</style>
<script>var a = "<p>not text</p>";</script></head>
<body>
<nav><a href=/>Start</a> <a href=/x>Fekuzu</a></nav>
<div style="display:none">A word for robots.</div>
<h1>The bridge
of Nafora</h1>
<p>It was moved to the river
in the night.
<p>Nobody had seen it &amp; nobody <b hidden>secretly</b> asked.
<ul><li>One<li>Two
<ol><li>Inner</ol>
</ul>
<table><tr><th>Town<th>Boats
<tr><td>Baro<td>12</table>
<aside><h2>Kuriose Fundsachen</h2><ul><li>The mill</ul></aside>
<pre>a  b
 c</pre>
<p aria-hidden="true">ornament
<form>Tell me your name <input name=q></form>
<p>All rights reserved.
<footer>Vse pravice</footer>
</body></html>""".split("\n")
NUMBERED = list(enumerate(PAGE, 1))


def test_visible_text_with_blocks_lists_and_cells():
    text = layout.render(layout.build(NUMBERED))
    assert text == """The bridge of Nafora

It was moved to the river in the night.

Nobody had seen it & nobody asked.

- One
- Two
  1. Inner

Town | Boats
Baro | 12

a  b
 c"""


def test_hidden_lines_by_tags_and_words():
    hidden = set(layout.hidden_lines(NUMBERED))
    own = {n for n, x in NUMBERED if any(w in x for w in ("<h1>", "of Nafora", "It was moved", "in the night", "Nobody", "<li>One", "Inner", "Town", "Baro", "<pre>", " c</pre>"))}
    assert hidden == {n for n, x in NUMBERED if x.strip()} - own


def test_implied_tags():
    tags = lambda n: [n.tag, *[tags(c) for c in n.children if isinstance(c, markup.Node)]]
    assert tags(markup.tree("<td>a<td>b<tr><td>c")) == ["html", ["table", ["tr", ["td"], ["td"]], ["tr", ["td"]]]]
    assert tags(markup.tree("<li>a<li>b</ul>c<p>d<div>e</p>")) == ["html", ["ul", ["li"], ["li"]], ["p"], ["div"]]
    assert tags(markup.tree("<dl><dt>a<dd>b<dt>c</dl><p>x<br>y<table><tbody><tr><td><p>z</table>w")) == [
        "html", ["dl", ["dt"], ["dd"], ["dt"]], ["p", ["br"]], ["table", ["tbody", ["tr", ["td", ["p"]]]]]]
    assert tags(markup.tree("</div>a</p><b>c</i>")) == ["html", ["b"]]


def test_nested_tables_and_spans():
    assert [b.text for b in markup.blocks([(1, "<table><tr><td>menu<td><table><tr><td colspan=2>a<td>b</table></table>")])] == ["menu", "a |  | b"]


def test_odd_markup():
    for x in ("<", "<p", "a < b <p>c", "<!-- <p>x", "<script>never ends <p>", "<p class='a>b'>x", "<ul>" * 300 + "<p>x", "<p>" * 2000):
        layout.render(layout.build([(1, x), (2, None), (3, "<p>end")]))


def test_pages_of_markup_in_a_table(spark):
    df = spark.createDataFrame([(1, n, x) for n, x in NUMBERED] + [(2, 1, "It was the first time that this had been done to a bridge.")] , "doc_id bigint, line_no int, line string")
    got = {r.line_no for r in spam.furniture(df).where("doc_id = 1").collect()}
    assert got == set(layout.hidden_lines(NUMBERED))
    assert got == {r.n for r in spam.looked_at(df, part=3).where("doc_id = 1").selectExpr("explode(hidden) AS n").collect()}
