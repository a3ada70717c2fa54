import random

import pytest

from segtide.llm import html_extraction as h

PAGES = "page_id bigint, url string, html string"


def extract(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, PAGES)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in h.extract(df, keep=["page_id"]).collect()}


def plain(html):
    return h.main_text(h.parse(html), {})


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a\n\n b<p>c<br>d", "a b c d"),
        ("<article><h1>T</h1><p>x <b>y</b>z</article>rest", "T x yz"),
        ("<nav><ul><li>m</ul></nav><p>text", "text"),
        ("<p>1 &lt; 2 &amp; &eacute;&#233;&#x41;&nosuch; &am</p>", "1 < 2 & ééA&nosuch; &am"),
        ("<script>var t='</p>'; a<b</script><style>p{}</style><p>x", "x"),
        ("<!-- <p>no</p> --><p>x<!-- cut", "x"),
        ("<article><p>x</p><div class='comments'><p>reader</p></div><form><input>f</form><aside>s</aside><p>y</article><footer>f", "x y"),
        ("<div id=main><div class='cookie-notice'>ok?</div><p>x<div class='side-bar sidebar'>s</div></div>", "x"),
        ("<body class='has-sidebar'><p>x", "x"),
        ("<article><header><h1>T</h1></header><p>x</article><header>site</header>", "T x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("</p></div>x", "x"),
        ("a < b", "a < b"),
        ("<p title=\"a>b\">x</p><p title='", "x"),
    ],
)
def test_blocks(html, text):
    assert plain(html) == text


def test_simple_tree_matching():
    a, b = h.parse("<div><h1>x</h1><p>1</p><ul><li>q</ul></div>"), h.parse("<div><p>2</p><ul><li>r</ul><h2>z</h2></div>")
    size, pairs = h.align(a, b)
    assert size == len(pairs) == 5  # root, div, p, ul, li
    assert h.align(a, a)[0] == 6
    assert h.align(h.parse(""), a)[0] == 1


def test_constant_texts_are_template_and_copies_do_not_vote(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><h1>{0}</h1><p>Story {0} goes on.</p></div><div>All rights</div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(f"t{i}")) for i in range(20)]
    rows += [(100 + i, "http://b.example/", page.format("same")) for i in range(30)]  # copies of one page only
    rows += [(200, "http://c.example/", page.format("alone")), (201, None, None), (202, "http://a.example/", ""), (203, "x", "<p>ü</p>")]
    found = extract(spark, rows)
    assert all(found[i] == (f"t{i} Story t{i} goes on.", len(f"t{i} Story t{i} goes on.")) for i in range(20))
    assert all(found[100 + i][0] == "Welcome to our site same Story same goes on. All rights" for i in range(30))
    assert found[200][0] == "Welcome to our site alone Story alone goes on. All rights"
    assert found[201] == ("", 0) and found[202] == ("", 0) and found[203] == ("ü", 1)
    assert extract(spark, []) == {}


def test_template_behind_long_and_deep_parts(spark):
    blocks = lambda i: "".join(f"<h2>head {i} {k}</h2><p>text {i} {k}</p>" for k in range(130 + i % 2))
    page = "<body>{}<div>" + "<div><h3>{}</h3>" * 80 + "<p>Deep site text</p>" + "</div>" * 80 + "</div><p>Closing site text</p></body>"
    rows = [(i, f"http://a.example/{i}", page.format(blocks(i), *[f"level {i} {k}" for k in range(80)])) for i in range(40)]
    found = extract(spark, rows)
    assert all("site text" not in found[i][0] for i in range(40))
    assert all(f"text {i} {129 + i % 2} level {i} 0 level" in found[i][0] for i in range(40))


def test_every_layout_has_a_template(spark):
    page = "<html lang={2}><body><div class='top{1}'><p>{0} starts {1}</p><p>Part {1} of our site</p></div><div class=text><h1>t{0}</h1><p>Note in {2}</p></div><div class='low{1}'><p>Low {1}</p></div></body></html>"
    letters, languages = "abcdefghij", ("de", "en", "fr", "es", "it")
    rows = [(100 * k + i, f"http://a.example/{k}/{i}", page.format(f"p{k}x{i}", letters[k], languages[k // 2])) for k in range(10) for i in range(12)]
    rows += [(5000 + i, "http://a.example/copy", page.format("copied", "z", "pt")) for i in range(12)]  # copies make no layout
    found = extract(spark, rows)
    for k in range(10):
        for i in range(12):
            assert found[100 * k + i][0] == f"p{k}x{i} starts {letters[k]} tp{k}x{i}"
    assert all(found[5000 + i][0] == "copied starts z Part z of our site tcopied Note in pt Low z" for i in range(12))


def test_largest_alignments(monkeypatch):
    """Sizes against the plain table of simple tree matching, with and without arrays."""

    def plain_size(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, r in enumerate(a.children):
            for j, c in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_size(r, c))
        return best[-1][-1] + 1

    def some(depth):
        tags = random.choices(["div", "ul", "h2", "p"], k=random.randint(0, 6))
        return "".join(f"<{t}>{some(depth - 1) if t in ('div', 'ul') and depth else random.choice('abc')}</{t}>" for t in tags)

    random.seed(3)
    for few in (h.FEW, 0):
        monkeypatch.setattr(h, "FEW", few)
        for _ in range(200):
            a, b = h.parse(some(3)), h.parse(some(3))
            size, pairs = h.align(a, b)
            assert size == plain_size(a, b) == len(pairs) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})
            assert all(x.label == y.label for x, y in pairs)


def test_registered_pages(spark, sf):
    import html
    import re

    from segtide.llm.queries import html_extraction_query

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extraction_query(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner)))
        assert r["text"] == " ".join(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert r["n_chars"] == len(r["text"])


def test_very_long_and_deep_pages():
    assert plain("<div>" * 300 + "x" + "</div>" * 300) == "x"
    assert plain("<p>a" * 50_000) == " ".join(["a"] * 50_000)


@pytest.mark.parametrize("depth", [450, 5_000, 40_000])
def test_text_and_menus_at_any_depth(depth):
    """What stands behind and inside very deep markup is read, and a menu there is known for one."""
    inside = "<div>" * depth + "deep<nav>MENU</nav>" + "</div>" * depth
    assert plain(f"<div id=page><article><p>START</p>{inside}<p>MORE</p></article></div>out") == "START deep MORE"
    assert plain("<div>" * depth + "<nav>MENU<div>x</div></nav>text") == "text"


def test_deep_pages_are_aligned():
    page = lambda text, depth: h.parse("<div><p>same</p>" * depth + f"<p>{text}</p>" + "</div>" * depth)
    a, b = page("one", 6_000), page("two", 6_100)
    size, pairs = h.align(a, b)
    assert size == len(pairs) > 12_000
    assert h.Wrapper(["<div>" * 6_000 + "<p>site</p><p>a</p>"]).template(h.parse("<div>" * 6_000 + "<p>site</p><p>b</p>"), set()) == {}


def test_many_numbered_siblings():
    """Numbers in names don't make elements differ, and a table of many shapes is made row by row."""
    import time
    import tracemalloc

    page = lambda k: h.parse("<body>" + "".join(f"<div class='post-{k + i}'><h2>t{k + i}</h2><p>x</p></div>" for i in range(20_000)) + "</body>")
    a, b = page(0), page(70_000)
    began = time.time()
    tracemalloc.start()
    size, pairs = h.align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(pairs) == a.size
    assert time.time() - began < 30 and most < 200_000_000


def test_tables_beyond_what_is_held(monkeypatch):
    random.seed(8)
    some = lambda: h.parse("<body>" + "".join(f"<div>{'<p>a</p><h2>b</h2>' * random.randint(0, 30)}{'<ul><li>c</li><p>d</p></ul>' * random.randint(0, 9)}</div>" for _ in range(60)))
    a, b = some(), some()
    whole = h.align(a, b)
    monkeypatch.setattr(h, "TABLE", 1)
    again = h.align(a, b)
    assert whole[0] == again[0] == len(again[1])


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>"), (1, "http://a.b/", "<p>x</p>"), (2, None, None)], PAGES)
    names = ["host", "pages", "mark", "packed", "slots", "constant", "k0", "node", "home"]
    for name in names:
        df = df.withColumn(name, F.lit("z"))
    found = h.extract(df, keep=["page_id", *names]).collect()
    assert sorted((r["page_id"], r["text"], *[r[n] for n in names]) for r in found) == [(1, "x", *["z"] * 9), (1, "x", *["z"] * 9), (2, "", *["z"] * 9)]
    with pytest.raises(ValueError, match="name of a result"):
        h.extract(df, keep=["text"])
