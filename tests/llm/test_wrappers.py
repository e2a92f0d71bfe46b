"""Wrappers on hand-made pages, and main texts against the standard library's parser."""

import json
import random
import time
from html.parser import HTMLParser

from flowwatch.llm import wrappers
from flowwatch.llm.wrappers import EMPTY, Reader, align, common, expression, host_wrappers, main_texts, merge, parse, wrapper

PAGE = """<!DOCTYPE html><html><head><title>t &am</title><script>var a = "<p>no</p>";</script></head><body class="header-page">
<header><h1>Site</h1></header><nav><ul><li><a>x</a></li><li><a>y</a></li></ul></nav><div class="ad-slot ad">buy</div>
<article><header><h1>Tit&eacute;l &lt;b&gt;</h1></header><p><b>one<br>two <i>th</i>ree<p>four &amp; five</p>{more}
<div class="share">share</div><section id="comments-7"><p>reader says</p></section></article>
<aside>side</aside><div id="cookieNotice">ok?</div><form>send</form><footer>&copy; f</footer></body></html>"""


def test_inference():
    one, two = (wrapper(parse(PAGE.format(more=m))) for m in ("", "<p>six</p><p>seven</p><table><tr><td>8"))
    both = expression(merge(one, two))
    assert "(<p>" in both and ")+" in both and "(<table>" in both and ")?" in both
    slot = merge(wrapper(parse("<p>a</p>")), wrapper(parse("<p>b</p>")))
    assert expression(slot) == "<><p>#TEXT"
    same = merge(wrapper(parse("<p>a</p>")), wrapper(parse("<p> a\n</p>")))
    assert "#TEXT" not in expression(same)
    pairs = wrapper(parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>"))
    assert expression(pairs) == "<>(<h2>#TEXT<p>#TEXT)+"
    assert align([], []) == []


def test_page_text(spark):
    pages = [PAGE.format(more=m) for m in ("", "<p>six</p>", "<ul><li>s<li>t</ul>")]
    rows = [(i, f"https://a.example/{i}", p, "x") for i, p in enumerate(pages)]
    rows += [(10, None, None, "x"), (11, "http://b.example", "", "x"), (12, "http://c.example/", "just text &lt;", "x")]
    rows += [(13, "http://d.example/", "<div>" * 3000 + "deep" + "<p>er", "x"), (None, "http://a.example/0", pages[0], "x"), (0, "http://a.example/0", pages[0], "x")]
    rows += [(20 + i, f"http://e.example/{i}", f"<body><h4>Fixed line</h4><div>Text {i}</div><nav>m</nav></body>", "x") for i in range(4)]
    rows += [(30, "http://f.example", "<main><p>in main</p></main><p>out</p>", "x"), (31, "http://f.example", "<nav><p>x<article>kept</article><p>out", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = {(r.page_id, r.text) for r in main_texts(table).collect()}
    first = "Titél <b>\none two three\nfour & five"
    assert got == {
        (0, first), (None, first), (1, first + "\nsix"), (2, first + "\ns\nt"), (10, ""), (11, ""), (12, "just text <"),
        (13, "deep\ner"), *((20 + i, f"Text {i}") for i in range(4)), (30, "in main"), (31, "kept"),
    }
    assert {(r.page_id, r.text) for r in main_texts(table, bound=0).collect()} == got
    assert all(r.n_chars == len(r.text) for r in main_texts(table).collect())
    assert main_texts(table.limit(0)).collect() == []


def test_closed_deep_nesting():
    def read(page):
        return Reader(EMPTY, 0).text(parse(page))

    page = "<html><body><div><article>" + "<div>" * 65 + "{}" + "</div>" * 65 + "<p>rest</p></article></div><p>out</p>"
    assert read(page.format("deep")) == "deep\nrest"
    assert read(page.format("deep<nav><div>menu</div></nav><form>send</form>end")) == "deep\nend\nrest"
    assert read("<div>" * 70 + "<article><p>in</article>" + "</div>" * 70 + "out") == "in"


def test_layout_containers_are_kept():
    def read(page):
        return Reader(EMPTY, 0).text(parse(page))

    for name in ("has-sidebar", "content no-sidebar", "header-fixed", "entry with-comments", "sidebar", "widget"):
        assert read(f"<body><div id='page' class='{name}'><nav>m</nav><article><p>text</p></article></div></body>") == "text"
        assert read(f"<body><section class='{name}'><main><p>text</p></main></section></body>") == "text"
        assert read(f"<body><section class='{name}'><nav>m</nav><p>the text</p></section><p>end</p></body>") == "the text\nend"
    inner = "<div class='related-work'><p>work</p></div><p class='notice'>note</p><div class='ad'>buy</div><section id='comments'><p>{}</p></section>"
    assert read(f"<article><p>text</p>{inner.format('said ' * 50)}</article>") == "text\nwork\nnote"
    assert read("<div class='sidebar'><article>tease</article></div><article>the long text</article>") == "the long text"
    assert read("<body><form><p>the whole page</p></form><p>end</p></body>") == "the whole page\nend"


def texts_of(spark, pages):
    table = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(main_texts(table.repartition(3)).collect())]


def test_only_texts_of_several_different_pages_are_fixed(spark):
    body = "<body><h4>Fixed</h4>{}<div>Text {}</div></body>"
    own = ["<blockquote>said once</blockquote>", "<table><tr><td>cell</table>", "<h3>head</h3>", "", ""]
    got = texts_of(spark, [body.format(x, i) for i, x in enumerate(own)])
    assert got == ["said once\nText 0", "cell\nText 1", "head\nText 2", "Text 3", "Text 4"]
    assert texts_of(spark, [body.format("", 1)] * 5) == ["Fixed\nText 1"] * 5  # copies of one page
    # an element of the key of a fixed one isn't fixed
    two = [f"<body><div>Notice</div><p>P {i}</p><div>Text {i}</div></body>" for i in range(4)]
    assert texts_of(spark, two) == [f"P {i}\nText {i}" for i in range(4)]


def test_wrapper_chooses_below_article_and_main(spark):
    for place in ("article", "main"):
        page = f"<body><{place}><h2>Story</h2><div>Buy our paper</div><p>By <b>{{0}}</b> and {{0}}.</p>{{1}}</{place}></body>"
        pages = [page.format(f"n{i}", "<p>once</p>" if i == 2 else "") for i in range(8)]
        assert texts_of(spark, pages) == [f"Story\nBy n{i} and n{i}." + "\nonce" * (i == 2) for i in range(8)]
        # copies of one page, and a few versions of it
        whole = "Story\nBuy our paper\nBy n{0} and n{0}."
        assert texts_of(spark, pages[:1] * 8) == [whole.format(0)] * 8
        assert texts_of(spark, pages[3:]) == [whole.format(i) for i in range(3, 8)]


class Plain(HTMLParser):
    """Text of the article of a page without markup inside it but p, b and br."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        if tag == "br" and self.blocks:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_query(spark):
    from flowwatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id].html)
        plain.close()
        assert r.text == "\n".join(filter(None, (" ".join(b.split()) for b in plain.blocks)))
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_hot_host_keeps_one_wrapper(spark):
    rows = [(f"http://h.example/{i}", f"<article><p>{i}</p></article>") for i in range(400)] + [("http://g.example/", "<p>1</p>")]
    found = host_wrappers(spark.createDataFrame(rows, "url string, html string").repartition(9)).collect()
    assert {(r.host, r.pages) for r in found} == {("h.example", 400), ("g.example", 1)}
    assert Reader  # used by the queries above


def plain_text(page):
    return Reader(EMPTY, 0).text(parse(page))


def test_attributes_are_read_one_by_one():
    page = """<article><p>one</p><p data-id="share">two</p><div data-role="dialog">three</div><p title="set class=ad here">four</p>
    <p>five <a title="the id=sidebar trick">six</a></p><p title='x' class = "ad">no</p><p CLASS=ad>no</p><p class='a' class=ad>seven</p></article>"""
    assert plain_text(page) == "one\ntwo\nthree\nfour\nfive six\nseven"


def test_head_word_of_a_class_decides():
    out = ["comment-list", "ad-1", "post-comments", "commentlist", "google-ad", "sidebar-left", "comment-body", "postComments", "site_footer"]
    kept = ["has-sidebar", "no-sidebar", "related-work", "comments-open", "with-comments", "adapter", "advice", "job-search", "shareholder"]
    for name in out:
        assert plain_text(f"<article><p>the text</p><div class='{name}'><p>x</p></div></article>") == "the text", name
    for name in kept:
        assert plain_text(f"<article><p>the text</p><div class='{name}'><p>x</p></div></article>") == "the text\nx", name
    # a heading within a line of code keeps its highlighted comment
    assert plain_text("<article><pre>a <span class='hljs-comment'># why</span></pre></article>") == "a # why"
    # comments may be longer than the text, a container of most of the text may bear any name but theirs
    assert plain_text("<body><p>text</p><ol class='comment-list'><li>" + "said " * 50 + "</ol></body>") == "text"
    assert plain_text("<body><div class='content-sidebar-wrap'><p>all of the text</p></div><p>end</p></body>") == "all of the text\nend"


def test_wrapper_grows_with_the_template_not_the_pages():
    def merged(n):
        root = None
        for i in range(n):
            heads = "".join(f"<h2 id='about-{'abcdefghij'[k % 10] * (1 + k // 10)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}'>h{i} {k}</h2><p>p{i} {k}</p>" for k in range(20))
            page = wrapper(parse(f"<body><article class='post-{i} text'>{heads}</article></body>"), str(i))
            root = merge(root, page) if root else page
        return len(json.dumps(root))

    began = time.monotonic()
    small = merged(50)
    first = time.monotonic() - began
    assert merged(2000) <= small + 400
    assert time.monotonic() - began < 41 * first * 3 + 10


def test_alignment():
    rng = random.Random(6)
    for _ in range(200):
        x, y = (tuple(rng.choices("abcde", k=rng.randrange(12))) for _ in "xy")
        exact = common(x, y)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(exact) == best[-1][-1]
        for pairs in (exact, shortcut(x, y)):
            assert all(x[p] == y[q] for p, q in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    x = tuple(f"k{i}" for i in range(20_000))
    assert len(common(x[::2] + ("z",) * 5, x)) == 10_000
    assert shortcut(tuple("abab") * 5000, tuple("ba") * 10_000)


def shortcut(x, y):
    table, wrappers.TABLE = wrappers.TABLE, 0
    try:
        return common(x, y)
    finally:
        wrappers.TABLE = table
