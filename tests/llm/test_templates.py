from html.parser import HTMLParser

import pandas as pd
import pytest

from quillmesh.llm import templates as t


class _Article(HTMLParser):
    """Paragraphs of the article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append("")
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1"):
            self.parts.append("")
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.parts[-1] += data


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in t.main_text(pages).collect()}
    for r in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").itertuples():
        p = _Article()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n\n".join(x for x in (" ".join(s.split()) for s in p.parts) if x)


def _page(k, body):
    return f"<html><head><title>t{k}</title></head><body><div class=top><span>Site name</span></div><div class='content'><p>Read our best stories</p>{body}</div><div class=sidebar>links</div><div>Copyright all rights</div></body></html>"


def test_template_without_article():
    htmls = [_page(k, f"<p>story {k} is about t{k * 7}</p><p>and goes&nbsp;on  &amp; on{k}</p>") for k in range(6)]
    assert t.main_texts(htmls) == [f"story {k} is about t{k * 7}\n\nand goes on & on{k}" for k in range(6)]
    everywhere, _ = t.template([t.parse(h) for h in htmls])
    words = {x[0] for x in everywhere}
    assert {"Site", "Copyright", "rights", "<"} <= words and "story" in words and "t7" not in words


def test_template_inside_the_article():
    line = "<div class=x>Send this page to your friends</div>"
    some = "<section class=y><b>Also</b> <i>see</i> <u>this</u></section>"
    story = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    htmls = [f"<div>Site</div><article><h1>t{k}</h1><p>the story {story(k)}</p>{line}{some if k % 2 else ''}</article>" for k in range(8)]
    assert t.main_texts(htmls) == [f"t{k}\n\nthe story {story(k)}" for k in range(8)]


@pytest.mark.parametrize("others", [0, 6])
def test_copies_of_an_article_stay(others):
    shared = "a text with a title that all of these pages carry as it is and as it was"
    copies = [f"<article><h1>One title here</h1><p>{shared}</p><p>on day {k}</p></article><div>{k}</div>" for k in range(4)]
    other = [f"<article><h1>t{k}</h1><p>u{k} v{k}</p></article>" for k in range(others)]
    assert t.main_texts(copies + other)[:4] == [f"One title here\n\n{shared}\n\non day {k}" for k in range(4)]


def test_marked_and_bare_pages_of_a_host():
    htmls = [_page(k, f"<p>story {k} is about t{k * 7}</p>") for k in range(4)] + [f"<article><p>own text {k} of t{k * 9}</p></article>" for k in range(4)]
    assert t.main_texts(htmls) == [f"story {k} is about t{k * 7}" for k in range(4)] + [f"own text {k} of t{k * 9}" for k in range(4)]


@pytest.mark.parametrize("pages,partitions", [(49, 1), (50, 1), (97, 1), (98, 2), (40, 20)])
def test_last_pages_of_a_host_have_a_template(spark, pages, partitions):
    rows = [(k, "http://h.org/x", _page(k, f"<p>story {k} is about t{k * 7}</p>")) for k in range(pages)]
    got = t.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), partitions).collect()
    assert {r.page_id: r.text for r in got} == {k: f"story {k} is about t{k * 7}" for k in range(pages)}


def test_nested_class_stands_in_one_slot():
    box = "<section class=box><b>Also</b> <i>see</i> <u>this</u></section>"
    htmls = [_page(k, f"<p>text{k} x{k}</p>" + (box if k % 2 else "")) for k in range(8)]
    everywhere, nested = t.template([t.parse(h) for h in htmls])
    assert any({"Also", "see", "this"} <= {x[0] for x in c} for c in nested)
    assert t.main_texts(htmls)[1] == "text1 x1"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; words", "plain <b> words"),
        ("<article>a<script>x</script>b<!-- c --><p>d<br>e<p>f<style>y</style></article><footer>z</footer>", "ab\n\nd e\n\nf"),
        ("<article><header>h</header><p>x</p><div class='ad-slot'>buy</div><form>q</form><div id=comments><article>me</article></div><aside>s</aside></article>", "x"),
        ("<main><p>one</p><nav>n</nav><ul><li>two<li>three</ul></main>", "one\n\ntwo\n\nthree"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article><h1>T</h1><div class='cookie notice'>ok</div><p title='a>b'>v</p>", "T\n\nv"),
    ],
)
def test_single_pages(html, text):
    assert t.main_texts([html]) == [text]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div class='layout has-sidebar'><article><p>one</p></article></div><footer>f</footer>", "one"),
        ("<article class='post with-comments'><p>one</p><div class=comments>me</div></article><article class=teaser>t</article>", "one\n\nt"),
        ("<div id='content-side'><main><p>one two</p></main></div><div>rights</div>", "one two"),
        ("<div id=social-share><article>one two three</article></div><article>t</article>", "one two three\n\nt"),
        ("<article class='sponsored post'>one two three</article><div>rights</div>", "one two three"),
        # an element of its own kind stays out
        ("<article>one</article><div class=comments><article class=comment>much longer than it</article></div>", "one"),
        ("<article>one two three<div class=share>send</div></article><div class=sidebar><article>hint</article></div>", "one two three"),
        ("<div><p>one two three four</p></div><div class=comments><article>me</article></div>", "one two three four"),
    ],
)
def test_names_do_not_exclude_the_article(html, text):
    assert t.main_texts([html]) == [text]


@pytest.mark.parametrize("depth", [0, 500, 510, 511, 512, 513, 514, 600, 3000])
def test_marks_count_at_any_depth(depth):
    deep = lambda x: "<div>" * depth + x + "</div>" * depth
    menu = "<nav><div><b>home</b></div><p>about<p>more</nav><div class=comments><div>me</div></div>"
    assert t.main_texts([f"<article>{deep(menu + '<p>one</p>')}<p>two</p></article><p>three</p>"]) == ["one\n\ntwo"]
    assert t.main_texts([deep(f"<div>rights</div><article><p>one</p>{menu}</article><p>three</p>")]) == ["one"]


def test_table(spark):
    rows = [(k % 90, None if k == 3 else f"http://h{k % 2}.org/x", f"<article><p>p{k}</p></article>", "s") for k in range(150)] + [(7, "no host", "", "s"), (None, "http://h0.org", None, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt string")
    got = t.main_text(pages, 3)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 152
    assert sorted(r.text for r in got.collect()) == sorted([f"p{k}" for k in range(150)] + ["", ""])
    assert t.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<a " * 100_000, "<div>" * 50_000 + "x", "<a \"" * 50_001 + ">", "</script " * 50_000, "<script>" + "</scrip" * 50_000, "< <! <? <" * 30_000, "<!--" * 60_000, "<p>w " * 50_000, "<a title='\">" * 30_000])
def test_time_is_linear_in_the_page(html):
    import time

    began = time.perf_counter()
    t.main_texts([html])
    assert time.perf_counter() - began < 5


def test_tags_with_quotes():
    page = t.parse("<article><p title=\"a > b\" class='x'>one</p><p>1 < 2 <3 <b title=\"open>bold</b> end</p><!-- no --><![CDATA[no]]><script>if (a</b) {}</script></article>")
    assert [b.text for b in page.blocks] == ["one", "1 < 2 <3 bold end"]
    assert t.parse("a <b").blocks[0].text == "a <b"


def test_groups_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one, two = (sorted((r.page_id, r.text) for r in t.main_text(pages, n).collect()) for n in (1, 7))
    assert one == two


def test_paths_of_deep_and_long_names_stay_small():
    import tracemalloc

    names = ["n" * 2000 + str(k) for k in range(300)]
    html = "".join(f"<div class={n}>" for n in names) + "<p>one two</p>" * 20
    tracemalloc.start()
    page = t.parse(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(html) and page.blocks[0].path == (*(f"div.{n}" for n in names), "p")
    other = t.parse(html.replace(names[0], names[0] + "x"))
    assert {x[1] for x in page.blocks[0].words}.isdisjoint(x[1] for x in other.blocks[0].words)


def test_a_paths_string_is_hashed_once():
    """Sets and counters of tokens hash no tuple of names; strings keep their hash."""
    page = t.parse("<div class=a><section><p>one two</p></section></div>")
    assert all(isinstance(part, str) for token in page.tokens for part in token)
    assert len({t.parse(x).blocks[0].words[0] for x in ("<div class=ap>x", "<div class=a><p>x", "<p><div class=a>x", "<div class=a\0p>x")}) == 4
