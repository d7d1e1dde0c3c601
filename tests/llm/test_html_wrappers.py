"""Main text of pages: hand-made pages, wrapper inference, and an independent parser on the whole table."""

from html.parser import HTMLParser

from weftbook.llm import html_wrappers as w
from weftbook.llm.queries import QUERIES


class Article(HTMLParser):
    """Text of the article element, a line per block: a plain reading of the test pages."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(x.split()) for x in self.lines) if t)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op3_host_wrappers"](spark, folder).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        reader = Article()
        reader.feed(pages[r.page_id].html)
        reader.close()
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, reader.text(), len(reader.text()))


def text(page):
    known = w.Knowledge()
    known.add_page(page)
    return w.main_text(page, known.roles())


def test_hand_made_pages():
    full = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<article>no</article>")</script></head><body class="has-sidebar">
    <header class="site-header"><a href=/>Home</a></header><nav>Menu</nav><div id="cookie-notice">We use cookies</div>
    <main><article class="post"><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>&nbsp;two<br>three<!-- no --> four</p>
    <div class="ad">Buy</div><aside>Side</aside><p>Last</p><form><input value=x>Your mail</form><ul><li>a<li>b</ul>
    <section class="comments"><article class="comment"><p>First!</p></article></section><footer>Posted by</footer></article></main>
    <div class="sidebar"><p>Other</p></div><footer>(c)</footer></body></html>"""
    assert text(full) == "Head&line\nOne bold two three four\nLast\na\nb"
    assert text("") == "" and text("<p></p>") == "" and text("plain < text & more") == "plain < text & more"
    assert text("<body><p>x<p>y &lt;b&gt; &#233; &copy z</body>") == "x\ny <b> é © z"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("<article>a<script>never closed </p> b") == "a"
    assert text('<article><a title="a > b">x</a><p class=\'ad\'>no</p>y</article>') == "x\ny"
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>words without links</p>") == "words without links"
    assert text('<div class="post-content">in</div><p>out</p>') == "in"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_wrappers_fold_repeat_and_option():
    page = lambda n, extra: ["ul", *["li", "#", "/li"] * n, "/ul", *extra, "p", "#", "/p"]
    both = w.merged(w.folded(page(3, [])), w.folded(page(1, ["hr"])))
    assert w.written(both) == "ul ( li # /li )+ /ul ( hr )? p # /p"
    assert w.merged(both, w.folded(page(7, ["hr"]))) == both
    assert w.written(w.folded(["p", "#", "/p"] * 4)) == "( p # /p )+"


def test_constant_text_of_a_host_is_dropped_without_article(spark):
    rows = [(i, f"http://h/{i}", f"<div class=x>Same words</div><div class=y>Story number {i}</div>", 1) for i in range(8)]
    rows += [(None, None, None, 1), (20, "odd url", "<p>alone", 1), (20, "odd url", "<p>alone", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = w.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id is None, r.page_id, r.text) for r in found.collect()), key=repr)
    want = [(False, i, f"Story number {i}") for i in range(8)] + [(False, 20, "alone")] * 2 + [(True, None, "")]
    assert got == sorted(want, key=repr)
    assert w.extract(pages.filter("false")).count() == 0


def test_copies_of_a_page_are_no_constant_text(spark):
    story = "<div class=x>Same words</div><div class=y>One story</div>"
    rows = [(i, "http://h/", story) for i in range(7)] + [(i, None, f"<!-- {i} -->{story}") for i in range(7, 14)]
    found = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in found] == ["Same words\nOne story"] * 14
    known, other = w.Knowledge(), w.Knowledge()
    for page in [story] * 9:
        known.add_page(page)
    for i in range(3):
        other.add_page(f"<div class=x>Same words</div><div class=y>Story {i}</div>")
    known.absorb(w.Knowledge.load(other.dump()))
    assert "drop" not in known.roles().values()  # four different pages
    known.add_page("<div class=x>Same words</div><div class=y>Story 3</div>")
    assert known.roles() == {"div.x": "drop", "div.y": "other"}


def test_names_with_an_aside_word_drop_no_article_text():
    article = """<article class="post comments-open" id="reply-to-all"><h2 id="related-work">Related work</h2><p>one</p><section id="discussion"><h3 class="t">Deep</h3>
    <p>two</p></section><h2 id="search">Search</h2><div class="long-form">three</div><section id="notice-of-changes">four</section>
    <div class="section" id="form">five</div><p id="alert">six</p><div id="social">seven</div>
    <div class="related-posts">no</div><div class="ad ad-3">no</div><div id="comments">no</div><ul class="share-buttons"><li>no</ul>
    <article id="comment-12">no</article></article>"""
    assert text(article).split() == "Related work one Deep two Search three four five six seven".split()
    assert text('<div class="long-form">kept</div><div id="site-nav">no</div><div class="sidebar-2">no</div>') == "kept"


def test_figures_of_the_host_confirm_a_drop():
    pages = [
        f'<article><p>Story {i}</p><div class="promo-x"><b>Join</b><p>today</p></div><div class="ad-hoc">Text {i}</div><h2 id="form">Form</h2></article>'
        for i in range(6)
    ]
    known = w.Knowledge()
    for page in pages[:4]:
        known.add_page(page)
    assert w.main_text(pages[0], known.roles()) == "Story 0\nJoin\ntoday\nText 0\nForm"
    for page in pages[4:]:
        known.add_page(page)
    assert w.main_text(pages[0], known.roles()) == "Story 0\nText 0\nForm"
    linked = w.Knowledge()
    linked.add_page('<article>words<div class="related-x"><a href=1>one</a> <a href=2>two</a></div></article>')
    assert "drop" in linked.roles().values()


def test_place_in_the_wrapper_decides(spark):
    head, again = "<div class=x>Same words</div>", "<div class=z><h3>Printed</h3>again</div>"
    rows = [(i, "http://h/", f"{head}{again if i % 2 else ''}<div class=y>Story {i}</div>") for i in range(14)] + [(14, "http://h/", None)]
    found = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: ("Printed\nagain\n" if i % 2 else "") + f"Story {i}" for i in range(14)} | {14: ""}


def test_fixed_slots():
    wrapper = ["div.a", "h0", "#", "/h0", ["+", "p", "#", "/p"], ["?", "div.b", "#", "/div"], "/div", ["?", "ul"], ["+", "li", "#"], ["?", "/ul"], "#"]
    assert w.fixed_slots(wrapper) == {"div.a h0", "div.a"}
    unclosed = ["div.a", ["?", "/div"], "h0", "#", "/h0"]
    assert w.fixed_slots(unclosed) == set()
    known = w.Knowledge()
    for n in (1, 3, 2):
        known.add_page("<body>" + "<ul>" + "<li>x" * n + "</ul><p>a<table><tr><td>b<td>c</table>")
    assert set(known.slots) == w.fixed_slots(known.wrapper) == {"body ul li", "body", "body table tr td"}
