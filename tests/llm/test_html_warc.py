import base64
import hashlib
import zlib

from isofield.llm import html_text, warc
from isofield.llm.common import scratch

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad 1 -->
<div class="ad">Buy this thing now and be happy for the rest of your long and quiet life, dear reader of ours.</div><article><header><h1>A  title&amp;more</h1></header>
<p>First <b>para</b>graph with\n words.<br>And more&nbsp;text.<p>Short.</p><aside>Aside of several words that do not belong to the text of the article at all.</aside>
<form>Name <input name=q><button>Go</button></form><div class="comments"><p>I liked this very much and will come back to read it again and again.</p></div></article>
<footer>&copy; somebody</footer></body></html>"""


def test_article_blocks():
    assert html_text.main_text(PAGE) == "A title&more\nFirst paragraph with words. And more text.\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("<article><p>cut off &am") == "cut off &am"
    assert html_text.main_text("<article><p>one<p>two <scr") == "one\ntwo"


def test_pages_without_article_elements():
    page = """<body class="has-sidebar"><div id="header"><a href=/>Home</a></div><div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div><div class="content"><h2>Title</h2>
    <p>This is a long paragraph with <a href=x>a link</a> and more than enough words to count as the text of a page.</p><p>Short one.</p>
    <p>Another long paragraph with many words in it so that its density is low and all of it is clearly text.</p></div><div id="cookie-notice"><p>We use cookies to make this site better for you and for all of your friends.</p></div></body>"""
    assert html_text.main_text(page).split("\n")[0] == "Title" and "Short one." in html_text.main_text(page)
    assert "cookies" not in html_text.main_text(page) and "Home" not in html_text.main_text(page)


LONG = "Here is a result of the search that was made by the author and told in a long sentence of text."


def test_class_words_quotes_and_wrappers():
    assert html_text.main_text(f"<article><p>One two three four.</p><p class='search-result'>{LONG}</p></article>") == f"One two three four.\n{LONG}"
    assert html_text.main_text(f"<div class='page social'><article><h1>T</h1><p>{LONG}</p></article></div>") == f"T\n{LONG}"
    assert html_text.main_text(f"<article><div data-x=it's><p>{LONG}</p></div><p title=\"x>y\">{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<div class=comments><article><p>{LONG}</p></article></div>") == ""
    assert html_text.main_text(f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><p class=ad>Buy now</p></article>") == LONG


def test_names_of_several_words():
    for name in "main-nav main-menu post-navigation postShare entry-footer content-notice story-promo article_ads reader-remark comment-text main-header".split():
        page = f"<div class='{name}'><p>{LONG}</p></div><div class='page-content has-sidebar'><p>{LONG} So.</p></div>"
        assert html_text.main_text(page) == f"{LONG} So.", name
        if name != "main-header":  # an article's own header is its own
            assert html_text.main_text(f"<article><p>One.</p><section id='{name}'><p>{LONG}</p></section></article>") == "One.", name
    for name in ("entry-content", "articleBody", "story", "post legal"):
        assert html_text.main_text(f"<div class='{name}'><p>{LONG}</p></div>") == LONG, name


def test_doubtful_names_are_decided_by_words_links_and_neighbours():
    for name in ("warning", "search-results", "section tags", "legal-text", "author"):
        assert html_text.main_text(f"<article><p>One two three.</p><div class='{name}'><p>{LONG}</p></div></article>") == f"One two three.\n{LONG}", name
        assert html_text.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>Short bit.</p></div></article>") == LONG, name
        assert html_text.main_text(f"<article><p>{LONG}</p><div class='{name}'><p><a href=x>{LONG}</a></p></div></article>") == LONG, name
    assert html_text.main_text(f"<div class='legal-text'><p>{LONG}</p></div>") == LONG
    assert html_text.main_text("<p>The moon is up</p><p>and low the sea</p><p>lies</p>") == "The moon is up\nand low the sea\nlies"


def test_features_of_blocks_decide():
    menu = "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
    assert html_text.main_text(f"<article><p>{LONG}</p>{menu}</article>") == LONG  # the same list without links is text
    assert html_text.main_text(f"<article><p>{LONG}</p>{menu.replace('<a>', '').replace('</a>', '')}</article>") == f"{LONG}\nOne\nTwo\nThree"
    assert html_text.main_text(f"<article><p>{LONG}</p><p><a>A link alone</a></p><p>{LONG}</p></article>") == f"{LONG}\nA link alone\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}</p></article><div><p>{LONG} More.</p></div>") == LONG
    blocks = html_text.flat_blocks(f"<article><p>{LONG}</p>{menu}<p>Two words</p></article><div><p>Other</p></div>")
    x = html_text.block_features(blocks)
    base = html_text.decide(html_text.tree(), x) >= 0.5
    x[:, [1, 3, 5]] = 0
    assert ((html_text.decide(html_text.tree(), x) >= 0.5) != base).any()


def test_blocks_are_those_of_a_plain_parser():
    """Texts of blocks against the parser of the standard library, over random trees of elements."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.text = [], ""

        def end(self):
            if self.text.split():
                self.blocks.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text += " "
            elif tag not in ("b", "a", "em", "code"):
                self.end()

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "em", "code", "br"):
                self.end()

        def handle_data(self, data):
            self.text += data

    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word ", "two words", " a &amp; b", "&lt;p&gt;", " ", "é\n\tx", "<br>"])
        name = rng.choice(["div", "p", "ul", "li", "section", "b", "a", "em", "code", "h2", "table", "td", "blockquote"])
        return f"<{name} title='x>y'>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{name}>"

    for _ in range(300):
        page = "".join(tree(5) for _ in range(3))
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.end()
        assert [b[0] for b in html_text.flat_blocks(page)] == plain.blocks, page


def test_long_pages_and_repeated_rows(spark):
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(20_000))
    want = "\n".join(f"{LONG} {k}" for k in range(20_000))
    rows = [(None, None, f"<nav><a>x</a></nav><article>{body}</article>")] * 2 + [(7, "u", None)] * 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(want), len(want)] and all(r.text in ("", want) for r in got)


def test_varied_pages_with_known_articles():
    """Wrappers, chrome and articles in every combination; what the article says is known."""
    wrappers = [("<article>", "</article>"), ("<main role=main>", "</main>"), ("<div class='wrap social'><article>", "</article></div>"), ("<div id=content class='post'>", "</div>")]
    articles = [(f"<h1>Head of it</h1><p>{LONG}</p><p>Another {LONG}</p>", f"Head of it\n{LONG}\nAnother {LONG}"),
                (f"<h2>Two &amp; two</h2><p>{LONG} <a href='/x'>Link</a> and on.<ul><li>{LONG}<li>{LONG}</ul>", f"Two & two\n{LONG} Link and on.\n{LONG}\n{LONG}"),
                (f"<p data-a=it's>{LONG}<br>{LONG}</p><blockquote>{LONG}</blockquote><div class=ad>Buy this</div>", f"{LONG} {LONG}\n{LONG}"),
                (f"<p>{LONG}</p><table><tr><td>{LONG}</table><form>Your name <input></form><section class='comments'><p>{LONG} I liked it.</p></section>", f"{LONG}\n{LONG}")]
    chrome = [("<nav><a href=/>Home</a> <a href=/b>News</a></nav>", "<footer>All rights</footer>"),
              ("<div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div><div id=cookie-notice><p>We use cookies to make this site better for you and your friends.</p></div>", "<aside><p>More of the things that you may want to read some day when it rains.</p></aside>"),
              ("<script>if (a<b) '<p>x'</script><header><h1>Site</h1></header>", "<div class='sidebar'><p>Popular things that many people read this week and the week before.</p></div>")]
    pages = [(top + a + text + b + bottom, want) for a, b in wrappers for text, want in articles for top, bottom in chrome]
    assert len(pages) == 48
    assert [html_text.main_text(f"<html><body>{x}</body></html>") for x, _ in pages] == [want for _, want in pages]


def test_the_tree_knows_its_table():
    import numpy as np

    table = np.array(html_text.LABELLED, float)
    assert ((html_text.decide(html_text.tree(), table[:, :-1]) >= 0.5) == (table[:, -1] == 1)).mean() >= 0.95


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 4), (2, None, None, 5), (None, "v", "", 6)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(1, "http://www.b.org/x", "same é"), (2, "https://a.b.org:8080/y?q#f", "same é"), (3, None, None), (4, "nonsense url\n", ""), (5, "http://b.org/x", "big" * 50_000), (6, "http://b.org/x", "own"),
            (2, "http://c.org", "same é"), (None, "http://d.org", "own")]
    rows += [(100 + k, f"http://h{k % 7}.example.com/p/{k}", "copy" if k % 3 else f"page {k}") for k in range(5000)]
    big = (1 << 53) + 1
    rows += [(big, "http://big.org/1", "of large ids"), (big + 2, "http://big.org/1", "of large ids"), (-big, None, "of large ids"), (6, "http://b.org/x", "own")]
    path, pages = scratch(spark, "test"), spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.archive(pages, path)
    got = warc.read_pages(directory, pages).collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[digest(h)] = max(best.get(digest(h), -1), i)
    want = [(i, len((h or "").encode()), digest(h), *(("revisit", best[digest(h)]) if i is not None and i < best[digest(h)] else ("response", None)), u) for i, u, h in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert directory.count() > 1
    asked = spark.createDataFrame([("http://b.org/x",), ("http://h3.example.com/p/3",), ("http://absent.org/",)], "url string")
    found = warc.look_up(directory, asked).collect()
    assert sorted((r.url, r.page_id) for r in found) == [("http://b.org/x", 5), ("http://b.org/x", 6), ("http://b.org/x", 6), ("http://h3.example.com/p/3", 103)]
    read = warc.Reader()
    assert all(warc.parse(zlib.decompress(read(r.archive, r["at"], r["size"]), 31))["page_id"] == r.page_id for r in found)


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(warc.archive(none, scratch(spark, "none")), none).count() == 0


def test_warc_with_many_groups_and_blocks(spark, monkeypatch):
    """Beyond the broadcast bound, with keys that fill several blocks and files."""
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(warc, "BLOCK_LINES", 50)
    rows = [(k, None if k % 3 else f"http://h.org/{k % 5}", f"text {k % 40}" if k % 4 else None) for k in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    top = {h: max(i for i, _, x in rows if x == h) for _, _, h in rows}
    got = warc.read_pages(warc.archive(pages, scratch(spark, "many")), pages).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.url) for r in got} == {(i, "response" if i == top[h] else "revisit", None if i == top[h] else top[h], u) for i, u, h in rows}
    assert len(got) == 900


def test_keys_sort_hosts_together():
    assert warc.url_key("http://www.b.example.org:80/x?y#z") == "org,example,b)/x?y"
    assert warc.url_key(None) == ")/" and warc.url_key("a.org") == "org,a)/"
