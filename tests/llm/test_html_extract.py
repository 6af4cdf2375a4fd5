import itertools
import random
import re
import time
from html.parser import HTMLParser

import numpy as np

from quillon.llm import html_extract as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body hidden-x>
<header><h1>Site</h1><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies; please accept them now. They help us, and you.</p></div>
<main><h1>Real &amp; true   title</h1><p>First paragraph, quite long
 and full&nbsp;of words.<br>After a break<p>Unclosed one <b>bold text.
<div class="advert"><p>Buy now! Cheap things, only today.</p></div><p>Third &lt;b&gt;.</p><ul><li>one, two</li><li>three</li></ul>
<form><label>Your mail</label><input></form></main>
<section id="comments"><h2>Comments</h2><p>Nice article, thanks a lot for that.</p></section><aside><p>Related stuff</p></aside>
<footer>&copy; 2024 Somebody</footer></body></html>"""


def test_page():
    assert X.main_text(PAGE) == "Real & true title\nFirst paragraph, quite long and full of words. After a break\nUnclosed one bold text.\nThird <b>.\none, two\nthree"


def test_odd_pages():
    assert X.main_text(None) == X.main_text("") == X.main_text("<p> </p><script>x") == X.main_text("<!-- never closed") == ""
    assert X.main_text("plain text, no tags") == "plain text, no tags"
    for page in ("<p>a<p>b</div></ul><li>c", "<<p>>x", "<a href='x>y'>z</a> words", "<p " * 500, "<div>" * 3000 + "deep" + "</div>" * 3000):
        assert isinstance(X.main_text(page), str)
    assert X.main_text("<article><p>1 &lt; 2 &am &amp &#233; &bogus;</p></article>") == "1 < 2 &am & é &bogus;"


def said(page):
    return [b.text for b in X.blocks_of(page)]


def test_unseen_elements_end_as_the_markup_says():
    three = "<p>one<p>two<p>three"
    for before in ("<p hidden>x", "<svg/>", "<svg />", "<math/>", "<button>Buy", "<select><option>a<option>b", "<audio src=x>", "<div><button>x</div>", "<ul><li hidden>x</ul>", "<div><span hidden>x</div>", "<div hidden><div>x</div>y</div>", "<svg><title>t</title><path/></svg>", "<svg><g><text>x</text></g></svg>", "<button><div>x</div></button>"):
        assert said(before + three) == ["one", "two", "three"], before
    assert said("<ul><li hidden>x<li>y</ul>") == ["y"] and said("a<p hidden>b</p>c") == ["a", "c"]
    assert said("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>") == ["b", "d"]
    assert said("<object><script>var a = '</object>'</script>x</object><p>y") == ["y"] and said("<style>p</style  ><p>y") == ["y"]


def test_attributes_and_references():
    assert said("<p class=it's>Middle</p><p title='a>b' x=\"c>d\">End") == ["Middle", "End"]
    assert said("AT&<b>amp;</b> T, &amp;<b>lt;</b> &l<!-- -->t;") == ["AT&amp; T, &lt; &lt;"]
    assert said('<p class="open>x</p><p>y') == ["x", "y"] and said("1 < 2 <p>a<3") == ["1 < 2", "a<3"]


class Plain(HTMLParser):
    """Another reader of well-formed pages: text by blocks, unseen elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.now, self.unseen = [], "", 0

    def cut(self):
        if self.now.split():
            self.found.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in X.EMPTY:
            self.now += " " if tag == "br" else ""
        elif self.unseen or tag in X.UNSEEN or dict(attrs).get("hidden", 0) is None:
            self.unseen += 1
            self.cut() if tag in X.BLOCKS else None
        elif tag in X.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if self.unseen:
            self.unseen -= tag not in X.EMPTY
        elif tag in X.BLOCKS:
            self.cut()

    def handle_data(self, data):
        self.now += "" if self.unseen else data


def test_blocks_are_those_of_another_reader():
    r = random.Random(8)

    def piece(depth):
        kind = r.choice(["div", "section", "p", "span", "b", "svg", "button", "text", "text", "br"])
        if kind == "text" or depth > 5:
            return r.choice(["word ", "a &amp; b ", "&eacute;t&#233; ", " \n ", "x<y "]) if depth else ""
        if kind == "br":
            return "<br>"
        inner = "".join(piece(depth + 1) for _ in range(r.randint(0, 4))) if kind not in ("p", "button", "svg") else "some words"
        attributes = r.choice(["", " hidden", " class=it's", ' title="a > b"', " data-x='<i>'"])
        return f"<{kind}{attributes}>{inner}</{kind}>"

    for _ in range(400):
        page = "".join(piece(0) for _ in range(4)).replace("x<y", "x&lt;y")
        page = re.sub(r"<(span|b|svg|button) hidden", r"<\1", page)
        other = Plain()
        other.feed(page)
        other.close()
        other.cut()
        assert said(page) == other.found, page


def test_deep_pages_take_linear_time():
    began = time.process_time()
    deep = "".join(f'<div class="c{i}">word {i}, ' for i in range(20_000))
    assert len(X.blocks_of(deep)) == 20_000 and isinstance(X.main_text(deep), str)
    assert time.process_time() - began < 20  # seconds; a quadratic reader takes minutes


def test_blocks():
    found = X.blocks_of("<table><tr><td>a<td>b<tr><td>c</table><p>d<ul><li>e<ul><li>f</ul><li>g</ul>")
    assert [b.text for b in found] == list("abcdefg") and found[1].tag == "td" and found[5].tags >= {"ul", "li"}


def test_long_page():
    body = "".join(f"<p>Paragraph {i}, with some words in it.</p>" for i in range(4000))
    assert X.main_text(f"<nav><a href=x>Menu</a></nav><article>{body}</article>").count("\n") == 3999


def energy(label, gain, edges):
    return sum(-g for on, g in zip(label, gain, strict=True) if on) + sum(w for a, b, w in edges if label[a] != label[b])


def test_cut_is_minimal():
    r = np.random.default_rng(4)
    for _ in range(150):
        n = int(r.integers(1, 9))
        gain = r.normal(0, 2, n)
        edges = [(a, b, float(r.exponential(1.0))) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        label = X.minimum_cut(gain, edges)
        least = min(energy(x, gain, edges) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(label, gain, edges) - least) < 1e-6


def test_classifier_on_unseen_pages():
    w, right, n = X.classifier(), 0, 0
    for blocks, y in X.written_pages(60, seed=99):
        keep = X.minimum_cut(np.clip(X.block_features(blocks) @ w, -12, 12), X.ties(blocks, X.CutSettings()))
        right, n = right + (keep == (y == 1)).sum(), n + len(y)
    assert right / n > 0.97


def test_table(spark):
    rows = [(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (2, None, None, "own"), (None, "v", "", None)]
    df = X.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert df.columns == ["page_id", "url", "text"]
    got = df.collect()
    assert len(got) == 4 and got[0].text == got[1].text == X.main_text(PAGE) and got[2].text == got[3].text == ""
    assert X.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
