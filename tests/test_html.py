"""Anchors, titles and character references against Python's own parser."""

import html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from clausebase.functions import html as pages
from clausebase.functions import urls

VOID = set(pages.VOID)
SILENT = {"script", "style"}


class Anchors(HTMLParser):
    """href and text of each anchor; an anchor ends with its end tag, the next anchor, or an element that was opened before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.stack = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            return
        if tag == "a":
            self.finish()
            self.open, self.stack = (dict(attrs).get("href"), []), []
        elif self.open and tag not in VOID:
            self.stack.append(tag)
        if self.open and tag != "a":
            self.open[1].append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open or tag in VOID | SILENT:
            return
        self.open[1].append(" ")
        if tag == "a" or tag not in self.stack:
            self.finish()
        else:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):  # a script or style says nothing
        if self.open and not self.cdata_elem:
            self.open[1].append(data)

    def finish(self):
        if self.open and self.open[0] is not None:
            self.found.append((self.open[0].strip(), " ".join("".join(self.open[1]).split())))
        self.open = None


def brute(page):
    reader = Anchors()
    reader.feed(page)
    reader.close()
    reader.finish()
    return reader.found


def anchors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, page string").select("k", pages.anchors(F.col("page")).alias("a")).collect()
    return [None if r.a is None else [(x.href, x.text) for x in r.a] for r in sorted(rows, key=lambda r: r.k)]


def test_anchors_of_all_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = table.select("html", pages.anchors(F.col("html")).alias("a")).collect()
    assert sum(len(r.a) for r in got) > 1000
    for r in got:
        assert [(x.href, x.text) for x in r.a] == brute(r.html)


def test_anchors_of_random_markup(spark):
    parts = ["<p>", "</p>", "<b>", "</b>", "<div class='a>b'>", "</div>", "<br>", "<img alt=\"<a href=no>\" src=x>", "<!-- <a href=no>no</a> -->", "<script>if (a<b) '<a href=no>'</script>", "<style>a{}</style>",
        "<a href=one>", "<A HREF='t w o'>", '<a data-href="no" href = "three?a=1&amp;b=2&amp;c=3">', "<a name=z>", "<a href=four title='it>s'>", "</a>", "</A >", "word", " &amp; ", "&nbsp;", "&#233;", "&#x20AC;", "&notit;", "a < b", "<abbr>", "</abbr>", "\n"]
    dice = random.Random(7)
    texts = []
    for _ in range(300):
        picked, open_tags = [], []
        for part in dice.choices(parts, k=dice.randrange(1, 25)):
            name = re.match(r"<(/?)(p|b|div|abbr)\b", part)
            if name and name[1]:  # end tags of elements that were never opened are another matter
                if name[2] not in open_tags:
                    continue
                open_tags.remove(name[2])
            elif name:
                open_tags.append(name[2])
            picked.append(part)
        texts.append("".join(picked))
    for text, found in zip(texts, anchors(spark, texts), strict=True):
        assert found == brute(text), text


def test_broken_pages(spark):
    cases = {
        "": [],
        "<a href=x>open": [("x", "open")],
        "<ul><li><a href=x>one<li><a href=y>two</ul>three": [("x", "one"), ("y", "two")],
        "<p><a href=x>in</p>out</a>": [("x", "in")],
        "<!-- <a href=x>never closed</a>": [],
        "<a href=x>a</a><script><a href=y>b</a>": [("x", "a")],
        "<a href=x>a</a><a href=y": [("x", "a")],
        "<a href=x href=y>last</a>": [("y", "last")],
        "<a href>none</a><a>none</a>": [("", "none")],
        "<<!-- -->a href=x>text</a>": [],
        "<a href='/r?x=1&copy=2&lt=3&amp;y'>&lt;b&gt;&ampx</a>": [("/r?x=1&copy=2&lt=3&y", "<b>&x")],
    }
    assert anchors(spark, [None, *cases]) == [None, *cases.values()]
    # linear: two megabytes of each
    for piece in ("<a ", "<a href=x>", "<b>x</b>", "&amp;", "<", '<a href="', "<!--"):
        assert len(anchors(spark, [piece * (2_000_000 // len(piece))])) == 1


def test_character_references(spark):
    dice = random.Random(3)
    texts = [f"&#{n};" for n in (*range(0, 300), 0xD800, 0xFDD0, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**12)] + [f"x&#X{n:x}y" for n in (0x80, 0x20AC, 0x1F600)]
    texts += [f"&{name}" for name in dice.sample(sorted(html.entities.html5), 400)] + [f"&{name}z1" for name in dice.sample(sorted(html.entities.html5), 100)]
    texts += ["", "&", "&&amp;&", "&;", "&#;", "&#x;", "&#xg", "a&b", "&amp=1", "&AMP", "&nosuchname;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", pages.unescaped(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.u == html.unescape(texts[r.k]), texts[r.k]


def test_titles(spark):
    cases = {"<title>A &amp; B</title>": "A & B", "<!-- <title>no</title> --><h1>Head &#233;</h1>": "Head é", "<script>'<title>no</title>'</script><h2 class=a>Two</h2>": "Two", "<title> </title><header>no</header>": "section-9"}
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", urls.page_title(F.col("t"), F.lit("9")).alias("u")).collect()
    assert {r.k: r.u for r in rows} == dict(enumerate(cases.values()))
