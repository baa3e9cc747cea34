"""Pages read in the JVM against the parser, and against the library's table of character references."""

import html as library
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewake.functions import html
from tidewake.functions import text as tx

SF = "/root/testdata/sf0.01"

PAGES = [
    "", "plain", "a<b>c</b>d", "<p>one<p>two", "x<br>y<br/>z<BR />w", "<ul><li>one</li><li class='x'>two</ul>", "<h1>T</h1><h5>no</h5><lister>no</lister>",
    "<head><title>no</title><meta charset=utf-8></head>yes", "<head>to the end", "<HEAD profile='x>y'>no</HEAD>yes", "<header>yes</header>",
    "a<script>if (a<b) '</p>' && \"<!--\"</script>b<!-- c -->d", "a<style>p{}</style >b", "<script>never ends <p>", "<SCRIPT src='a'></SCRIPT>x", "a<!-- <p> -- >b", "<!DOCTYPE html>x",
    "<a href=\"x>y\">link</a>", "<a title='it > is'>link</a>", "<a href=x/y>link</a>", "1 < 2 & 3 > 2", "a <b", "a </b", "a<", "<>x", "cut <a href='x", "cut <p",
    "&lt;p&gt; &amp;amp; &AMP; &copy &copy; &notit; &notin; &hellip;&nbsp;.", "&am", "&amp", "&", "&;", "&#", "&#x;", "&#65;&#x41;&#x1F600;&#128;&#150;&#0;&#13;&#1;&#xD800;&#x110000;&#99999999999999;&#00065",
    "&am<b>p;</b>", "&CounterClockwiseContourIntegral;", "&nosuchname; &nosuchname", "A&ampB &ltx &gtx &quotx", "tab&Tab;", "<div>\n  a\t b \n\n\n\n c</div>", "<td>a</td><tr>b</tr>",
    "<blockquote>q</blockquote><table><tr><td>x</table>", "</p>", "</script>x", "</head>x", "<p a=1 b='2' c>t</p>", "日本<b>語</b>&eacute;",
]


def native(spark, pages, make=html.text_of):
    rows = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    return [r.t for r in rows.select("id", make(F.col("html")).alias("t")).orderBy("id").collect()]


def test_pages_read_as_the_parser_reads_them(spark):
    got = native(spark, PAGES)
    want = [tx._page(p)[0] for p in PAGES]
    assert [(p, g) for p, g in zip(PAGES, got, strict=True)] == [(p, w) for p, w in zip(PAGES, want, strict=True)]


def test_given_pages_read_as_the_parser_reads_them(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", html.text_of(F.col("html")).alias("a"), tx.rendered(F.col("html"))["text"].alias("b"))
    assert pages.where("a <> b").isEmpty() and pages.count() > 100


def test_all_references_are_known(spark):
    names = sorted(library.entities.html5)
    texts = ["&" + n for n in names] + [f"&{n}x;" for n in names if not n.endswith(";")] + [f"&#{k};" for k in [*range(0, 260), 0xFDD5, 0xFFFE, 0x1FFFF, 0x10FFFF]]
    assert native(spark, texts, html.unescaped) == [library.unescape(t) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_random_references(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["&", "amp", "lt", "not", "in", ";", "#", "x", "4", "1", " ", "copy", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert native(spark, texts, html.unescaped) == [library.unescape(t) for t in texts]


@pytest.mark.parametrize("page", ["<p>" * 100_000, "<a" + " b='c'" * 100_000 + ">x</a>", "&amp;" * 100_000, "<!-- " * 100_000, "<script>" * 100_000, "<p " * 100_000 + ">", "<a " * 100_000, "<li>a" * 50_000, "=" * 100_000, "<" * 100_000])
def test_long_pages_take_linear_time(spark, page):
    began = time.perf_counter()
    native(spark, [page])
    assert time.perf_counter() - began < 20


def test_null_pages_are_empty(spark):
    assert native(spark, [None]) == [""]
    df = spark.createDataFrame([(" \n", "<p>shown"), ("own", "<p>page"), (None, None)], "t string, h string")
    assert [r[0] for r in df.select(tx.stripped(html.chosen_body(F.col("t"), F.col("h")))).collect()] == ["shown", "own", ""]


def test_a_page_that_the_parser_refuses(monkeypatch):
    monkeypatch.setattr(tx._Events, "feed", lambda self, page: 1 / 0)
    assert tx._page("a<b>c") == ("a c", [], [], [], [])


def test_of_repeated_targets_the_last_counts():
    assert tx._page("<a href='mailto:x' href='http://y'>t</a>")[3] == [0] and tx._page("<a href='http://y' href='mailto:x'>t</a>")[3] == []
