"""Expressions against their plain-Python meaning."""

import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tabbyline.functions import html as H
from tabbyline.functions import text as T
from tabbyline.functions import vectors as V


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


TEXTS = ["", " a ", "\n\t a b 　", "\x1cx\x85", "é  ü\nß", None, " ", "word " * 50]


def test_strip_and_words(spark):
    assert values(spark, TEXTS, T.py_strip(F.col("x"))) == [t if t is None else t.strip() for t in TEXTS]
    assert values(spark, TEXTS, T.word_count(F.col("x"))) == [t if t is None else len(t.split()) for t in TEXTS]


def test_slugs_and_names(spark):
    urls = ["https://a.example/x/y/", "https://a.example/x/y?z=1", "y", ""]
    assert values(spark, urls, T.url_slug(F.col("x"))) == [u.strip("/").split("/")[-1] for u in urls]
    assert values(spark, ["American Bobtail", "Café Cat", "A  B"], T.name_slug(F.col("x"))) == ["american-bobtail", "caf-cat", "a--b"]
    assert values(spark, ["Abyssinian[1]", " X [12] ", "Y"], T.clean_name(F.col("x"))) == ["Abyssinian", "X", "Y"]


@pytest.mark.parametrize(
    "title, kind",
    [("Toxic food", "toxicology"), ("An implant", "toxicology"), ("Siamese diet", "nutrition"), ("Litter box virus", "behavior"), ("The Siamese", "breed_profile"), ("HEART", "disease"), ("Grooming", "article")],
)
def test_content_type(spark, title, kind):
    assert values(spark, [title], T.content_type(F.col("x"))) == [kind]


def test_identifiers(spark):
    names = ["", "a__0__x", "Ünïcode 猫"]
    assert values(spark, names, T.uuid5(F.col("x"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    got = values(spark, ["text"], T.chunk_id(F.lit("doc"), F.lit(3), F.col("x")))
    assert got == ["doc__3__" + hashlib.sha256(b"doc|3|text").hexdigest()[:12]]


def test_padding(spark):
    assert values(spark, ["ab", "abcdef"], T.padded(F.col("x"), 4)) == ["ab  ", "abcdef"]


PAGE = """<html><head><title> A &amp; B | Site</title><script>var a='</p><h1>no</h1>';</script><style>p{}</style></head><body><!-- <h1>old</h1> -->
<nav>Menu</nav><h1>Head &lt;1&gt;</h1><p>First<p>Second <b>bold</b><table><tr><td>a</td><td>b</td></tr></table><footer>foot</footer>"""


def test_pages(spark):
    assert values(spark, [PAGE], H.title(F.col("x"))) == ["Head <1>"]
    assert values(spark, ["<title> A &amp; B | Site</title>", "<h1> </h1><title>x</title>", "<p>none</p>", None], H.title(F.col("x"))) == ["A & B", " ", None, None]
    text = values(spark, [PAGE], H.main_text(F.col("x")))[0]
    assert [line.strip() for line in text.split("\n")] == ["Head <1>", "First", "Second bold", "a\tb"]
    assert values(spark, ["<body><article><p>only this</p></article>rest</body>", "<body></body>", "", None], H.main_text(F.col("x"))) == ["only this", None, None, None]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><aside><form>a</form> junk</aside><p>kept</p></body>", "kept"),
        ("<body><nav>a<nav>b</nav>c</nav><p>kept</p><footer>d</footer></body>", "kept"),
        ("<article><p>one</p><article>two</article><p>three</p></article><p>out</p>", "one\ntwo\nthree"),
        ("<article><header>by x</header><p>one</p><nav>menu</nav></article>", "one"),
        ("<main><p>one</p></main><p>out</p>", "one"),
        ("<body><header>never closed<p>kept</p></body>", "never closed\nkept"),
        ("<script>var a = '</style>';</script><p>kept</p>", "kept"),
        ("<body><nav>" + "<a href='x'>y</a> " * 50000 + "</nav><p>kept</p></body>", "kept"),
    ],
)
def test_main_text(spark, page, text):
    assert values(spark, [page], H.main_text(F.col("x"))) == [text]


def test_links_and_headings(spark):
    found = values(spark, ["<a href='/x'> T <b>u</b></a><a name=q>no</a><A HREF=\"y?a=1&amp;b=2\">v</A>"], H.links(F.col("x")))[0]
    assert [tuple(r) for r in found] == [("/x", "T u"), ("y?a=1&b=2", "v")]
    found = values(spark, ["<h2>a</h2><h5>b</h5><h3><a href='z'>c</a></h3>"], H.headings(F.col("x")))[0]
    assert [tuple(r) for r in found] == [("h2", "a", False), ("h3", "c", True)]


def test_resolution(spark):
    base, hrefs = "https://s.example", ["https://o.example/a", "//o.example/b", "/c", "d", "mailto:x@y", ""]
    assert values(spark, hrefs, H.resolve(base, F.col("x"))) == ["https://o.example/a", "https://o.example/b", "https://s.example/c", "https://s.example/d", "mailto:x@y", base]
    assert values(spark, hrefs[:4], H.resolve_exact(base, F.col("x"))) == ["https://o.example/a", "https://o.example/b", "https://s.example/c", "https://s.example/d"]
    assert values(spark, ["&eacute;&#39;&amp;", None], H.unescape(F.col("x"))) == ["é'&", None]


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], None, []]
    unit = values(spark, rows, V.normalized(F.col("x")), "x array<float>")
    assert [round(x, 6) for x in unit[0]] == [0.6, 0.8] and unit[1:] == [None, None, None]
    assert values(spark, rows[:2], V.cosine(F.col("x"), F.array(F.lit(1.0), F.lit(0.0))), "x array<float>")[0] == pytest.approx(0.6)
    assert values(spark, [*rows, [1.0, None]], V.usable(F.col("x"), 2), "x array<float>") == [True, False, False, False, False]
    assert math.isclose(values(spark, [[3.0, 4.0]], V.norm(F.col("x")), "x array<float>")[0], 5.0)
