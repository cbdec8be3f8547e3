import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import html, text, urls


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def tokens_of(raw):
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in raw.lower()).split()


@pytest.mark.parametrize("raw", ["Jam, TOAST & tea-cakes?", "v2 of 7.25 kg (x86)", "naïve façade", "north\u2014south", "\t\n.;", "", "it's 5o'clock", "A_b\u00a0C"])
def test_tokenize(spark, raw):
    assert one(spark, text.tokenize(F.col("t")), t=raw) == tokens_of(raw)
    assert one(spark, text.token_count(F.col("t")), t=raw) == len(tokens_of(raw))


def test_tokenize_null(spark):
    assert spark.range(1).select(text.tokenize(F.lit(None).cast("string")).alias("x")).first().x == []


CANONICAL = {
    "https://shop.example/list#row7": "https://shop.example/list",
    "HTTPS://Shop.Example/List": "https://shop.example/List",
    "http://shop.example:80": "http://shop.example/",
    "https://shop.example:443/x": "https://shop.example/x",
    "https://shop.example:80/x": "https://shop.example:80/x",
    "http://shop.example/x?size=4&utm_medium=mail&gclid=9&UTM_id=1": "http://shop.example/x?size=4",
    "http://shop.example/x?utm_campaign=z": "http://shop.example/x",
    "http://shop.example/x?only": "http://shop.example/x?only=",
    "http://shop.example/x?to=here there*~&&z=1": "http://shop.example/x?to=here+there%2A~&z=1",
    "pears.html": "pears.html",
    "": "",
}


@pytest.mark.parametrize("raw,want", CANONICAL.items())
def test_normalize_url(spark, raw, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=raw) == want
    assert one(spark, urls.normalize_url(F.col("u")), u=want) == want


BASE = "https://shop.example/fruit/pome/list.html"


@pytest.mark.parametrize("base,href", [
    (BASE, "pear.html"), (BASE, "../stone/plum"), (BASE, "../../../../top"), (BASE, "/veg/./leek/../kale"), (BASE, "//other.example/y"), (BASE + "?page=2", "?page=3"), (BASE + "?page=2#end", "#start"),
    (BASE, "tel:+4930123"), ("https://shop.example", "pear.html"), ("list.html", "pear.html"), ("fruit/list.html", "pear.html"), ("https://shop.example/fruit/", "."), ("https://shop.example/fruit/pear", ".."), (BASE, "http://third.example/"), (BASE, ""),
])
def test_resolve(spark, base, href):
    from urllib.parse import urljoin

    assert one(spark, urls.resolve(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)


def test_slugify(spark):
    slug = lambda u: one(spark, urls.slugify(F.col("u")), u=u)
    assert slug("https://shop.example/fruit/list.html").startswith("shop.example-fruit-list-")
    assert slug("https://shop.example/fruit/list.html") != slug("https://shop.example/veg/list.html")
    assert slug("https://shop.example/?p=1") != slug("https://shop.example/?p=2")
    assert len(slug("https://shop.example/" + "plum" * 100)) == 80 + 7 + 5


def test_digest_ignores_white_space(spark):
    d = lambda t: one(spark, text.content_digest(F.col("t")), t=t)
    assert d("ripe  figs\n now ") == d("ripe figs now") != d("Ripe figs now")


PAGE = """<!doctype html><html><head><title>
 Pears &amp; plums</title><style>b {}</style></head><body><!-- <p>old</p> --><h1>Fruit</h1><p data-x="1 > 0">Ripe <i>now</i>: 2 &lt; 3</p>
<script>document.write("</b>")</script><a rel=next title="go > on" href="plum.html">on</a><a href='plum.html#pit'>pit</a><a name=x>none</a></body></html>"""


def test_parse(spark):
    p = one(spark, html.parse(F.col("h"), F.lit("https://shop.example/fruit/list.html")), h=PAGE)
    assert (p.title, p.text, p.links) == ("Pears & plums", "Pears & plums Fruit Ripe now : 2 < 3 on pit none", ["https://shop.example/fruit/plum.html"])
    assert p.tokens == tokens_of(p.text)
    assert [one(spark, html.title(F.col("h")), h=h) for h in ("<h1>Big <b>Fig</b></h1>", "<title>\n</title><h1>Fig</h1>", "<p>Fig</p>")] == ["BigFig", "", ""]


@pytest.mark.parametrize("raw,want", [
    ("caf&#233; &eacute;t&#xE9;", "café été"), ("&#150; &#x1F600; &#0;", "– 😀 \ufffd"), ("&nosuchname; R&D &amp", "&nosuchname; R&D &amp"), ("&amp;lt;", "&lt;"), ("<![CDATA[a <b> &amp; c]]>d", "a <b> &amp; c d"),
    ('<p class="x>open</p> shut', "open shut"), ("3 < 4 <br/>> 2", "3 < 4 > 2"), ("<p title='it > that'>said</p>", "said"), ("&NotEqualTilde;", "≂̸"),
])
def test_markup(spark, raw, want):
    assert one(spark, html.visible_text(F.col("h")), h=raw) == want


@pytest.mark.parametrize("raw,want", [("<a data-href=n.html href = y.html>y</a>", ["y.html"]), ("<abbr href=n.html>n</abbr><A HREF=y.html>y</A>", ["y.html"]), ("<a title='href=n.html'>n</a>", []), ("<!-- <a href=n.html>n</a> --><a href=''>n</a>", ["p.html"])])
def test_links(spark, raw, want):
    assert one(spark, html.links(F.col("h"), F.lit("p.html")), h=raw) == want


def snippet(spark, t, terms):
    return one(spark, text.make_snippet(F.col("t"), F.array(*map(F.lit, terms))), t=t)


def test_snippet(spark):
    words = [f"w{i}" for i in range(100)]
    assert snippet(spark, "", ["a"]) == snippet(spark, "?!", ["a"]) == ""
    assert snippet(spark, "short text here.", ["zzz"]) == "short text here"
    assert snippet(spark, " ".join(words), ["w50"]) == "… " + " ".join(words[35:65]) + " …"
    # distinct terms count more than hits
    words[10:13] = ["aa"] * 3
    words[60], words[62] = "aa", "bb"
    assert "bb" in snippet(spark, " ".join(words), ["aa", "bb"])


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="aAbé \n.", max_size=40))
def test_highlight_keeps_the_text(spark, t):
    segments = one(spark, text.highlight(F.col("t"), F.array(F.lit("a"), F.lit("ab"))), t=t)
    assert "".join(s.text for s in segments) == t
    assert all(a.match != b.match for a, b in zip(segments, segments[1:]))
