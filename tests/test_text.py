"""Functions on texts, pages and urls, against cases worked out by hand."""

from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("raw,kept", [
    ("foo-bar 12", "foobar "), ("café9x", "cafx"), ("bar，你好", "bar你好"), ("　、。", ""), ("ひカ한", "한"), ("😀a", "a"), ("a\tb\nc", "ab\nc"), ("", ""), (None, None),
])
def test_clean(spark, raw, kept):
    assert one(spark, tx.clean(F.col("t")), t=raw) == kept


@pytest.mark.parametrize("html,body", [
    ('<p>ab</p><p>cd&nbsp;e</p><script>var t="</p>";x<1;</script>f', "abcdnbspef"), ("a<script>rest of it", "a"), ("<SCRIPT>x</SCRIPT>y", "xy"), ("<style>a</style>b\nc", "bc"), (None, None),
])
def test_strip_html(spark, html, body):
    assert one(spark, tx.strip_html(F.col("t")), t=html) == body


def test_page_text_and_blocks_keep_lines(spark):
    assert one(spark, tx.page_text(F.col("t")), t="<p>a</p>\n<b>c</b>") == "a\nc"
    assert one(spark, tx.tags_to_lines(F.col("t")), t="<p>a</p><p>b</p>") == "\na\n\nb\n"


@pytest.mark.parametrize("html,title", [("<title>A b</title>", "A b"), ("<title></title>", None), ("<p>", None), ('<title lang="x">T</title>', "T"), (None, None)])
def test_title(spark, html, title):
    assert one(spark, tx.title(F.col("t")), t=html) == title


def test_links(spark):
    html = '<a href="/x.html">1</a><a  href="/y.htm">2</a><a class="c" href=\'http://a.example/?q=1\'>3</a><a href="/z.pdf">4</a>'
    assert one(spark, tx.links(F.col("t"), strict=True), t=html) == ["/x.html"]
    assert one(spark, tx.links(F.col("t")), t=html) == ["/x.html", "/y.htm", "http://a.example/?q=1", "/z.pdf"]
    assert one(spark, tx.links(F.col("t")), t=None) is None


@pytest.mark.parametrize("raw,text", [("%E4%BD%A0+a%2Bb", "你 a+b"), ("%e4%bd%a0", "你"), ("a%2", "a%2"), ("100%", "100%"), ("%zz", "%zz"), ("", ""), (None, None)])
def test_percent_decoding(spark, raw, text):
    assert one(spark, tx.percent_decoded(F.col("t")), t=raw) == text


def test_parameter(spark):
    assert one(spark, tx.parameter(F.col("t")), t="/s?a=b=c") == "b=c"
    assert one(spark, tx.parameter(F.col("t")), t="/index.html") is None


def test_snippets(spark):
    text = "".join(chr(0x4E00 + i) for i in range(400))
    assert one(spark, tx.snippet(F.col("t"), F.lit(150)), t=text) == text[50:201]
    assert one(spark, tx.snippet(F.col("t"), F.lit(5)), t=text) == text[:56]
    assert one(spark, tx.snippet(F.col("t"), F.lit(5000)), t=text) == ""
    got = one(spark, tx.byte_snippet(F.col("t"), F.lit(151)), t=text)
    assert got == text.encode()[51:202].decode("utf-8", "ignore")
    assert one(spark, tx.byte_snippet(F.col("t"), F.lit(3)), t="aé" * 40) == ("aé" * 40).encode()[:54].decode("utf-8", "ignore")


def test_idf_and_id_key(spark):
    assert one(spark, 3 * tx.idf(F.col("n")), n=25) == 6.0
    assert one(spark, tx.idf(F.col("n")), n=100) == 0.0
    assert one(spark, 2 * tx.idf(F.col("n")), n=200) == -2.0
    assert one(spark, tx.id_key(F.col("n")), n=42) == "42        "


@pytest.mark.parametrize("url,site", [
    ("http://www.A.example:8080/x", "a.example"), ("https://b.test?q", "b.test"), ("http://u:p@c.test/", "c.test"), ("/relative", None), ("", None), (None, None), ("http://wwwx.test/", "wwwx.test"),
])
def test_site(spark, url, site):
    assert one(spark, urls.site(F.col("u")), u=url) == site


def test_same_domain(spark):
    assert one(spark, urls.same_domain(F.lit("http://A.test:80/x"), F.lit("http://a.test:80/y")), u="")
    assert not one(spark, urls.same_domain(F.lit("http://a.test:80/x"), F.lit("http://a.test/y")), u="")


BASES = ["http://h.test/a/b/c.html", "http://h.test", "http://h.test/a/?q=1#f", "https://h.test:81/x/y/"]
LINKS = ["d.html", "../d.html", "../../../d", "./d", "/r/s", "/r/../s", "//o.test/p", "http://o.test/q", "?z=1", "#top", "", "a/./b/../c?x=../y", "mailto:x@y.test", ".."]


@pytest.mark.parametrize("base", BASES)
def test_resolved_as_the_standard_library_does(spark, base):
    rows = spark.createDataFrame([(base, x) for x in LINKS], "b string, l string").select("l", urls.resolved(F.col("b"), F.col("l")).alias("u")).collect()
    for r in rows:
        assert r["u"] == urljoin(base, r["l"]), r["l"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_clean_keeps_only_its_characters(spark, text):
    text = text.encode("utf-8", "ignore").decode()
    got = one(spark, tx.clean(F.col("t")), t=text)
    assert got == "".join(c for c in text if c in " \n" or "A" <= c <= "Z" or "a" <= c <= "z" or 0x3192 <= ord(c) <= 0xFABF)
