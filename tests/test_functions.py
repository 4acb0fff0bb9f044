import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orevein.functions import porter, robots, text, urls
from orevein.plans import query
from orevein.sources import html

NORMAL = {
    "HTTP://EXAMPLE.COM:80/path/?b=2&a=1#fragment": "http://example.com/path?a=1&b=2",
    "HTTPS://EXAMPLE.COM:443/secure/?param=value": "https://example.com/secure?param=value",
    "http://example.com/path/to/page.html": "http://example.com/path/to/page.html",
    "http://example.com/path/?empty=&value=something": "http://example.com/path?empty=&value=something",
    "not a url": None,
    "http://example.com:8080/path/": "http://example.com:8080/path",
    "http://u:p@Example.com/a?utm_source=x&z=1&ref=2": "http://example.com/a?z=1",
    "http://e.com/?=": None,
    "http://e.com//": "http://e.com/",
    "mailto:a@b.c": None,
    "/relative": None,
    "": None,
    "http://e.com/%zz": None,
    None: None,
}


def _map(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("o", expression(F.col("v")))
    return [r["o"] for r in frame.orderBy("i").collect()]


def test_normalize(spark):
    assert _map(spark, NORMAL, urls.normalize) == list(NORMAL.values())


def test_is_absolute(spark):
    cases = {"http://example.com": True, "https://example.com": True, "ftp://files.example.com": True, "/path/page.html": False, "mailto:user@example.com": False, "//example.com/path": False, "example.com": False}
    assert _map(spark, cases, urls.is_absolute) == list(cases.values())


@pytest.mark.parametrize(
    "base, relative, result",
    [
        ("http://example.com/base/", "../page.html", "http://example.com/page.html"),
        ("http://example.com/base/", "https://another.com/page.html", "https://another.com/page.html"),
        ("http://example.com/base/", "", "http://example.com/base/"),
        ("http://example.com/base/", "page.html?param=value", "http://example.com/base/page.html?param=value"),
        ("http://example.com/base/", "search?q=test%20query&lang=en", "http://example.com/base/search?q=test%20query&lang=en"),
        ("invalid url", "page.html", None),
    ],
)
def test_resolve(base, relative, result):
    assert urls._resolve(base, relative) == result


def test_rules(spark):
    cases = {"/private/": "^/private/.*", "/path/*file.html": r"^/path/.*file\.html.*", "/admin/": "^/admin/.*", "/file.php?id=*": r"^/file\.php\?id=.*", "/admin$": "^/admin$", "": "^.*"}
    assert _map(spark, cases, robots.rule_regex) == list(cases.values())


def test_allowed(spark):
    rules = spark.createDataFrame(
        [("http://test.com", "allow", "^/allowed/.*"), ("http://test.com", "disallow", "^/.*"), ("http://blocked.com", "disallow", "^/blocked/.*"), ("http://tie.com", "allow", "^/a/.*"), ("http://tie.com", "disallow", "^/a/.*")],
        "base string, kind string, pattern string",
    )
    seen = spark.createDataFrame([("http://test.com/allowed/page",), ("http://test.com/x",), ("http://blocked.com/blocked/page",), ("http://unknown.com/",), ("http://tie.com/a/b",)], "url string")
    got = {r["url"]: r["allowed"] for r in robots.allowed(seen, rules).collect()}
    assert list(got[u["url"]] for u in seen.collect()) == [True, False, False, True, False]


def test_parse_robots(spark):
    body = "User-agent: other\nDisallow: /no\n# note\n\nUser-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow:\n"
    rows = robots.parse_robots(spark.createDataFrame([("http://a.b", body), ("http://c.d", "")], "base string, body string")).collect()
    assert [(r["kind"], r["rule"]) for r in rows] == [("disallow", "/private/"), ("allow", "/private/open"), ("disallow", "")]


def test_content_hash(spark):
    assert _map(spark, ["abc"], text.content_hash) == ["ungWv48Bz-pBQUDeXa4iI7ADYaOWF3qctBD_YfIAFa0"]


@pytest.mark.parametrize(
    "word, stem",
    [("running", "run"), ("jumped", "jump"), ("swimming", "swim"), ("flies", "fli"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("conditional", "condit"), ("hopping", "hop"), ("hoping", "hope"), ("generalizations", "gener"), ("agreed", "agre"), ("plastered", "plaster"), ("sky", "sky"), ("happy", "happi"), ("is", "is"), ("adjustment", "adjust"), ("controll", "control")],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789_", min_size=1, max_size=15))
def test_porter_is_total(word):
    assert 0 < len(porter.stem(word)) <= len(word) + 1


def test_query_parser():
    assert query.parse("Kitchen, STORM of page").tokens == ("kitchen", "storm", "page")
    q = query.parse('"a b" AND "c" NOT "d"')
    assert q.phrases == ("a b", "c", "d") and q.operators == (query.AND, query.NOT) and q.search_terms() == ["a", "b", "c"]
    assert query.parse('"a" junk "b" OR "c"').operators == (query.AND, query.OR)
    assert query.parse("").tokens == () and query.parse(None).search_terms() == []
    assert query.parse('say "a b"').is_phrase is False
    assert query.parse('"a" NOT "b"').cache_key() != query.parse('"a" NOT "c"').cache_key()
    with pytest.raises(ValueError):
        query.parse('"a" AND "b" AND "c" AND "d"')


PAGE = '<!DOCTYPE html><html><head><title>Test Title</title><meta name="description" content="Test Description"></head><body><p>This is a <b>te</b>st document with some content.</p></body></html>'


def test_read_page():
    page = html.read(PAGE)
    assert page["title"] == "Test Title" and page["description"] == "Test Description"
    assert [(e["tag"], e["text"]) for e in page["elements"]] == [("p", "This is a test document with some content."), ("b", "te")]
    page = html.read("<h2>Head &amp; more</h2><p>one<p>two <div>x<br>y</div><ul><li>a<li>b <i>c</i></ul><script>var a='<b>';</script><a href='/x?a=1&amp;b=2'>go")
    assert page["title"] == "Head & more" and page["description"] == "one" and page["links"] == ["/x?a=1&b=2"]
    assert [(e["tag"], e["text"]) for e in page["elements"]] == [("h2", "Head & more"), ("p", "one"), ("p", "two"), ("div", "x y"), ("li", "a"), ("li", "b c"), ("i", "c"), ("a", "go")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<!--", "-->", "<li>", "<td>", "</table>", "<script>", "</script>", "text ", "<", "&amp;", "<a href='x'>", "\n"]), max_size=30))
def test_reader_is_total_and_balanced(parts):
    page = "".join(parts)
    depth = 0
    for kind, *_ in html.scan(page):
        depth += {html.OPEN: 1, html.CLOSE: -1}.get(kind, 0)
        assert depth >= 0
    assert depth == 0
    html.read(page)
