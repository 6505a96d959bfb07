"""URL filters: verdicts worked out by hand, all rules against every URL, and both ways to find candidates."""

import random

import pytest

from routelens.llm import queries
from routelens.llm.url_filters import (
    HOST_RULES,
    PATTERNS,
    _compiled,
    _decide,
    filed,
    host_rule,
    judge_urls,
    pattern_rule,
    rules_of,
    token_counts,
)

PAGES = "page_id long, url string, html string, rule string, row long"
CASES = [
    ("http://Example.ORG/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    ("http://a.example.org/en/12?q#t", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://example.org?x/", "example.org", "", None, "allow"),
    ("https://x.com/fr/cart/", "x.com", "/fr/cart/", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://x.com/DE/", "x.com", "/DE/", None, "allow"),
    ("https://x.net/cart", "x.net", "/cart", None, "block"),
    ("https://x.net/cartoon", "x.net", "/cartoon", None, "allow"),
    ("https://docs.x.net/cart", "docs.x.net", "/cart", None, "allow"),
    ("https://x.net/Photo.JPG", "x.net", "/Photo.JPG", None, "block"),
    ("https://x.net/photo.jpg?y", "x.net", "/photo.jpg", None, "allow"),
    ("https://m.cheap-pills.net/", "m.cheap-pills.net", "/", None, "block"),
    ("org/", "", "", None, "allow"), ("/login", "", "", None, "block"), ("", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://x.org\n/es/", "x.org\n", "/es/", None, "allow"), ("http://ü.org/ß", "ü.org", "/ß", "org/", "allow"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, case[0], "h", "r", 1) for i, case in enumerate(CASES)]
    rows += [(None, CASES[0][0], None, None, None), rows[0], (500, "http://a.org/" + "x/" * 50_000, "", "", 0)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def plain(host, path, url, rules):
    """All rules tried."""
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    return _decide([r for r in rules if _compiled(r.expression).search(host + path if r.is_host else low)])


@pytest.mark.parametrize("most_held", [200_000, 0])
def test_verdicts(pages, most_held):
    rows = judge_urls(pages, most_held=most_held).collect()
    assert len(rows) == len(CASES) + 3
    for row in rows:
        if row.page_id == 500:
            assert (row.rule, row.verdict) == ("org/", "allow")
        else:
            case = CASES[row.page_id or 0]
            assert (row.host, row.path, row.rule, row.verdict) == case[1:], case
            assert plain(*case[1:3], case[0], rules_of(HOST_RULES, PATTERNS)) == (row.rule, row.pattern, row.verdict)


def test_rules_and_patterns_against_all_rules(spark):
    rnd = random.Random(8)
    parts = ["a", "ads", "x1", "wiki", "q%20", "b-c", "tag", "feed", "ä", "9", "pdf"]
    marks = ["/", ".", "-", "?", "&", "=", "//", ":", "_", "*"]
    made = ["".join(rnd.choice(parts) + rnd.choice(marks) for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    urls = [rnd.choice(["http://", "", "x://www.", "HTTPS://"]) + text for text in made]
    patterns = [rnd.choice(["", "||", "|", "@@", "@@||"]) + "".join(
        rnd.choice(parts) + rnd.choice(["^", "*", "/", ".", "-", "="]) for _ in range(rnd.randint(1, 2)))
        + rnd.choice(["", "|", "a"]) for _ in range(120)]
    hosts = [(rnd.choice(["allow", "block"]), f"{rnd.choice(parts)}/{rnd.choice(['', 'a', 'tag/', 'x1/9'])}")
             for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = rules_of(hosts, patterns)
    index = filed(rules, token_counts(pages, rules))
    assert len(index) > 5 and len(index.get("", ())) < len(rules) / 2
    results = [{r.page_id: r for r in judge_urls(pages, hosts, patterns, most_held=n).collect()} for n in (10**6, 0)]
    assert results[0] == results[1]
    seen = set()
    for page, url in enumerate(urls):
        row = results[0][page]
        assert plain(row.host, row.path, url, rules) == (row.rule, row.pattern, row.verdict), url
        seen.add((row.rule is None, row.pattern is None, row.verdict))
    assert len(seen) >= 5


def test_tokens_a_rule_is_filed_under(spark):
    assert host_rule("block", "example.org/en/1").tokens == ("example", "org", "en")
    assert pattern_rule("||a.b^c*d^").tokens == ("a", "b")
    assert pattern_rule("cart").tokens == () and pattern_rule("^Cart^").tokens == ("cart",)
    assert pattern_rule("|http://x|").tokens == ("http", "x")
    pages = spark.createDataFrame([("http://a.org/en/",), ("http://b.org/en/org",), ("http://example.org/",), (None,)],
                                  "url string")
    rule = host_rule("block", "example.org/en/1")
    counts = token_counts(pages, [rule])
    assert counts == {"example": 1, "org": 3, "en": 2} and filed([rule], counts) == {"example": [0]}
    for bad in ("", "||", "*|", "@@"):
        with pytest.raises(ValueError):
            pattern_rule(bad)
    with pytest.raises(ValueError):
        host_rule("allow", "org")


def test_empty_and_missing(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op11_url_filters(spark, str(tmp_path)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/login")], "page_id long, url string")
    assert judge_urls(pages, (), ()).first().verdict == "allow"
    assert judge_urls(pages, (), (), most_held=-1).first().verdict == "allow"
