import re

import pytest

from loam.llm.queries import URL_RULES
from loam.llm.url_filter import DEFAULT_PATTERNS, SHAPE_PATTERNS, WORD_PATTERNS, host_rule, judge_urls, pattern_rule, rule_index

URLS = [None, "", "no scheme/x", "http://org", "http://org/", "https://WWW.a.ORG/en/?q", "http://example.org/es/1", "http://b.example.org/es/", "http://example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de", "http://x.com/de/#a", "x://y.net/casino/1", "http://y.net/casinos", "http://y.net?cart", "a://b://c.com/fr/", "http://h.com/fr/../x y", "http://ü.com/de/é", "http://example.org?x=/es/"]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    words = set(re.findall("[a-z0-9]+", (url or "").lower()))
    shapes = {r.verdict for r in SHAPE_PATTERNS if re.search(r.pattern, url or "")}
    other = "block" if words & {r.name for r in WORD_PATTERNS} or "block" in shapes else "allow"
    return host, path, best and best[0], best[1] if best else other


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] * 2 + [(None, URLS[5], None, None)], "page_id long, url string, host string, verdict string")
    got = judge_urls(pages, [*URL_RULES, *DEFAULT_PATTERNS]).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[5 if r.page_id is None else r.page_id]), r


def test_empty_and_index(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty, URL_RULES).collect() == []
    pages = spark.createDataFrame([("http://a.org/es/1",), ("http://b.org/x",), ("http://example.net/",)], "url string")
    best = {r.name: r.token for r in rule_index(pages, [host_rule("block", "example.org/es/"), host_rule("allow", "org/")]).collect()}
    assert best == {"example.org/es/": "es", "org/": "org"}
    with pytest.raises(ValueError):
        pattern_rule("any", "block", ".*", [])


#: (what matches, what has the same tokens and does not)
SHAPES = {
    "tag-page": ("http://a.net/tag/red/page/3", "http://a.net/page/tag/red/3"),
    "calendar-day": ("http://a.net/calendar/2021/7", "http://a.net/calendar/7/2021"),
    "site-search": ("http://a.net/search?x=1&q=red", "http://a.net/search/q?red=1"),
    "print-view": ("http://a.net/x?print=1", "http://a.net/print/1?x="),
    "campaign": ("http://a.net/?utm_source=n&utm_medium=m", "http://a.net/?utm_medium=m&utm_source=n"),
    "session-id": ("http://a.net/x;PHPSESSID=9a", "http://a.net/phpsessid/9a"),
    "numbered-list": ("http://a.net/list/12/page/100", "http://a.net/list/12/page/99"),
    "article": ("http://a.net/article/2020/red-fox.html", "http://a.net/html/article/2020/red"),
}


def test_expressions_decide_what_tokens_fetch(spark):
    assert {r.name for r in SHAPE_PATTERNS} == set(SHAPES)
    urls = [(name, k, u) for name, pair in SHAPES.items() for k, u in enumerate(pair)]
    pages = spark.createDataFrame([(f"{n}{k}", u) for n, k, u in urls], "page_id string, url string")
    got = {r.page_id: r for r in judge_urls(pages, DEFAULT_PATTERNS).collect()}
    for name, k, _ in urls:
        r = got[f"{name}{k}"]
        assert r.n_candidates > 0 or name in ("numbered-list",)  # the tokens fetched a rule
        assert r.pattern == (name if k == 0 else None), (name, k, r)
        assert r.verdict == ("block" if k == 0 and name != "article" else "allow")


def test_random_urls_are_brute_force(spark):
    import random

    r = random.Random(6)
    parts = ["tag", "page", "calendar", "2021", "7", "search", "q=", "print=1", "utm_source=a", "utm_medium=b", "list", "100", "article", "a.html", "login", "de", "fr", "es", "?", "&", "/", "/", "/", "#", "item", "phpsessid=1"]
    urls = ["http://" + r.choice(["a.net", "b.org", "example.org", "c.com", "X.Example.ORG"]) + "".join(r.choice(["/", "/", "?", "&", ""]) + r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(pages, [*URL_RULES, *DEFAULT_PATTERNS]).collect()
    assert all((x.host, x.path, x.rule, x.verdict) == brute(urls[x.page_id]) for x in got)
    assert {x.pattern for x in got} > {"site-search", "print-view"}
