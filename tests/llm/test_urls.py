import pytest

from slmeval.llm import urls
from slmeval.llm.queries import URL_RULES
from slmeval.llm.urls import Rule

URLS = ["http://a.org/x", "http://a.org", "HTTP://Example.ORG/es/1", "http://example.org/es", "https://m.example.org/en/123?q",
        "https://example.org/en/2#t", "x://b.com/de/", "x://b.com/de", "x://fr.com/fr/7", None, "", "no scheme", "http://notexample.org/es/1",
        "a://org/", "a://xorg/", "a://b.org:80/", "a://b.org/://c.com/de/", "http://com/de/\nx", "http://", "http:///es/", "a://b..org/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        path = tail.split("?")[0].split("#")[0]
    fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host.split(".")) if r.host else 0, len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


RULES = [*URL_RULES, Rule("block", "b.org", ""), Rule("allow", "b.org", "/a/b"), Rule("block", "org", "/x"),
         Rule("allow", "org", "/x"), Rule("block", "", "/fr")]


@pytest.mark.parametrize("rules", [URL_RULES, RULES, []])
def test_trie_and_join_equal_brute_force(spark, rules, monkeypatch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string")
    expected = [(i, *brute(u, rules)) for i, u in enumerate(URLS + URLS[:3])]
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, urls.judge_urls(df, rules).select(columns).collect())) == expected
    monkeypatch.setattr(urls, "MAX_RULES", -1)
    assert sorted(map(tuple, urls.judge_urls(df, rules).select(columns).collect())) == expected


def test_rule_table_clashing_names_and_empty(spark):
    table = spark.createDataFrame([tuple(r) for r in URL_RULES], "verdict string, host string, path string")
    df = spark.createDataFrame([(1, "http://a.org/es/", "h", "v")], "page_id long, url string, Host string, verdict string")
    out = urls.judge_urls(df, table)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert tuple(out.first())[2:] == ("a.org", "/es/", "org/", "allow")
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0
