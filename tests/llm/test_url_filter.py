import duckdb
import pytest

from quillon.llm import url_filter as U
from quillon.llm import url_sql
from quillon.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, host string, verdict string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], SCHEMA)


def brute(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    "http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "https://x.net?q=/en/", "http://net/", "http://example.net/en", "http://b.example.net/en/?x#y", "http://de.example.com/de/7.html",
    "http://notexample.com/de/1", "http://w.org/fr/x?u=http://x.net/", "http://w.org/FR/", "ftp://ÄB.org/fr/", None, "", "no scheme/x.net/", "://x.net/a", "http:///path", "a://b://c.net/d", "http://x.org#/fr/", "http://net/" + "a/" * 3000,
]


def test_rules(spark):
    got = {r.page_id: r for r in U.judge_urls(pages(spark, URLS), URL_RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = brute(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path) == (host, path), url
        assert got[i].rule == (rule.text if rule else None)
        assert got[i].verdict == (rule.action if rule else "allow"), url


def test_template_of_bad_pages_is_rejected(spark):
    """Labels come from rules on some paths; unlabelled pages of the same template follow them."""
    rules = [U.Rule("block", f"h.test/forum/{i}") for i in range(1, 8)] + [U.Rule("allow", f"h.test/wiki/{i}") for i in range(1, 8)]
    urls = [f"http://h.test/forum/{i}" for i in range(1, 40)] + [f"http://h.test/wiki/{i}" for i in range(1, 40)] + ["http://other.test/forum/1"]
    got = U.judge_urls(pages(spark, urls), rules).collect()
    own = [(r.url, r.verdict, r.template) for r in got if r.rule is None]
    assert {v for u, v, _ in own if "h.test/forum" in u} == {"block"} and {v for u, v, _ in own if "h.test/wiki" in u} == {"allow"}
    assert {v for u, v, _ in own if "other" in u} == {"allow"}


def test_pages_without_a_rule_follow_what_is_known_of_their_template(spark):
    urls = [f"http://{h}.net/{lang}/post/{i}" for h in ("a", "b") for lang in ("de", "xx") for i in range(5)] + [f"http://example.net/en/post/{i}" for i in range(5)]
    urls += [f"http://{h}.org/{lang}/post/{i}" for h in ("c", "d") for lang in ("de", "en", "fr", "new") for i in range(3)] + ["http://c.org/", None]
    df = pages(spark, urls)
    got = U.judge_urls(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    own = {(r.path.split("/")[1], r.verdict) for r in got if r.rule is None and r.path.count("/") > 1}
    assert own == {("de", "block"), ("en", "allow"), ("new", "allow")}
    con = duckdb.connect()
    held = df.select("page_id", "url").toPandas()
    con.register("pages", held)
    key = lambda r: r[0]
    assert sorted(map(tuple, got), key=key) == sorted(con.sql(url_sql.sql_of(URL_RULES)).fetchall(), key=key)


def test_variable_segments_become_wildcards(spark):
    urls = [f"http://h.test/user/{a}{b}{c}/posts" for a in "abc" for b in "defg" for c in "hij"]
    assert {r.template for r in U.judge_urls(pages(spark, urls), []).collect()} == {"/user/*/posts"}


def test_similar_branches_merge(spark):
    rules = [U.Rule("block", f"h.test/{k}/bad/{i}") for k in ("a", "b") for i in range(5)] + [U.Rule("allow", f"h.test/c/bad/{i}") for i in range(5)]
    urls = [f"http://h.test/{k}/bad/{i}" for k in "abc" for i in range(5)]
    got = {r.url: r.template for r in U.judge_urls(pages(spark, urls), rules).collect()}
    assert got["http://h.test/c/bad/1"] != got["http://h.test/a/bad/1"]


def test_repeats_empty_and_clashing_columns(spark):
    df = pages(spark, ["http://x.net/1"] * 3)
    more = df.selectExpr("*", "1 AS rejected", "'t' AS template", "2 AS action", "3 AS _shape", "4 AS n")
    assert U.judge_urls(more, URL_RULES).columns == ["page_id", "url", "rejected", "action", "_shape", "n", "host", "path", "rule", "verdict", "template"]
    got = U.judge_urls(df.union(df), URL_RULES)
    assert got.count() == 6 and got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "template"]
    assert U.judge_urls(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        U.rule_column([U.Rule("block", "a/")] * 3000, df.host, df.url)
