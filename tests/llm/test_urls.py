"""URL rules against plain matching, and the trees on labels that lexical features can tell."""

import re

import pytest
from pyspark.sql import functions as F

from hexrisk.llm import urls

ODD = [
    None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "HTTP://X.NET/a", "http://xnet/a", "http://net/a", "http://a.example.net/en/1", "http://example.net/en", "http://badexample.com/de/",
    "http://www.example.com/de/x?y=1#z", "http://EXAMPLE.org/fr/é", "http://b.org?x=/fr/", "a://b://c.net/d", "http://h.net?q", "http://h.net#f/en/", "http://Ä.NET/", "http://user@x.net:80/", "x\n://y.net/", "http://a.net/" + "p/" * 40_000,
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r.text), r.text, r.verdict) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "mine") for i, u in enumerate(ODD)] + [(None, ODD[5], None), (5, ODD[5], "")]
    rows += [(100 + i, f"http://h{i % 9}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 4 % 3]}/{i}", "") for i in range(200)]
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_rules(spark, pages):
    out = urls.judged(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_trees_learn_from_labelled_urls(spark):
    bad = F.concat(F.lit("http://"), F.col("id"), F.lit(".spam.example/win?a=1&b=2&c="), F.col("id") * 7919)
    good = F.concat(F.lit("https://news.example/story-"), F.col("id"), F.lit("/index.html"))
    rows = spark.range(600).select(F.col("id"), F.when(F.col("id") % 2 == 0, bad).otherwise(good).alias("url"), ((F.col("id") + 1) % 2).cast("double").alias("label"))
    ready = urls.with_features(rows)
    model = urls.fit_urls(ready.filter("id < 400"))
    held = model.score(ready.filter("id >= 400"))
    assert held.filter("(score >= 0.5) = (label = 1)").count() == 200


def test_no_rules_one_kind_and_nothing(spark, pages):
    assert urls.judged(pages, ()).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judged(pages, (urls.Rule("block", "net", "/"),)).filter("verdict <> 'block'").count() == 0
    assert urls.judged(pages.limit(0)).count() == 0
