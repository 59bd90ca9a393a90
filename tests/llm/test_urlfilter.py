import random

import numpy as np
import pytest

from thalweg.llm import urlfilter as U

R = random.Random(12)
HOSTS = ["net", "a.net", "example.net", "x.y.Example.NET", "notexample.net", "example.com", "www.example.com", "b.org", "org", "a..b", ".b", "b", "m.ads-track.example.org", "loads.example.org", "", "net:80", "münchen.de", "com"]
PATHS = ["", "/", "/en", "/en/", "/en/1", "/de/", "/de/x/y.html", "/fr/", "/fr/é", "//", "/EN/"]
URLS = [f"{s}://{h}{p}{t}" for s in ("http", "HTTPS") for h in HOSTS for p in PATHS for t in ("", "?q=://a.net/en/", "#top", "?a#b")]
URLS += [None, "", "no scheme", "a.net/en/", "://a.net/", "x://y://net/", "http://a.net/en/" + "p" * 100_000, "http://" + "a." * 3000 + "net/", "http://h\n.net/x\ny?z", *URLS[:5]]
RULES = [(v, h, p) for v, h, p in U.RULES]
MORE = RULES + [("block", "b", ""), ("allow", ".b", ""), ("block", "example.com", "/de/x"), ("allow", "example.com", "/de/x/y"), ("allow", "org", "/fr/"), ("block", "org", "/fr/é"),
    ("allow", "a.net", ""), ("block", "net", "/en"), ("allow", "a.net", "/"), ("block", "a.net", "/"), ("block", None, "/x"), ("allow", "", "/"), ("block", "münchen.de", None), ("other", "com", "")]


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[k:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), path[:end]


def plain(url, rules, hosts=()):
    host, path = parted(url)
    fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for v, h, p in rules
            if v in ("allow", "block") and h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    if fits:
        return host, path, *max(fits)[3:]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string, shard string").repartition(3)


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


@pytest.mark.parametrize("rules", [RULES, MORE])
def test_equals_all_rules_tried(spark, pages, rules):
    hosts = ["example.org", "com"]
    got = {r[0]: tuple(r)[1:] for r in U.judge(pages, rules_of(spark, rules), spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {i: plain(u, rules, hosts) for i, u in enumerate(URLS)}


def test_query(spark, pages):
    got = {r[0]: tuple(r)[1:] for r in U.digest(pages).collect()}
    assert got == {i: plain(u, RULES, ["m.ads-track.example.org"]) for i, u in enumerate(URLS)}


def test_many_rules_in_many_shards_and_passes(spark, pages, monkeypatch):
    monkeypatch.setattr(U, "SHARD_KEYS", 100)
    monkeypatch.setattr(U, "HELD_BYTES", 600)
    rules = MORE + [(R.choice(["allow", "block"]), f"h{i}.net", R.choice(["", "/", f"/{i}"])) for i in range(900)]
    got = {r[0]: tuple(r)[1:] for r in U.judge(pages, rules_of(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(URLS)}


def test_no_rules_and_no_urls(spark, pages):
    assert {(r["rule"], r["verdict"]) for r in U.judge(pages, rules_of(spark, [])).collect()} == {(None, "allow")}
    assert U.judge(pages.limit(0), rules_of(spark, RULES)).count() == 0
    with pytest.raises(ValueError):
        U.judge(pages.withColumnRenamed("page_id", "rule_").withColumnRenamed("rule", "r").withColumnRenamed("rule_", "rule"), rules_of(spark, RULES), key="rule")


def test_cascade_is_exact_and_alternates():
    keys = np.random.default_rng(5).integers(0, 1 << 63, (60_000, 2)).astype(np.uint64)
    listed, others = keys[:4000], keys[4000:]
    levels = U.cascade(listed, others)
    assert U.member(levels, listed).all() and not U.member(levels, others).any()
    assert len(levels) > 2 and levels[0].has(listed).all() and levels[0].has(others).sum() == levels[1].size
    with pytest.raises(ValueError):
        U.cascade(listed, np.concatenate([others, listed[:1]]))
