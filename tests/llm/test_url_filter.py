import random
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeledger.llm import url_filter as uf
from cladeledger.llm.queries import URL_RULES


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judge(url, rules):
    host, path = split(url)
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, _ = min(fits, default=(0, None, None))
    verdicts = {v for _, r, v in fits if r == rule}
    return host, path, rule, "block" if "block" in verdicts else "allow"


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string").repartition(3)
    listed = spark.createDataFrame(rules, uf.RULES)
    return {r.page_id: tuple(r)[1:] for r in uf.judge(pages, listed).collect()}


ODD = [
    None, "", "no scheme", "http://", "http:///x", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y#z", "http://net/x", "http://notnet/x", "http://x.example.net/en/1",
    "http://x.example.net/en", "http://x.example.net/EN/", "http://example.com/de/", "http://example.com/de", "http://my.example.com/de/x", "http://a.org/fr/?q=1",
    "http://a.org/fr", "http://a..org/fr/", "http://.org/fr/", "ftp://a.net/en/://b.org/fr/", "a://b://c.net/", "http://a.net?x=/en/", "http://a.net#/", "http://a.net:80/",
    "http://user@a.net/", "http://É.net/ü", "http://a.net/" + "y" * 20000, "http://a.net/\nx", "x\n://a.net/", "http://a.net/", "http://a.net/",
]


@pytest.mark.parametrize("rules", [list(URL_RULES), [], [("a.net", "", "block"), ("a.net", "/", "allow"), ("a.net", "/", "block")]])
def test_odd_urls(spark, rules):
    assert run(spark, ODD, rules) == {i: judge(u, rules) for i, u in enumerate(ODD)}
    assert run(spark, [], rules) == {}


def test_many_rules(spark):
    rng = random.Random(3)
    hosts = [f"h{rng.randrange(400)}.d{rng.randrange(60)}.{rng.choice(['net', 'org'])}" for _ in range(1500)]
    urls = [f"https://{h}/{rng.choice(['en', 'fr', 'x'])}/{quote(str(i))}" for i, h in enumerate(hosts)]
    rules = [(rng.choice([h, h.split(".", 1)[1]]), rng.choice(["/", "/en/", "/f"]), rng.choice(["block", "allow"])) for h in rng.sample(hosts, 300)]
    assert run(spark, urls, rules) == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_the_universe(spark, monkeypatch):
    monkeypatch.setattr(uf, "PROBES", 1)
    universe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 7 = 0").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = uf.build(universe, listed)
    assert len(cascade.levels) > 2
    hashes = np.array([r[0] for r in universe.select(F.xxhash64("key")).collect()], np.int64).view(np.uint64)
    inside = {r[0] for r in listed.filter("key is not null").select(F.xxhash64("key")).collect()}
    assert cascade.contains(hashes).tolist() == [h in inside for h in hashes.view(np.int64).tolist()]


def test_long_lists_are_refused(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAX_FILTER_BYTES", 100)
    with pytest.raises(ValueError, match="exceeds"):
        uf.build(spark.range(10).selectExpr("cast(id as string) as key"), spark.range(5).selectExpr("cast(id as string) as key"))
