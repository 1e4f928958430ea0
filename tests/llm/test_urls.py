"""Verdicts behind the filter equal those of a plain loop over rules and listed urls."""

import random
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest

from modeflow.llm import urls
from modeflow.llm.urls import RULES, bits, canonical, hashes, judge, passed

RULE = "host string, path string, verdict string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[n:]
    m = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:n].translate(LOWER), path[:m]


def plain(url):
    if url is None or "://" not in url:
        return None
    host, path = parts(url)
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    query = url.split("://", 1)[1].split("#", 1)[0].partition("?")[2]
    kept = sorted(p for p in query.split("&") if p and not (p.startswith("utm_") or p.split("=")[0] in ("gclid", "fbclid", "ref")))
    return host.removeprefix("www.") + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def brute(rows, rules, listed):
    named = {plain(u) for u in listed} - {None}
    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v == "block") for h, p, v in rules if h and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        hit = plain(url) in named
        out.append((i, host, path, best and best[2], ("block" if best[3] else "allow") if best else "block" if hit else "allow", hit))
    return sorted(out, key=str)


ODD = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.NET:80/EN/a", "https://example.net/en/", "https://example.net/en", "http://a.b.example.net/en/x?y#z", "http://net/", "http://x.net", "http://xnet/", "http://.net/", "http://net./", "ftp://u:p@q.org/fr/1",
    "http://org?/fr/", "http://org#/fr/", "http://example.com/de/1?utm_source=a&b=2&a=1&&gclid=3&reference=1", "http://www.example.com/de/1/?a=1&b=2&reference=1#top", "a://b://c/d", "http://ünï.org/fr/é", "http://x.org/fr/\n", "http://" + "a." * 3000 + "net/" + "p/" * 20_000, "http://x.com/?ref=1", "http://x.com",
]


def judged(spark, rows, rules, listed):
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as id", "'k' as key", "'v' as verdict", "'h' as host").repartition(4)
    got = judge(df, spark.createDataFrame(rules, RULE), spark.createDataFrame([(u,) for u in listed], "url string"))
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "listed")) for r in got.collect()), key=str)


def test_odd_urls(spark):
    rows = [*enumerate(ODD), (3, ODD[6]), (3, ODD[6]), (None, ODD[7]), (None, None), (None, None)]
    listed = [ODD[5], ODD[17], "https://x.com/#a", None, "nothing"]
    assert judged(spark, rows, RULES, listed) == brute(rows, RULES, listed)


def test_canonical(spark):
    got = spark.createDataFrame([(u,) for u in ODD], "url string").select("url", canonical(urls.F.col("url")).alias("c")).collect()
    assert [r["c"] for r in got] == [plain(r["url"]) for r in got]
    assert urlsplit("https://example.net/en/").netloc == plain("https://example.net/en/").split("/")[0]


@pytest.mark.parametrize("blocks", [1, 3, 1 << 17])
def test_any_filter_gives_the_same(spark, monkeypatch, blocks):
    """A filter of one block passes nearly everything; the join removes it."""
    rng = random.Random(blocks)
    host = lambda: ".".join(rng.choice(["a", "b", "net", "org", "x"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "en", "b/"]) for _ in range(rng.randrange(4)))
    rows = [(i, f"http://{host()}{path()}{rng.choice(['', '?b=1&a=2', '#x'])}") for i in range(600)]
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "/", None)]
    listed = [u for _, u in rows[::7]]
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 0 if blocks == 3 else 50_000)
    assert judged(spark, rows, rules, listed) == brute(rows, rules, listed)


def test_filter_passes_all_listed_and_few_others():
    listed, others = (pa.array([f"{c}{i}" for i in range(20_000)]) for c in "ab")
    words = np.zeros((20_000 * urls.BITS_A_KEY // 512, 8), np.uint64)
    at, sets = bits(hashes(listed), len(words))
    np.bitwise_or.at(words, at, sets)
    assert passed(words, listed).all() and passed(words, others).mean() < 0.01


def test_one_hot_url(spark):
    """A url of a third of all rows asks once, and each of its rows is answered."""
    rows = [(i, "http://hot.net/x" if i % 3 == 0 else f"http://h{i}.com/de/") for i in range(9000)]
    got = judged(spark, rows, RULES, ["https://h1.com/de"])
    assert len(got) == 9000 and sum(r[4] == "block" for r in got) == 3001


def test_empty_tables(spark):
    assert judged(spark, [], RULES, ["http://x.com"]) == []
    assert judged(spark, [(1, "http://x.net/")], [], []) == [(1, "x.net", "/", None, "allow", False)]
