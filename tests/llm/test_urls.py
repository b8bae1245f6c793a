"""URL parsing and rules against Python; mined rules against counting."""
import itertools
import re

from pyspark.sql import functions as F

from spreadforge.llm import urls

SF = "/root/testdata/sf0.01"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query_rules_and_verdicts(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.page_id: r for r in urls.judge(pages, urls.labelled_pages(pages, labels)).collect()}
    seen = set()
    for r in pages.select("page_id", "url").collect():
        host, path = parse(r.url)
        want, verdict = rule(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, want)
        assert g.verdict == verdict if want else g.verdict in ("allow", "block")
        seen.add(want)
    assert len(seen) >= 3


def test_odd_urls(spark):
    texts = [None, "", "no scheme", "http://", "http://ORG", "http://x.ORG/", "a://b://c/d", "http://example.org?x=/es/", "https://a.EXAMPLE.org/es/1#f",
             "http://badexample.org/es/", "http://com/de/", "http://É.com/fr/x y", "x://h#/fr/", "http://example.org/en/12", "http://example.org/EN/1", "http://www.com/de"]
    pages = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)] + [(None, "http://a.org/", "h"), (1, "", "z")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, verdict string")
    got = urls.judge(pages, none).collect()
    assert len(got) == len(texts) + 2
    by = {r.page_id: r for r in got}
    for i, t in enumerate(texts):
        host, path = parse(t)
        want, verdict = rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, want, verdict or "allow"), t
    assert by[None].rule == "org/"
    assert urls.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(f"http://spam{i % 3}.net/buy/{i}", "block") for i in range(30)] + [(f"http://news.net/buy/{i}?ref=a", "allow") for i in range(20)]
    rows += [(f"http://news.net/read/{i}", "allow" if i % 4 else "block") for i in range(40)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    mined = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mine(labelled, 0.05, 0.7).collect()}
    data = [(set(t), v) for t, v in labelled.select(urls.tokens_of(F.col("url")), "verdict").collect()]
    every = {}
    for size in range(1, 8):
        for combo in {c for t, _ in data for c in itertools.combinations(sorted(t), size)}:
            n = sum(set(combo) <= t for t, _ in data)
            for v in ("allow", "block"):
                k = sum(set(combo) <= t and v == w for t, w in data)
                if k / len(data) >= 0.05 and k / n >= 0.7:
                    every[(combo, v)] = (round(k / n, 9), round(k / len(data), 9))
    want = {key: val for key, val in every.items()
            if not any(set(c) < set(key[0]) and v == key[1] and x[0] >= val[0] for (c, v), x in every.items())}
    assert mined == want
    pages = spark.createDataFrame([(1, "http://spam1.net/buy/77"), (2, "http://news.net/buy/1?ref=a"), (3, "http://other.io/x")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled, (), 0.05, 0.7).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_support_is_a_number_of_pages_with_a_confidence_bound(spark):
    """A blocked host with 25 labels is found among a hundred thousand others
    (its share is far below any fixed one); three blocked pages prove nothing."""
    rows = [(f"http://bad.net/x/{i}", "block") for i in range(25)] + [(f"http://few.net/x/{i}", "block") for i in range(3)]
    rows += [(f"http://mixed.net/x/{i}", "block" if i % 3 else "allow") for i in range(30)]
    many = spark.range(100_000).selectExpr("concat('http://h', id % 500, '.org/p/', id) AS url", "IF(id % 7 = 0, 'block', 'allow') AS verdict")
    labelled = spark.createDataFrame(rows, "url string, verdict string").unionByName(many)
    pages = spark.createDataFrame([(1, "http://bad.net/y"), (2, "http://few.net/y"), (3, "http://mixed.net/y"), (4, "http://h3.org/p/1"), (5, "http://sub.bad.net/q")],
                                  "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled, ()).collect()}
    # two thirds of 30 pages: the lower end of the share is 0.49
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def test_sample_bounds_the_pages_mined(spark):
    labelled = spark.range(20_000).selectExpr("concat('http://bad.net/', id) AS url", "'block' AS verdict", "id AS page_id")
    r = urls.mine(labelled, sample=1000).collect()
    assert r and all(x.verdict == "block" and x.support <= 1 for x in r)
    assert urls.mine(labelled.limit(19), min_pages=20).count() == 0
    assert urls.mine(labelled.limit(20), min_pages=20).count() > 0


def test_wilson_low(spark):
    row = spark.range(1).select(urls.wilson_low(F.lit(1.0), F.lit(20.0), 1.96).alias("a"), urls.wilson_low(F.lit(0.6), F.lit(50.0), 1.96).alias("b"),
                                urls.wilson_low(F.lit(0.7), F.lit(9.0), 0.0).alias("c")).first()
    assert (round(row.a, 4), round(row.b, 4), round(row.c, 4)) == (0.8389, 0.4618, 0.7)
