import random

from slipweave.llm import urlfilter

COLUMNS = "page_id long, url string, host string, rule int"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[:min(ends, default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p), len(h), h + p, a == "block") for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[2], "block" if best[3] else "allow"


def judged(spark, urls, rules, default="allow", **kw):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], COLUMNS)
    listed = spark.createDataFrame(rules, "host string, path string, action string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark, pages, listed, default, **kw).collect()}


def test_random_urls_against_brute_force(spark):
    rnd = random.Random(11)
    hosts = ["com", "net", "a.com", "b.a.com", "xa.com", "A.Com", "c.net", "é.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/fr/é"]
    urls = [rnd.choice(["http://", "://", "x:", "a://b://", ""]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?q=/en/", "#/en/", "/?a#b"]) for _ in range(600)]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h in ("com", "a.com", "net", "c.net", "é.net") for p in ("/", "/en/", "/fr/é", "") if rnd.random() < 0.7}.values())
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want
    assert judged(spark, urls, rules, max_words=0) == want  # a list too long for constants


def test_cascade_is_exact_over_its_universe(spark):
    rows = [(f"key{i}", i % 7 == 0) for i in range(5000)]
    levels = urlfilter.build(spark.createDataFrame(rows, "key string, listed boolean"))
    assert len(levels) > 1  # later levels took up the first one's false positives
    found = spark.createDataFrame(rows, "key string, listed boolean").select("listed", urlfilter.listed(urlfilter.F.col("key"), levels).alias("said"))
    assert found.where("listed <> said").count() == 0


def test_odd_rows(spark):
    rules = [("com", "/", "block"), ("com", "/", "allow"), ("Net", "/x", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "/a", "other")]
    urls = [None, "", "no scheme", "http://", "http://com/", "http://com/", "http://com", "http://w.NET/x" + "y" * 100_000, "http://org/a", "http://a..com/", "http://" + "d." * 500 + "com/"]
    got = judged(spark, urls, rules)
    assert [got[i][2:] for i in range(len(urls))] == [
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "block"), ("com/", "block"), (None, "allow"),
        ("net/x", "block"), (None, "allow"), ("com/", "block"), ("com/", "block"),
    ]
    assert got[0][:2] == ("", "") and got[7][0] == "w.net"
    assert judged(spark, [], rules) == {}
    assert judged(spark, ["http://com/"], [], "block") == {0: ("com", "/", None, "block")}
