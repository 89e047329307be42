from framewise.llm import url_filters as uf


def brute(url, rules=uf.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        raw, rest = rest[:cut], rest[cut:]
        host = raw.translate({c: c + 32 for c in range(65, 91)})
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    "http://Example.ORG/es/x?q=1#f", "https://a.b.example.org/en/12", "https://notexample.org/en/1", "http://org/", "http://org", "http://x.com/de/", "http://com/de/a", "http://x.com/fr/../de/",
    "http://x.com?/de/", "ftp://x.com#/de/", "no scheme", "", None, "://x.com/de/", "http://user@x.com:80/de/", "http://é.com/de/é", "http://x.com/DE/", "http://./", "http://..com/de/", "http:///de/", "http://x.com/de/" + "a" * 100_000, "http://" + "a." * 20_000 + "com/de/", "http://x\n.com/de/\n",
]


def test_against_brute_force(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(1, URLS[1], "h", "r"), (None, URLS[0], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    out = sorted(map(tuple, uf.judge(df, uf.rules_frame(spark)).collect()), key=repr)
    assert out == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_ties_empty_rules_and_empty_pages(spark):
    rules = (("allow", "a.b", "/c"), ("block", "a.b", "/c"), ("allow", "b", "/c/dd"))
    df = spark.createDataFrame([(1, "http://a.b/c/dd"), (2, "http://x.b/c/dd"), (3, "http://a.b/c")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in uf.judge(df, uf.rules_frame(spark, rules)).collect()}
    assert out == {i + 1: brute(u, rules)[2:] for i, u in enumerate(["http://a.b/c/dd", "http://x.b/c/dd", "http://a.b/c"])}
    assert {r.verdict for r in uf.judge(df, uf.rules_frame(spark, ())).collect()} == {"allow"}
    assert uf.judge(df.limit(0), uf.rules_frame(spark)).collect() == []
