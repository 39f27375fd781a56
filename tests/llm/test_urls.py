import random

from pyspark.sql import functions as F

from tidemark.llm import urls as U

PAGES = "page_id long, url string"


def slow(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def check(spark, rows, rules):
    got = U.filter_urls(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("x")).withColumn("rule", F.lit("y")), rules).collect()
    want = [(i, *slow(u, rules)) for i, u in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, h, p, r, v or "allow")) for i, h, p, r, v in want)


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "WWW.Example.COM", "notexample.com", "net", "x.net", "example.org", "", "a..com", "com:80", "ünï.net", ".com"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/es/", "/fr/1", "/é", "?q=/en/", "#/en/", "/en/?a#b", "/x?y://z/en/"]
    rows = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(600)]
    rows += [(1, None), (None, "http://net/es/"), (2, ""), (3, "no scheme/en/"), (4, "://"), (5, "http://" + "a." * 20_000 + "net/es/" + "x" * 50_000), (5, "http://net/es/\nx"), (5, "http://net/es/\nx")]
    check(spark, rows, U.RULES)
    many = [(rnd.choice(U.VERDICTS), f"h{i % 50}.example.com", f"/p{i}/"[:rnd.randint(1, 6)]) for i in range(300)]
    unique = {h + p: (v, h, p) for v, h, p in many}
    check(spark, [(i, f"http://s.h{rnd.randint(0, 60)}.example.com/p{rnd.randint(0, 400)}/x") for i in range(500)], list(unique.values()))
    check(spark, rows[:20], [])


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_equal_digests_are_told_apart_by_the_string(spark, monkeypatch):
    monkeypatch.setattr(U, "_digest", lambda keys: __import__("numpy").array([len(k) % 2 for k in keys], "u8"))
    probe = U.Probe(U.build_index(spark, U.RULES))
    for url in ("https://www.example.com/en/1", "https://example.com/en/", "http://x.net/fr/", "http://x.org/", "http://a.com/"):
        host, path = slow(url, [])[:2]
        assert [x[0] for x in probe.judge([host], [path])] == list(slow(url, U.RULES)[2:])


def test_too_large_a_rule_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(U, "INDEX_BYTES", 100)
    try:
        U.build_index(spark, U.RULES)
    except ValueError:
        return
    raise AssertionError("the bound was not checked")
