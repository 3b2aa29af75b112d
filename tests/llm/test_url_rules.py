import re

from harvestlens.llm import url_rules


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split(r"[/?#]", rest, maxsplit=1)[0])
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "http://a.com/", "http://a.com", "HTTPS://WWW.Example.COM/en/x?q=/es/", "https://example.com/en/", "https://x.example.com/en", "https://b.example.net/es/1#t", "ftp://net/fr/",
    "notanurl", "", None, "a://b://c.com/x", "http://xcom/", "http://a.net/fr", "http://u.org?x=1", "http://badexample.com/en/1", "https://www.example.com/en/a/b",
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://z.org/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    want = {r["page_id"]: brute(r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in url_rules.op4_url_filter(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (host, path, rule, verdict) in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_mined_rules(spark):
    """Spam words are learned from labels, pruned to their shortest form, and found through the index."""
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = f"{'casino-win' if bad else 'garden'}{'.shop' if i % 3 else '.site'}.example.org"
        pages.append((i, f"https://{host}/p/{i}?page=2"))
        labels.append((i, 0 if bad and i % 20 else 1, 0))
    pages += [(1000, "http://casino-win.other.org/x"), (1001, "http://garden.other.org/x"), (1002, "http://casino-win.a.com/x"), (1003, "http://casino.other.org/")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([*labels, (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge(p, lab).collect()}
    assert [got[i]["verdict"] for i in (1000, 1001, 1002, 1003)] == ["block", "allow", "allow", "block"]
    assert got[1000]["mined"] in ("word=casino", "word=win") and 0.6 <= got[1000]["confidence"] < 1
    rules = url_rules.mine(url_rules.parsed(p).withColumn("tokens", url_rules.tokens()), lab).collect()
    assert {"word=casino"} in [set(r["items"]) for r in rules]
    assert not any({"word=casino", "word=win"} <= set(r["items"]) for r in rules)
