from newsmood.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]


def judged(spark, urls, listed):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr(
        "*", "'x' AS host", "'x' AS canon", "'x' AS block", "'x' AS maybe", "'x' AS listed")
    rows = url_filter.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES).collect()
    return {r.page_id: r for r in rows}


def test_rules_and_list(spark):
    urls = ["http://A.Example.com/en/x?y#z", "http://www.example.com/en/", "https://b.example.com/de", "http://example.com",
            "http://bad.org/p/?utm_source=q&a=1#t", "http://www.BAD.org/p?a=1", "http://bad.org/P?a=1", None, "no host",
            "ftp://x/?q", "http://notexample.com/en/", "http://é.org/ü\n?x", "a://b://c"]
    got = judged(spark, urls, ["https://bad.org/p/?a=1&ref=z", None, "nothing", "https://bad.org/p?a=1"])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("b.example.com", "/de", "com/", "allow"), ("example.com", "", None, "allow"),
        ("bad.org", "/p/", None, "block"), ("www.bad.org", "/p", None, "block"), ("bad.org", "/P", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("x", "/", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("é.org", "/ü\n", None, "allow"), ("b:", "//c", None, "allow")]


def test_no_listed_url_is_missed_and_few_others_pass(spark, monkeypatch):
    listed = spark.range(3_000).selectExpr("concat('http://h', id, '.org/x') AS url")
    rows = spark.range(9_000).selectExpr("id AS page_id", "concat('http://www.h', id % 6000, '.org/x/') AS url")
    for bound in (url_filter.BROADCAST_BYTES, 0):  # with and without a broadcast
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
        got = url_filter.judge(rows, listed, []).collect()
        assert len(got) == 9_000
        assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(9_000) if i % 6_000 < 3_000}
    marked = rows.select("page_id", url_filter.canonical(rows.url).alias("canon"))
    keys = listed.select(url_filter.canonical(listed.url).alias("canon"))
    maybe = url_filter.possible_hits(marked, keys, url_filter.block_count(3_000)).where("maybe").count()
    assert 6_000 <= maybe <= 6_000 + 3_000 * 0.02


def test_empty_tables(spark):
    assert judged(spark, [], ["http://a/b"]) == {}
    got = judged(spark, ["http://a/b", "http://a/b"], [])
    assert [got[i].verdict for i in (0, 1)] == ["allow", "allow"]
