from pyspark.sql import functions as F

from latticework.llm import url_templates as ut

SCHEMA = "page_id long, url string, bad int"


def judged(spark, rows, settings=ut.Settings()):
    return {r.page_id: r for r in ut.judged(spark.createDataFrame(rows, SCHEMA), settings).collect()}


def test_host_path_and_rules(spark):
    urls = ["HTTP://WWW.Example.COM/en/1?x=/a", "http://a.example.com/en/2", "ftp://m.x.net/fr/", "http://x.net", "http://x.net?u=http://y/",
            None, "no scheme/x", "a://", "x://com/", "http://notexample.com/en/1", "http://x.net/es/#/fr/", "http://ÄB.net/fr", "z://h/p\n/q"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/2", "example.com/en/"), ("m.x.net", "/fr/", "net/fr/"),
        ("x.net", "", None), ("x.net", "", None), ("", "", None), ("", "", None), ("", "", None), ("com", "/", "com/"),
        ("notexample.com", "/en/1", "com/"), ("x.net", "/es/", "net/es/"), ("Äb.net", "/fr", None), ("h", "/p\n/q", None),
    ]
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[2].verdict == "block"


def test_bad_branches_are_rejected_and_others_merge(spark):
    rows = [(i, f"http://h.org/{['news', 'blog', 'spam'][i % 3]}/{i}", int(i % 3 == 2)) for i in range(600)]
    rows += [(1000, "http://h.org/spam/12345", None), (1001, "http://h.org/news/777", None), (1002, "http://h.org/other/7", None)]
    got = judged(spark, rows)
    assert got[1000].template == "/spam/*" and got[1000].verdict == "block"
    assert got[1001].verdict == "allow" and got[1002].verdict == "allow"
    same = judged(spark, [(i, f"http://h.org/{'ab'[i % 2]}/{i}", int(i % 7 == 0)) for i in range(400)])
    assert {r.template for r in same.values()} == {"/*/*"}


def test_small_branches_of_large_hosts_and_deep_ones(spark):
    branch = [(i, f"http://h.org/spam/{i}", 1) for i in range(60)]
    others = [(1000 + i, f"http://h.org/d{i % 40}/{i}", 0) for i in range(4000)]
    deep = [(9000 + i, f"http://g.org/a/b/c/d/e/f/{'good' if i % 2 else 'bad'}/{i}", 1 - i % 2) for i in range(200)]
    long = [(9900, "http://g.org/" + "/".join("abcdefghijkl"), None)]
    got = judged(spark, branch + others + deep + long)
    assert got[7].template == "/spam/*" and got[7].verdict == "block" and got[1007].verdict == "allow"
    assert got[9000].template == "/*/*/*/*/*/*/bad/*" and got[9000].verdict == "block" and got[9001].verdict == "allow"
    assert got[9900].template.count("*") == 12
    assert judged(spark, branch + others[:400])[7].verdict == "block"


def test_edges(spark):
    rows = [(1, "http://h/a", 1), (1, "http://h/a", 1), (None, None, None), (2, "http://h/" + "/".join("abcdefghij"), None), (3, "http://h/" + "x" * 50_000, None)]
    urls = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("mine")).withColumn("template", F.lit(1))
    got = ut.judged(urls).collect()
    assert len(got) == 5 and all(r.verdict in ("allow", "block") for r in got)
    assert ut.judged(urls.limit(0)).count() == 0
