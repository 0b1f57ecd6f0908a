from stopflow.llm import host_reputation as H


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return {r["page_id"]: r.asDict() for r in H.judge(pages, spark.createDataFrame(list(outcomes), "page_id long, bad int")).collect()}


def test_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/1", "http://b.net/x", "http://net", "http://notnet/x", "ftp://example.com/de/1?x#y", "http://a.org/fr/", "http://a.org/FR/", None, "no scheme/x", "x://H.org/fr/?a://b", "", "http://example.net/de/"]
    got = judged(spark, urls)
    assert [got[i]["host"] for i in range(12)] == ["a.example.net", "b.net", "net", "notnet", "example.com", "a.org", "a.org", "", "", "h.org", "", "example.net"]
    assert [got[i]["path"] for i in range(12)] == ["/en/1", "/x", "", "/x", "/de/1", "/fr/", "/FR/", "", "", "/fr/", "", "/de/"]
    assert [got[i]["rule"] for i in range(12)] == ["example.net/en/", "net/", None, None, "example.com/de/", "org/fr/", None, None, None, "org/fr/", None, "net/"]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and got[4]["verdict"] == "block"


def test_bad_hosts_are_blocked_only_with_evidence(spark):
    urls = ["http://bad.site.com/"] * 40 + ["http://good.site.com/"] * 40 + ["http://new.site.com/", "http://bad.other.com/"]
    outcomes = [(i, 1) for i in range(40)] + [(i, 0) for i in range(40, 80)] + [(81, 1), (5, None), (None, 1)]
    got = judged(spark, urls, outcomes)
    assert got[0]["verdict"] == "block" and got[40]["verdict"] == "allow"
    assert got[80]["verdict"] == "allow" and got[81]["verdict"] == "allow"
    # shrinkage: the unknown host lies between its neighbours, certainty falls with few labels
    assert got[40]["bad_mean"] < got[80]["bad_mean"] < got[0]["bad_mean"] < 1
    assert got[81]["bad_sd"] > got[0]["bad_sd"]


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.com/"])[0]["verdict"] == "allow"


def test_repeated_rows_and_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (1, "http://b.com/")], "page_id long, url string")
    out = H.judge(pages, spark.createDataFrame([(1, 1), (1, 0)], "page_id long, bad int")).collect()
    assert len(out) == 3 and {r["n_labelled"] for r in out if r["host"] == "a.com"} == {4}


def test_domains_below_suffixes_of_two_labels(spark):
    urls = ["http://a.one.co.uk/", "http://www.two.co.uk:8080/x", "http://co.uk/", "http://x.com:80/", "http://sub.x.com/", "http://uk/", "http://h:/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["domain"], r["suffix"]) for r in H.with_parts(pages).collect()}
    assert got == {0: ("a.one.co.uk", "one.co.uk", "co.uk"), 1: ("www.two.co.uk:8080", "two.co.uk", "co.uk"), 2: ("co.uk", "co.uk", "co.uk"), 3: ("x.com:80", "x.com", "com"),
                   4: ("sub.x.com", "x.com", "com"), 5: ("uk", "uk", "uk"), 6: ("h:", "h", "h")}
    # owners below one suffix are told apart
    many = spark.createDataFrame([(i, f"http://bad.one.co.uk/{i}") for i in range(60)] + [(100 + i, f"http://good.two.co.uk/{i}") for i in range(60)] + [(200, "http://new.one.co.uk/"), (201, "http://new.two.co.uk/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)], "page_id long, bad int")
    judged = {r["page_id"]: r for r in H.judge(many, outcomes).collect()}
    assert judged[200]["bad_mean"] > 0.5 > judged[201]["bad_mean"]
