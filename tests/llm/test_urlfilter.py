import pytest

from phasewell.llm import urlfilter as u

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def verdicts(spark, urls):
    df = spark.createDataFrame([(i, x, None, "h", 3) for i, x in enumerate(urls)], SCHEMA)
    return [tuple(r)[1:7] for r in sorted(u.url_verdicts(df).collect())]


def test_rules_and_vocabulary(spark):
    urls = [None, "", "no mark/xxx", "http://", "HTTP://A.Example.ORG:80/x?y#z", "http://example.org/es/1", "http://x.example.org/en/12", "http://notexample.org/es/", "http://org", "http://a.com/fr/casino", "ftp://com/de/", "http://a.net/casino", "http://a.net/casinos", "http://free-bets.net/", "http://free.free.net/", "http://xfree.bets.net/?win", "a://b.net?c://d/e", "http://a.net/" + "y" * 9000 + "/porn"]
    got = verdicts(spark, urls)
    assert got == [
        ("", "", None, "allow", 0, 0), ("", "", None, "allow", 0, 0), ("", "", None, "block", 1, 0), ("", "", None, "allow", 0, 0),
        ("a.example.org:80", "/x", None, "allow", 0, 0), ("example.org", "/es/1", "example.org/es/", "block", 0, 0), ("x.example.org", "/en/12", "example.org/en/1", "block", 0, 0),
        ("notexample.org", "/es/", "org/", "allow", 0, 0), ("org", "", None, "allow", 0, 0), ("a.com", "/fr/casino", "com/fr/", "allow", 1, 0), ("com", "/de/", "com/de/", "block", 0, 0),
        ("a.net", "/casino", None, "block", 1, 0), ("a.net", "/casinos", None, "allow", 0, 0), ("free-bets.net", "/", None, "block", 0, 2), ("free.free.net", "/", None, "allow", 0, 1),
        ("xfree.bets.net", "/", None, "block", 0, 2), ("b.net", "", None, "allow", 0, 0), ("a.net", "/" + "y" * 9000 + "/porn", None, "block", 1, 0),
    ]


def test_empty_and_repeated(spark):
    assert verdicts(spark, []) == []
    assert len(set(verdicts(spark, ["http://a.org/"] * 3))) == 1


def test_weights_and_a_vocabulary_of_ones_own(spark):
    strict, soft = u.vocabulary(spark.createDataFrame([("bad", 9, True), ("meh", 2, False), ("hm", 1, False), ("hm", 1, False)], "term string, weight int, strict boolean"))
    assert (strict, soft) == (("bad",), {"hm": 1, "meh": 2})
    urls = ["http://a.net/bad", "http://a.net/meh/hm", "http://meh.net/hm", "http://meh.net/meh", "http://a.net/?hm=meh#hm-meh"]
    got = u.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), strict=strict, soft=soft).orderBy("page_id").collect()
    assert [(r.verdict, r.n_soft, r.soft_weight) for r in got] == [("block", 0, 0), ("allow", 2, 3), ("block", 2, 5), ("allow", 1, 4), ("allow", 2, 3)]
    with pytest.raises(ValueError):
        u.vocabulary(spark.createDataFrame([("Bad term", 1, True)], "term string, weight int, strict boolean"))
