"""A rule fits a host and its subdomains, never a host that is named inside a path."""

from ravelin.llm import oracles, urls


def test_rules_end_at_the_host(spark):
    rows = {
        "https://web.archive.org/web/http://www.example.com/en/7": (None, "allow"),
        "http://foo.org/a.com/en/1": (None, "allow"),
        "http://foo.org/.com/en/1": (None, "allow"),
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/7": ("example.com/en/7", "allow"),
        "http://foo.org/x/casino/1": (None, "block"),
        "http://foo.org/es/a.com/en/1": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert found == dict(enumerate(rows.values()))
    across = spark.createDataFrame([(1, "http://foo.org/a/b")], "page_id long, url string")
    assert urls.judge(across, blocked=("*org/a*",)).first()["matched"] == "*org/a*"


def test_rules_are_those_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in urls.RULES} == contract
    pages = spark.createDataFrame([(1, "http://casino.net/de/a.exe"), (2, "http://example.net/de/81")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages).collect()} == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block")}
    assert "starts_with(path, '/de/') THEN 'allow'" in oracles.op2()
