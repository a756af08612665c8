import random

from textharbor.llm import url_rules
from textharbor.llm.queries import URL_RULES


def judged(spark, urls, rules=URL_RULES, **options):
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    return {r.page_id: r for r in url_rules.judge_urls(df, rules, **options).collect()}


def brute(host, path, rules):
    best = None
    for verdict, rule_host, rule_path in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            rank = (len(rule_host + rule_path), len(rule_host), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, rule_host + rule_path, verdict)
    return (best[1], best[2]) if best else (None, "allow")


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "example.net/en/", "http://WWW.Example.NET/en/x?q#f", "http://example.net", "https://a.org/fr/",
        "http://a.org/fr", "ftp://example.com/de/1#x", "http://x.example.com/de?y", "a://b://c.net/en/", "http://net/",
        "http://badexample.net/en/", "http://example.net/en/", "http://example.net/en/", "http:///x", "x://ÄB.net/\n",
    ]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    pairs = {i: (r.host, r.path) for i, r in got.items()}
    assert pairs[0] == pairs[1] == pairs[2] == ("", "")
    assert pairs[3] == ("www.example.net", "/en/x") and pairs[9] == ("b:", "//c.net/en/")
    assert pairs[15] == ("Äb.net", "/\n") and pairs[14] == ("", "/x")
    for r in got.values():
        assert (r.rule, r.verdict) == brute(r.host, r.path, URL_RULES)
    assert got[3].verdict == "allow" and got[10].rule == "net/" and got[4].rule is None


def test_nested_rules_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(rng.choice("pq") for _ in range(rng.randint(0, 3))) for _ in range(60)]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(paths)) for _ in range(40)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    for size in (1000, 7):
        monkeypatch.setattr(url_rules, "BLOCK_RULES", size)
        for r in judged(spark, urls, rules).values():
            assert (r.rule, r.verdict) == brute(r.host, r.path, rules)


def test_no_rules_and_no_rows(spark):
    assert judged(spark, ["http://a.net/"], rules=())[0].verdict == "allow"
    assert judged(spark, []) == {}


def test_a_very_long_url_and_clashing_columns(spark):
    url = "http://" + "a." * 200_000 + "example.net/en/" + "x" * 3_000_000
    rows = [(1, url, "x", "y", "z"), (2, "http://example.net/", "x", "y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, row string")
    got = {r.page_id: r for r in url_rules.judge_urls(df, URL_RULES).collect()}
    assert got[1].rule == "example.net/en/" and len(got[1].path) == 3_000_004 and got[2].rule == "net/"
