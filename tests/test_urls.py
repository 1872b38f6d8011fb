"""URL and policy vectors."""

from pyspark.sql import functions as F

from pageframe.functions import policy as R
from pageframe.functions import urls as U


def test_local_host(ask):
    got = ask(R.is_local_host, ["localhost", "ip6-localhost", "foo.localhost", "bar.local", "", None,
                                "example.com", "google.com"])
    assert got == [True] * 6 + [False] * 2


def test_private_ip(ask):
    yes = ["127.0.0.1", "::1", "10.0.0.1", "192.168.1.1", "172.16.0.1", "172.31.255.255",
           "169.254.1.1", "0.0.0.0", "fe80::1", "fd00::5", "::ffff:192.168.0.1", "[::1]", "0x7f.1"]
    no = ["8.8.8.8", "1.1.1.1", "not-an-ip", "172.32.0.1", "100.64.0.1", "224.0.0.1",
          "255.255.255.255", "2001:db8::1", "::ffff:8.8.8.8", "", None]
    assert ask(R.is_private_ip, yes) == [True] * len(yes)
    assert ask(R.is_private_ip, no) == [False] * len(no)


def test_ip_literal(ask):
    assert ask(R.is_ip_literal, ["127.0.0.1", "::1", "8.8.8.8", "example.com", ""]) == [
        True, True, True, False, False]


def test_private_hostname(ask):
    yes = ["foo.internal", "box.home", "ns.corp", "svc.lan", "10.1.2.3", "192.168.0.1", "172.20.0.1"]
    assert ask(R.is_private_hostname, yes) == [True] * len(yes)
    assert ask(R.is_private_hostname, ["example.com", "api.github.com", "x.example.com"]) == [False] * 3


def test_url_parts(ask):
    got = ask(U.url_parts, ["https://example.com/path?q=1", "not a url", "", None, "HTTP://A.com:80"])
    assert got[0]["host"] == "example.com" and got[0]["query"] == "?q=1"
    assert got[1:4] == [None, None, None]
    assert (got[4]["host"], got[4]["port"], got[4]["path"]) == ("a.com", None, "/")


def test_http(ask):
    assert ask(U.is_http, ["http://x.com", "https://x.com", "ftp://x.com", "file:///etc/passwd", None]) == [
        True, True, False, False, False]


def test_policy_reasons(spark):
    cases = {
        "http://localhost/secret": "blocked_localhost",
        "http://192.168.1.1/admin": "blocked_private_ip",
        "http://[::1]/x": "blocked_private_ip",
        "http://0.0.0.0/": "blocked_private_ip",
        "http://2130706433/": "blocked_private_ip",
        "http://evil.com\\@127.0.0.1/": None,
        "http://u@127.0.0.1/": "blocked_private_ip",
        "http://a.test/": "blocked_private_hostname",
        "http://100.64.0.1/": None,
        "https://example.com/page": None,
        "not-a-url": "invalid_url",
        "ftp://example.com/file": "unsupported_protocol",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r["url"]: r["reason"] for r in R.url_policy(df).collect()}
    assert got == cases


def test_dns_fails_closed(spark):
    df = spark.createDataFrame([("http://a.com/",), ("http://b.com/",), ("http://c.com/",)], "url string")
    dns = spark.createDataFrame(
        [("a.com", "8.8.8.8"), ("b.com", "8.8.8.8"), ("b.com", "10.0.0.1")], "host string, address string")
    got = {r["url"]: r["reason"] for r in R.url_policy(df, "url", dns).collect()}
    assert got["http://a.com/"] is None
    assert got["http://b.com/"] == got["http://c.com/"] == "blocked_private_resolution"


def test_resolve(ask):
    base = F.lit("https://Ex.com/d/e/f.html?z=1#q")
    cases = {
        "/für x": "https://ex.com/f%C3%BCr%20x",
        "../a/./b": "https://ex.com/d/a/b",
        "?q=1": "https://ex.com/d/e/f.html?q=1",
        "#f": "https://ex.com/d/e/f.html?z=1#f",
        "//cdn.x.com/a": "https://cdn.x.com/a",
        "mailto:x@y.z": "mailto:x@y.z",
        "http://A.com:80": "http://a.com/",
        "": "https://ex.com/d/e/f.html?z=1",
        "https://bad host/": None,
        "./": "https://ex.com/d/e/",
        "/a/b/../c/./d": "https://ex.com/a/c/d",
        "/../../x": "https://ex.com/x",
    }
    assert ask(lambda c: U.resolve_url(c, base), list(cases)) == list(cases.values())


def test_cache_key(ask):
    def key(c):
        return U.cache_key("p", {"z": c, "a": F.lit(2)})

    def other(c):
        return U.cache_key("p", {"a": F.lit(2), "z": c})

    got = ask(key, ["x", "x", "y"])
    assert len(got[0]) == 24 and got[0] == got[1] != got[2]
    assert ask(other, ["x"]) == got[:1]
    assert ask(lambda c: U.cache_key("q", {"z": c, "a": F.lit(2)}), ["x"]) != got[:1]


def test_small_rules(ask):
    assert ask(U.url_dedup_key, ["https://A.com/x/", "https://a.com/X"]) == ["https://a.com/x"] * 2
    assert ask(U.csv_list, [" a, b ,,c\n", None, ""]) == [["a", "b", "c"], [], []]
    assert ask(U.rstrip_slash, ["http://a///"]) == ["http://a"]
    assert ask(U.host_suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert ask(R.is_tracker, ["https://www.Google-Analytics.com/x", "https://a.com"]) == [True, False]


def test_other_spellings_of_hosts_do_not_pass(spark):
    from pyspark.sql import functions as F

    from pageframe.functions import policy as R

    urls = ["http://127\u30020\u30020\u30021/", "http://\uff11\uff12\uff17.0.0.1/", "http://127\uff0e0\uff610.1/",
            "http://\u2460\u2461\u2466.0.0.1/", "http://127.0.0\u00ad.1/", "http://\uff4c\uff4f\uff43\uff41\uff4c\uff48\uff4f\uff53\uff54/"]
    df = spark.createDataFrame([(u,) for u in [*urls, "https://m\u00fcnchen.example.com/"]], "url string")
    got = {r["url"]: r["ok"] for r in R.url_policy(df).collect()}
    assert not any(got[u] for u in urls) and got["https://m\u00fcnchen.example.com/"]
