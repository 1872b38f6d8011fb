"""Inputs derived from the driver tables.

Each is one SQL text that Spark and DuckDB both read, so a query and its check
start from the same rows.  Every input covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROBE_URLS = [
    "https://example.com/path?q=1", "not a url", "", "ftp://x.com", "file:///etc/passwd",
    "http://[::1]/x", "http://0.0.0.0/", "http://a.test/", "http://100.64.0.1/",
    "http://2130706433/", "http://0x7f.1/", "http://[::ffff:10.0.0.1]/",
    "http://localhost/secret", "http://192.168.1.1/admin", "http://a b.com/",
    "http://u:p@127.0.0.1:8080/x", "HTTP://Ex.COM:80", "https://ex.com:443?x#y",
    "http://[fe80::1]/", "mailto:a@b.c", "http://255.255.255.255/", "http://1.2.3.999/",
    "http://a.com:foo/", "http://server.internal/api", "http://x.example.com/a/",
    "https://www.google-analytics.com/collect", "http://[fd00::1:2]/", "http://foo.localhost/",
    "http://0300.0250.1.1/", "http://[::]/", "https://a.com:70000/", "http://172.20.0.1.",
]
PROBE_IPS = [
    "127.0.0.1", "::1", "10.0.0.1", "192.168.1.1", "172.16.0.1", "172.31.255.255", "8.8.8.8",
    "1.1.1.1", "not-an-ip", "169.254.9.9", "0.0.0.0", "192.0.2.5", "198.18.0.1", "203.0.113.9",
    "240.0.0.1", "255.255.255.255", "224.0.0.1", "100.64.0.1", "fe80::1", "fc00::1", "fdff::2",
    "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "1::2::3", "0x7f.1",
    "172.32.0.1", "11.0.0.1", "",
]
PROBE_REFS = [
    "/für x", "../a/./b", "?q=1", "#f", "//cdn.x.com/a", "mailto:x@y.z", "http://A.com:80",
    "a/b/../c", "", "https://bad host/", "./", " /x ", "/a/b/../c/./d", "https://b.org:8443/p?q#r",
    "/plain/path.html", "..", "img/ä.png?ü=1", "javascript:void(0)", "/a<b>",
]


def _case(number: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {arms} END"


URL_PROBE = f"""
SELECT event_id AS id,
       CASE WHEN event_id % 3 = 0 THEN 'https://h' || user_id || '.example.org/p/' || event_id
            ELSE {_case('event_id', PROBE_URLS)} END AS url
FROM {{events}}
"""
IP_PROBE = f"SELECT event_id AS id, {_case('event_id', PROBE_IPS)} AS ip FROM {{events}}"
REF_PROBE = f"""
SELECT e.event_id AS id, {_case('e.event_id', PROBE_REFS)} AS href, p.url AS url
FROM (SELECT event_id, event_id % (SELECT count(*) FROM {{pages}}) AS page_id FROM {{events}}) e
JOIN {{pages}} p ON p.page_id = e.page_id
"""
SUBRESOURCES = f"""
SELECT id, url, {_case('id', ['image', 'font', 'media', 'stylesheet', 'texttrack', 'eventsource',
                              'websocket', 'manifest', 'other', 'document', 'script', 'xhr',
                              'fetch'])} AS resource_type
FROM ({URL_PROBE}) u
"""

# fragments of real-world HTML, spread over the pages by number
_HEAD = {
    0: '<meta property="og:title" content="OG &amp; title"><meta name="Description" content="first">'
       '<meta name="description" content="second"><meta name="author" content="A. Writer">',
    1: '<link rel="canonical" href="/canon/page"><link rel="shortcut icon" href="../fav.ico">'
       '<meta itemprop="keywords" content="k1, k2"><meta property="og:locale" content="en_GB">',
    2: '<link rel="apple-touch-icon" href="//cdn.example.org/t.png"><link rel="stylesheet" href="/s.css">'
       '<meta name="generator" content=plain><meta property="article:published_time" content="2024-01-02">',
    3: '<link rel="icon" href="http://bad host/i.png"><meta property="og:site_name" content="S">'
       '<meta property="og:type" content="article"><meta property="og:url" content="https://o.example/x">'
       '<meta property="og:image" content="i.png"><meta property="article:modified_time" content="m">',
}
_BODY = {
    0: '<table class="t"><tr><th>Name</th><th> Value </th></tr> <tr><td> a<br>b </td> <td></td></tr></table>',
    1: '<figure><img src="x.png"><figcaption>A <i>caption</i></figcaption></figure>'
       '<figure><img src="y.png"></figure><hr>',
    2: '<form><input name="q"><p>gone</p></form><aside>aside text</aside>'
       '<div class="left-sidebar"><p>side</p></div><p style="color:red">kept <em> spaced </em> text</p>',
    3: '<ul><li>one</li><li>two <ol><li>n one</li><li>n <b>two</b></li></ol></li><li>three</ul>'
       '<p>after, the list</p>',
    4: '<pre><code>x = 1' + '\n' + '  y &lt; 2</code></pre><p>inline <code>a*b</code> and ``</p>',
    5: '<blockquote><p>first quote</p><p>second *quote*</p></blockquote><p># not a heading</p>'
       '<p>1. not a list</p>',
    6: '<div id="cookie-banner" class="consent">We use cookies <a href="/c">more</a></div>'
       '<div role="navigation">menu</div><div aria-live="polite">live</div><p>&#8364; &#x41; &nbsp;end</p>',
    7: '<p><a href="https://abs.example.org/a?b=1&amp;c=2">abs</a> <a href="//h.example.org/q">host</a> '
       '<a href="../up">up</a> <a href="mailto:x@y.z">mail</a> <a title="a > b" href=bare>bare</a> '
       '<a name="n">none</a></p><p title="a>b>c>d>e">q &aacute;&frac12; &rarr; &Eacute;x &copy 1 &there4;</p>'
       '<p onclick="if(a>b)c=1">y</p><p><a "odd" href=/u/v/w t=/x/y>slashes</a></p><section><div>m1</div><div>m2</div></section>',
}


def _frag(table: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())
    return f"CASE page_id % 8 {arms} ELSE '' END"


RICH_PAGES = f"""
SELECT page_id, url,
       replace(replace(html, '</head>', {_frag(_HEAD)} || '</head>'),
               '</article>', {_frag(_BODY)} || '</article>') AS html
FROM {{pages}}
"""
FETCHED_PAGES = f"""
SELECT page_id, url, html,
       CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 0 ELSE 200 END AS status_code,
       CASE page_id % 7 WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'application/json'
            WHEN 5 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type
FROM ({RICH_PAGES}) r
"""
# networks of several lengths by customer, and addresses by event, near to them and far from them
NETWORKS = """
SELECT concat_ws('.', CAST(20 + c_custkey % 60 AS VARCHAR(9)), CAST(c_custkey % 251 AS VARCHAR(9)),
                 CAST(c_custkey * 7 % 256 AS VARCHAR(9)), CAST(c_custkey * 13 % 256 AS VARCHAR(9)))
       || '/' || CAST(16 + c_custkey % 15 AS VARCHAR(9)) AS network
FROM {customer}
"""
ADDRESSES = """
SELECT event_id, concat_ws('.', CAST(20 + event_id % 60 AS VARCHAR(9)), CAST(event_id % 251 AS VARCHAR(9)),
                 CAST(event_id * 7 % 256 AS VARCHAR(9)), CAST(event_id * 17 % 256 AS VARCHAR(9))) AS address
FROM {events}
"""
DNS = """
SELECT host, CASE n % 5 WHEN 1 THEN '10.0.0.1' WHEN 2 THEN '8.8.4.4' ELSE '8.8.8.8' END AS address
FROM {page_hosts} WHERE n % 5 <> 0
UNION ALL
SELECT host, '192.168.7.7' AS address FROM {page_hosts} WHERE n % 5 = 2
"""
PAGE_HOSTS = """
SELECT split_part(split_part(url, '/', 3), ':', 1) AS host, min(page_id) AS n
FROM {pages} GROUP BY split_part(split_part(url, '/', 3), ':', 1)
"""
HITS = """
SELECT e.user_id AS query_id, CAST(e.event_id AS INT) AS src_pos,
       CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE 'Title ' || p.page_id END AS title,
       CASE e.event_id % 11 WHEN 0 THEN upper(p.url) WHEN 1 THEN p.url || '/' WHEN 2 THEN NULL
            WHEN 3 THEN 'not a url' WHEN 4 THEN 'http://www.blocked.com/' || p.page_id
            WHEN 5 THEN 'http://unblocked.com/x' ELSE p.url END AS url,
       e.event_type || ' ' || e.props AS content,
       CASE e.event_id % 10 WHEN 0 THEN 'google' WHEN 1 THEN 'duckduckgo' WHEN 2 THEN 'brave'
            WHEN 3 THEN 'wikipedia' WHEN 4 THEN 'github' WHEN 5 THEN 'stackoverflow'
            WHEN 6 THEN 'google news' WHEN 7 THEN 'arxiv' WHEN 8 THEN '' ELSE 'bing' END AS engine,
       CASE WHEN e.event_id % 3 = 0 THEN split('arxiv,brave', ',') ELSE NULL END AS engines,
       CASE WHEN e.event_id % 19 = 0 THEN NULL
            ELSE CAST((e.event_id * 37 + e.user_id) % 17 AS DOUBLE) END AS score,
       CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE CAST(CAST(e.ts AS DATE) AS STRING) END AS publishedDate,
       CASE e.event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'news' ELSE 'general' END AS category
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_id FROM {events}) e
JOIN {pages} p ON p.page_id = e.page_id
"""
DOMAINS_EXCLUDED = """
SELECT 'Blocked.com' AS domain UNION ALL SELECT 'example.net' AS domain
"""
DOMAINS_INCLUDED = """
SELECT 'example.org' AS domain UNION ALL SELECT 'unblocked.com' AS domain
"""
# one row per user: the search requests
QUERIES = """
SELECT c_custkey AS query_id,
       CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' ELSE c_name END AS query,
       CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-3'
            WHEN 4 THEN '5' WHEN 5 THEN '50' WHEN 6 THEN '3.9' WHEN 7 THEN '0.5' WHEN 8 THEN '1e1'
            WHEN 9 THEN '20' ELSE '' END AS limit_raw,
       CASE c_custkey % 3 WHEN 0 THEN split('web,news', ',') WHEN 1 THEN split('web', ',')
            ELSE NULL END AS sources,
       CASE c_custkey % 4 WHEN 0 THEN split('a.com,b.org', ',') WHEN 1 THEN split('a.com', ',')
            ELSE NULL END AS domains
FROM {customer}
"""
REQUESTS = """
SELECT page_id AS request_id,
       CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'http://10.1.1.1/x'
            WHEN 3 THEN 'ftp://x.com' WHEN 4 THEN 'nonsense' ELSE url END AS url
FROM {pages}
UNION ALL
SELECT page_id + 1000000000 AS request_id, url FROM {pages}
"""
REQUEST_LOG = """
SELECT event_id AS request_id, user_id AS cache_key, ts,
       'POST' AS method,
       CASE WHEN event_type = 'purchase' THEN '/v2/search' ELSE '/v2/scrape' END AS route,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code,
       value / 20 AS duration_s
FROM {events}
"""
CHECKS = """
SELECT user_id AS run_id,
       CASE WHEN event_type = 'error' AND value > 150 THEN 'error: ' || event_id ELSE 'ok' END AS status
FROM {events}
"""
STORE = """
SELECT page_id, url, CAST(page_id % 90 AS BIGINT) AS age_minutes, 'v' || page_id AS value
FROM {pages}
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The input as a Spark DataFrame."""
    if "{page_hosts}" in text:
        hosts = derived(spark, sf_dir, PAGE_HOSTS)
        return spark.sql(text, page_hosts=hosts)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same input as DuckDB text."""
    names = {t: t for t in TABLES}
    hosts = "(" + PAGE_HOSTS.format(**names).strip() + ") h"
    return text.format(page_hosts=hosts, **names).strip()
