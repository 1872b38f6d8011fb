"""Search, store, TTL and streaming behaviour."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pageframe.functions import urls as U
from pageframe.operators import search as Q
from pageframe.operators import store as ST
from pageframe.operators import ttl as L
from pageframe.plans import batch as B
from pageframe.streaming import streams as SS


def test_limits_and_queries(ask):
    raw = [None, "abc", "0", "-3", "5", "50", "3.9", "0.5", "Infinity", "NaN"]
    assert ask(Q.coerce_limit, raw) == [10, 10, 10, 10, 5, 20, 3, 0, 10, 10]
    assert ask(Q.validate_query, [None, "", "  ", "x"]) == [400, 400, 500, 200]
    domains = F.array(F.lit("a.com"), F.lit("b.org"))
    assert ask(lambda c: Q.effective_query(c, domains), ["rust"]) == ["rust (site:a.com OR site:b.org)"]


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, src_pos int, url string, score double")


def test_exclude_keeps_what_does_not_parse(spark):
    hits = _hits(spark, [(1, 0, "http://x.b.com/", 1.0), (1, 1, "http://B.com/", 1.0),
                         (1, 2, "http://ab.com/", 1.0), (1, 3, "nope", 1.0), (1, 4, None, 1.0)])
    domains = spark.createDataFrame([("b.com",)], "domain string")
    assert sorted(r["src_pos"] for r in Q.exclude_domains(hits, domains).collect()) == [2, 3, 4]
    assert sorted(r["src_pos"] for r in Q.include_domains(hits, domains).collect()) == [0, 1]


def test_dedup_and_top_keep_order(spark):
    hits = _hits(spark, [(1, 0, "https://A.com/x/", 1.0), (1, 1, "https://a.com/X", 9.0),
                         (1, 2, "https://b.com", 5.0), (1, 3, "https://c.com", 5.0)])
    top = Q.top_hits(Q.dedup_hits(hits), 2).orderBy("position").collect()
    assert [(r["position"], r["src_pos"]) for r in top] == [(1, 2), (2, 3)]


def test_top_hits_prunes_before_the_shuffle(spark):
    hits = _hits(spark, [(1, 0, "u", 1.0)])
    plan = Q.top_hits(hits, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_store_rules(spark):
    now = dt.datetime(2024, 1, 1, 12)

    def row(key, minutes, value):
        at = now - dt.timedelta(minutes=minutes)
        return (key, "u", "markdown", True, value, at, at)

    schema = ("cache_key string, url string, formats string, omc boolean, value string, "
              "ts timestamp, last_access timestamp")
    store = spark.createDataFrame([row("a", 60, "1"), row("b", 61, "2"), row("c", 5, "3")], schema)
    fresh = ST.fresh_entries(store, F.lit(now), 3_600_000)
    assert sorted(r["cache_key"] for r in fresh.collect()) == ["a", "c"]
    merged = ST.upsert_store(store, spark.createDataFrame([row("a", 60, "9")], schema))
    assert {r["cache_key"]: r["value"] for r in merged.collect()} == {"a": "9", "b": "2", "c": "3"}
    assert sorted(r["cache_key"] for r in ST.retain(store, 2).collect()) == ["a", "c"]


def test_retention_is_one_order_with_missing_times_last(spark):
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [
        (f"{rng.getrandbits(96):024x}",
         rng.choice([None, *[base + dt.timedelta(seconds=s) for s in (0, 0, 1, 4000, 9000)]]))
        for _ in range(400)
    ]
    store = spark.createDataFrame(rows, "cache_key string, last_access timestamp")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or base).timestamp(), r[0]))
    for n in (0, 1, 57, 350, 399, 400, 500):
        assert {r["cache_key"] for r in ST.retain(store, n).collect()} == {r[0] for r in order[:n]}


def test_limit_column_is_not_capped(spark):
    hits = spark.range(60).selectExpr("1L AS query_id", "CAST(id AS INT) AS src_pos", "1.0D AS score")
    assert Q.top_hits(hits, F.lit(50)).count() == 50


def test_limit_spellings(ask):
    raw = ["5d", "5f", "0x10", "0b11", "1e1", " 7 ", "NaN", "Infinity", "1_0"]
    assert ask(Q.coerce_limit, raw) == [10, 10, 16, 3, 10, 7, 10, 10, 10]


def test_blocked_results_are_not_extracted(spark):
    web = spark.createDataFrame(
        [(1, 1, u, "t", "d", "web") for u in ("http://10.0.0.1/x", "https://ok.com/", "", None)],
        "query_id long, position int, url string, title string, description string, category string",
    )
    pages = spark.createDataFrame(
        [(1, "http://10.0.0.1/x", "<p>secret text</p>"), (2, "https://ok.com/", "<p>open text</p>")],
        "page_id long, url string, html string",
    )
    got = {r["url"]: r["markdown"] for r in Q.search_and_extract(web, pages).collect()}
    assert got["http://10.0.0.1/x"] is None and "open text" in got["https://ok.com/"] and len(got) == 4


def _brute(rows, ttl, seed=None):
    last, misses = dict(seed or {}), set()
    for rid, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or ts - last[key] > ttl:
            misses.add(rid)
            last[key] = ts
    return misses


def test_ttl_against_plain_loop(spark):
    rng = random.Random(7)
    # key 0 owns most rows and is cut into chunks; others are folded
    rows = [(i, 0 if i % 3 else rng.randrange(1, 9), rng.randrange(0, 40_000)) for i in range(3000)]
    log = spark.createDataFrame(rows, "request_id long, cache_key int, ts_ms long")
    for ttl, limits in ((1, (1000,)), (50, (100_000,)), (999, (10, 100_000)), (30_000, (10,))):
        for limit in limits:
            got = L.ttl_hits(log, ttl, max_group=limit).where("is_miss").collect()
            assert {r["request_id"] for r in got} == _brute(rows, ttl), (ttl, limit)


def test_ttl_runs_continue(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(0, 5000)) for i in range(600)]
    log = spark.createDataFrame(rows, "request_id long, cache_key int, ts_ms long")
    first, state = SS.ttl_step(log.where("ts_ms < 2000"), None, 300)
    second, _ = SS.ttl_step(log.where("ts_ms >= 2000"), state, 300)
    got = first.unionByName(second).where("is_miss").collect()
    assert {r["request_id"] for r in got} == _brute(rows, 300)


def test_outcomes_are_rows(spark):
    requests = spark.createDataFrame(
        [(1, None), (2, "http://10.0.0.1/"), (3, "http://a.com/x"), (4, "http://a.com/y")],
        "request_id int, url string")
    failures = spark.createDataFrame([("http://a.com/y", "boom")], "url string, detail string")
    got = {r["request_id"]: (r["code"], r["error"], r["detail"])
           for r in B.scrape_outcome(requests, failures).collect()}
    assert got[1] == (400, "Missing URL in request body.", None)
    assert got[2] == (422, "blocked_url", "blocked_private_ip")
    assert got[3] == (200, None, None)
    assert got[4] == (500, "extraction_failed", "boom")


def test_batch_extracts_only_misses(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 12))
    pages = spark.createDataFrame(
        [(1, "http://a.com/1", "<p>one</p>"), (2, "http://a.com/2", "<p>two</p>")],
        "page_id long, url string, html string")
    requests = spark.createDataFrame(
        [(1, "http://a.com/1"), (2, "http://a.com/2"), (3, "http://a.com/2"), (4, "http://a.com/9")],
        "request_id int, url string")
    stored = pages.where("page_id = 1").select(
        U.extraction_key(F.col("url"), F.array(F.lit("markdown")), F.lit(True)).alias("cache_key"),
        "url", F.lit("stored").alias("value"), now.alias("ts"))
    answers, new = B.extract_batch(requests, pages, stored, now, 1000)
    got = {r["request_id"]: r["source"] for r in answers.collect()}
    assert got == {1: "store", 2: "extracted", 3: "extracted", 4: "missing"}
    assert [r["url"] for r in new.collect()] == ["http://a.com/2"]
