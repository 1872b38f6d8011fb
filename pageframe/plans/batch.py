"""Request plans: outcomes per request, and extract-with-store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions import policy as R
from pageframe.functions import urls as U
from pageframe.operators import store as ST
from pageframe.operators.joins import left_join_spread
from pageframe.plans import pages as P
from pageframe.sources import shared


def scrape_outcome(requests: DataFrame, failures: DataFrame | None = None,
                   dns: DataFrame | None = None) -> DataFrame:
    """Code, error and detail of every request; errors are rows.

    ``failures`` holds ``(url, detail)`` of extractions that failed.
    """
    judged = R.url_policy(requests, "url", dns)
    if failures is not None:
        per_url = failures.groupBy("url").agg(F.min("detail").alias("_failure"))
        judged = judged.join(per_url, "url", "left")
    else:
        judged = judged.withColumn("_failure", F.lit(None).cast("string"))
    missing = F.col("url").isNull() | (F.col("url") == "")
    # the policy lets only http(s) through, so the prefix gate cannot fail alone
    return judged.select(
        *requests.columns,
        F.when(missing, 400)
        .when(~F.col("ok"), 422)
        .when(F.col("_failure").isNotNull(), 500)
        .otherwise(200)
        .cast("int")
        .alias("code"),
        F.when(missing, "Missing URL in request body.")
        .when(~F.col("ok"), "blocked_url")
        .when(F.col("_failure").isNotNull(), "extraction_failed")
        .alias("error"),
        F.when(~missing, F.coalesce("reason", "_failure")).alias("detail"),
    )


def extract_batch(
    requests: DataFrame,
    pages: DataFrame,
    store: DataFrame,
    now: Column,
    ttl_ms: int,
    formats: tuple[str, ...] = ("markdown",),
    only_main: bool = True,
    dns: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(answers, new store rows)`` for a batch of requests.

    Policy first, then the store; only misses with a page are extracted, once
    per URL.  ``answers`` adds ``source`` (``blocked``, ``store``, ``extracted``
    or ``missing``) and ``value`` to every request.
    """
    names = F.array(*[F.lit(f) for f in formats])
    judged = R.url_policy(requests, "url", dns).withColumn(
        "cache_key",
        F.when(F.col("ok"), U.extraction_key(F.col("url"), names, F.lit(only_main))),
    )
    judged = shared.cut_lineage(judged.select(*requests.columns, "ok", "reason", "cache_key"))
    fresh = ST.latest_per_key(
        ST.fresh_entries(store, now, ttl_ms), "cache_key", F.col("ts").desc()
    ).select("cache_key", F.col("value").alias("_stored"))
    misses = (
        judged.where(F.col("ok"))
        .select("url", "cache_key")
        .distinct()
        .join(fresh.select("cache_key"), "cache_key", "left_anti")
    )
    # pages that no miss names go in the scan; then one page per URL
    known = shared.only_keys(pages.select("url", "page_id"), misses, "url")
    chosen = known.groupBy("url").agg(F.min("page_id").alias("page_id"))
    extracted = P.extract_pages(shared.only_keys(pages, chosen, "page_id"), formats, only_main)
    new_rows = ST.store_rows(extracted, list(formats), only_main, now)
    made = new_rows.select("cache_key", F.col("value").alias("_made"))
    answers = (
        left_join_spread(left_join_spread(judged, fresh, "cache_key"), made, "cache_key")
        .select(
            *requests.columns,
            "reason",
            F.when(~F.col("ok"), "blocked")
            .when(F.col("_stored").isNotNull(), "store")
            .when(F.col("_made").isNotNull(), "extracted")
            .otherwise("missing")
            .alias("source"),
            F.coalesce("_stored", "_made").alias("value"),
        )
    )
    return answers, new_rows
