"""Structured Streaming forms of the page and request operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.functions import policy as R
from pageframe.operators import metadata as D
from pageframe.operators import tokens as TK
from pageframe.operators import ttl as L
from pageframe.sources import shared


def stream_pages(pages: DataFrame) -> DataFrame:
    """In-row extraction of arriving pages: policy, route, metadata, links.

    Needs no state and no shuffle, so it runs in append mode on any trigger.
    Full Markdown comes from the landed files, each once (``ledger.extract_arrivals``).
    """
    allowed = R.url_policy(pages).where(F.col("ok"))
    if "content_type" in pages.columns:  # pages stored without one were HTML answers
        allowed = allowed.where(~TK.is_unsupported_type(F.col("content_type")))
        kind = F.coalesce("content_type", F.lit("text/html"))
    else:
        kind = F.lit("text/html")
    staged = D.with_metadata(TK.with_lexemes(allowed))
    return staged.select(
        "page_id",
        "url",
        TK.extract_route(kind, F.col("html")).alias("route"),
        "metadata",
        D.page_links(F.col("_lex"), F.col("_base")).alias("links"),
    )


def stream_policy(requests: DataFrame, engines: DataFrame | None = None) -> DataFrame:
    """Arriving requests with their verdict; ``engines`` is a static side."""
    judged = R.url_policy(requests)
    if engines is not None:
        judged = judged.join(engines.select(F.col("name").alias("engine")), "engine", "left_semi")
    return judged


def stream_arrival_dedup(requests: DataFrame, key: str, ts: str, width: str, delay: str) -> DataFrame:
    """One arrival of each key per tumbling ``window`` (not a TTL rule).

    Which keys and windows come out does not depend on how batches are cut; state of a window
    goes once the watermark has passed it.
    """
    timed = requests.withWatermark(ts, delay).withColumn("window", F.window(ts, width))
    return timed.drop(ts).dropDuplicates([key, "window"])  # the window carries the event time on


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what has arrived, into Parquet on shared storage."""
    spark = stream.sparkSession
    out = shared.fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", shared.fresh_path(spark, name + "-state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ttl_step(
    batch: DataFrame,
    state: DataFrame | None,
    ttl_ms: int,
    key: str = "cache_key",
    ts: str = "ts_ms",
    order: str = "request_id",
) -> tuple[DataFrame, DataFrame]:
    """One incremental run of the TTL rule: ``(flagged rows, next state)``.

    The state of a version is read, never changed; writing the next state to a
    new path makes a repeated run give the same result.
    """
    flagged = L.ttl_hits(batch, ttl_ms, key, ts, order, seed=state)
    misses = flagged.where(F.col("is_miss")).select(key, ts)
    return flagged, L.last_sets(misses, state, key, ts)
