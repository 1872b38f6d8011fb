"""Sources and sinks: pages, search answers, requests, engine settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe import schemas as S


def read_pages(spark: SparkSession, path: str, stream: bool = False,
               file_glob: str | None = None) -> DataFrame:
    """Stored pages; a missing status reads as 200 later on.

    A stream needs the schema up front: the base columns, status and content type.
    """
    if not stream:
        return spark.read.parquet(path)
    reader = spark.readStream.schema(S.ANSWERED_PAGE)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(path)


def with_status(pages: DataFrame) -> DataFrame:
    status = F.col("status_code")
    return pages.withColumn(
        "status_code", F.coalesce(F.when(status != 0, status), F.lit(200))
    )


def parse_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Search answers as structs; other columns stay."""
    return df.withColumn("_response", F.from_json(F.col(body), S.SEARCH_RESPONSE))


def read_hits(df: DataFrame, body: str = "body", key: str = "query_id") -> DataFrame:
    """One row per hit, numbered in answer order; no results gives no row."""
    results = F.col("_response.results")
    exploded = parse_responses(df, body).select(key, F.posexplode(results).alias("src_pos", "_hit"))
    return exploded.select(key, "src_pos", "_hit.*")


def read_envelopes(df: DataFrame, body: str = "body", key: str = "query_id") -> DataFrame:
    """One row per answer: reported count, suggestions, answers, silent engines."""
    r = F.col("_response")
    return parse_responses(df, body).select(
        key,
        r["number_of_results"].alias("number_of_results"),
        r["suggestions"].alias("suggestions"),
        r["answers"].alias("answers"),
        r["unresponsive_engines"].alias("unresponsive_engines"),
    )


def read_requests(df: DataFrame, kind: str = "scrape", body: str = "body") -> DataFrame:
    """Requests from JSON bodies with the service defaults filled in."""
    if kind == "scrape":
        r = F.from_json(F.col(body), S.SCRAPE_REQUEST)
        parsed = df.withColumn("_r", r)
        return parsed.select(
            *df.columns,
            F.col("_r.url").alias("url"),
            F.coalesce("_r.formats", F.array(F.lit("markdown"))).alias("formats"),
            F.coalesce("_r.onlyMainContent", F.lit(True)).alias("only_main"),
        ).drop(body)
    parsed = df.withColumn("_r", F.from_json(F.col(body), S.SEARCH_REQUEST))
    return parsed.select(
        *df.columns,
        F.col("_r.query").alias("query"),
        F.col("_r.limit").alias("limit_raw"),
        F.col("_r.sources").alias("sources"),
        F.coalesce("_r.scrapeOptions.formats", F.array().cast("array<string>")).alias("formats"),
        F.coalesce("_r.scrapeOptions.onlyMainContent", F.lit(True)).alias("only_main"),
    ).drop(body)


def engine_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        K.ENGINE_SETTINGS, "name string, disabled boolean, timeout double"
    )


def enabled_engines(settings: DataFrame) -> DataFrame:
    return settings.where(~F.col("disabled")).select("name", "timeout")


def to_response(data: Column, ok: bool = True) -> Column:
    """``{"success":true,"data":{...}}``; null fields are left out."""
    return F.to_json(F.struct(F.lit(ok).alias("success"), data.alias("data")))


def write_responses(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Answers as JSON lines, one file per task."""
    df.select("response").write.mode(mode).text(path)
