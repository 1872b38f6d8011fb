"""Search hits: filter, de-duplicate, rank, and join with page content.

Everything is per ``query_id``.  De-duplication aggregates before the shuffle
and top-k prunes before it, so one query may own most of the hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import policy as R
from pageframe.functions import urls as U
from pageframe.operators.joins import left_join_spread
from pageframe.plans import pages as P
from pageframe.operators.corpus_index import CorpusIndex, build_index, search
from pageframe.sources import shared

HIT_COLUMNS = (
    "query_id", "src_pos", "title", "url", "snippet", "engines", "score",
    "publishedDate", "category",
)


def validate_query(query: Column) -> Column:
    """400 when missing, 500 when blank, else 200."""
    blank = F.regexp_replace(query, r"[\s\x{a0}]+", "") == ""
    return (
        F.when(query.isNull() | (query == ""), 400).when(blank, 500).otherwise(200).cast("int")
    )


def coerce_limit(raw: Column) -> Column:
    """A positive number gives ``min(floor(x), 20)``, anything else 10.

    Numbers are decimal, with or without an exponent, or hexadecimal, octal or binary with a
    prefix; no other spelling counts.
    """
    text = F.trim(raw)
    number = F.when(
        text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double")
    )
    for prefix, digits, base in (("xX", "0-9a-fA-F", 16), ("oO", "0-7", 8), ("bB", "01", 2)):
        spelled = text.rlike(f"^0[{prefix}][{digits}]{{1,15}}$")
        number = number.when(spelled, F.conv(F.substring(text, 3, 20), base, 10).try_cast("double"))
    usable = (number > 0) & (number < float("inf"))
    return F.when(usable, F.least(F.floor(number), F.lit(K.MAX_LIMIT))).otherwise(
        K.DEFAULT_LIMIT
    ).cast("int")


def requested_engines(sources: Column) -> Column:
    return F.coalesce(
        F.filter(sources, lambda s: s != "web"), F.array().cast("array<string>")
    )


def effective_query(query: Column, domains: Column) -> Column:
    sites = F.array_join(F.transform(domains, lambda d: F.concat(F.lit("site:"), d)), " OR ")
    return F.when(
        F.coalesce(F.size(domains), F.lit(0)) > 0,
        F.concat(query, F.lit(" ("), sites, F.lit(")")),
    ).otherwise(query)


def _matching_hosts(hits: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct hit hosts that equal a domain or end with ``.domain``.

    Each host is expanded to its suffixes, so the test is an equi-join whatever
    the length of the domain list; no host is tested against every domain.
    """
    hosts = hits.select(U.url_host(F.col("url")).alias("_host")).where(
        F.col("_host").isNotNull()
    ).distinct()
    suffixes = hosts.select("_host", F.explode(U.host_suffixes(F.col("_host"))).alias("_suffix"))
    wanted = domains.select(F.lower("domain").alias("_suffix")).distinct()
    return suffixes.join(wanted, "_suffix", "left_semi").select("_host").distinct()


def include_domains(hits: DataFrame, domains: DataFrame) -> DataFrame:
    return (
        hits.withColumn("_host", U.url_host(F.col("url")))
        .join(_matching_hosts(hits, domains), "_host", "left_semi")
        .drop("_host")
    )


def exclude_domains(hits: DataFrame, domains: DataFrame) -> DataFrame:
    """Drop hits of the domains; hits whose URL does not parse stay.

    Those get a key of their own ("!" is in no host), so they do not all meet in one task.
    """
    host, own = U.url_host(F.col("url")), F.pmod(F.xxhash64("query_id", "src_pos", "url"), F.lit(1024))
    return (
        hits.withColumn("_host", F.coalesce(host, F.concat(F.lit("!"), own.cast("string"))))
        .join(_matching_hosts(hits, domains), "_host", "left_anti")
        .drop("_host")
    )


def engine_filter(hits: DataFrame, engines: DataFrame) -> DataFrame:
    """Hits that at least one of the engines returned."""
    wanted = engines.agg(F.collect_set("name").alias("_names")).withColumn("_one", F.lit(1))
    joined = hits.withColumn("_one", F.lit(1)).join(F.broadcast(wanted), "_one")  # one row of settings
    return joined.where(F.arrays_overlap("engines", "_names")).select(*hits.columns)


def hit_filter(
    hits: DataFrame,
    engines: Sequence[str] = (),
    categories: Sequence[str] = (),
    since: str | None = None,
    until: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Backend parameters as filters on the hit table."""
    if engines:
        hits = hits.where(F.arrays_overlap("engines", F.array(*[F.lit(e) for e in engines])))
    if categories:
        hits = hits.where(F.col("category").isin(list(categories)))
    if since:
        hits = hits.where(F.col("publishedDate") >= since)
    if until:
        hits = hits.where(F.col("publishedDate") <= until)
    if language:
        hits = hits.where(F.lower("language") == language.lower())
    return hits


def hit_page(hits: DataFrame, page: int, page_size: int) -> DataFrame:
    """One result page per query; ranks beyond it are pruned before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("src_pos"))
    ranked = hits.withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= page * page_size).where(
        F.col("_rank") > (page - 1) * page_size
    ).drop("_rank")


def normalize_hits(hits: DataFrame) -> DataFrame:
    """Fill the defaults of a raw hit."""

    def text(column: str, default: str = "") -> Column:
        return F.when(F.col(column) != "", F.col(column)).otherwise(default)

    single = F.filter(F.array("engine"), lambda e: e.isNotNull() & (e != ""))
    return hits.select(
        "query_id",
        "src_pos",
        text("title").alias("title"),
        text("url").alias("url"),
        text("content").alias("snippet"),
        F.coalesce("engines", single).alias("engines"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("publishedDate") != "", F.col("publishedDate")).alias("publishedDate"),
        text("category", "general").alias("category"),
    )


def dedup_hits(hits: DataFrame) -> DataFrame:
    """First hit per query and URL key.

    Aggregated with a partial step, so copies of one URL collapse before the
    shuffle.
    """
    rest = [c for c in hits.columns if c not in ("query_id", "src_pos")]
    return (
        hits.groupBy("query_id", U.url_dedup_key(F.col("url")).alias("_key"))
        .agg(F.min_by(F.struct("src_pos", *rest), "src_pos").alias("_h"))
        .select("query_id", "_h.*")
    )


def top_hits(hits: DataFrame, n: int | Column = K.DEFAULT_LIMIT) -> DataFrame:
    """Best ``n`` hits per query by score, ties in answer order; adds ``position``.

    ``n`` may be a column.  A number also prunes before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("src_pos"))
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def search_meta(top: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: reported or counted results and the list fields.

    ``queries`` holds query_id, query, effective_query and the envelope columns.
    """
    counted = top.groupBy("query_id").agg(F.count("*").alias("_n"))

    def listed(column: str) -> Column:
        return F.coalesce(F.col(column), F.array().cast(queries.schema[column].dataType))

    return queries.join(counted, "query_id", "left").select(
        "query_id",
        "query",
        "effective_query",
        F.coalesce("number_of_results", "_n", F.lit(0)).cast("bigint").alias("total_results"),
        listed("suggestions").alias("suggestions"),
        listed("answers").alias("answers"),
        listed("unresponsive_engines").alias("unresponsive_engines"),
    )


def web_results(top: DataFrame) -> DataFrame:
    """Final shape of ranked hits; the category is always ``web``."""
    return top.select(
        "query_id",
        F.col("position").cast("int").alias("position"),
        "url",
        "title",
        F.col("snippet").alias("description"),
        F.lit("web").alias("category"),
    )


def search_and_extract(
    web: DataFrame,
    pages: DataFrame,
    formats: Sequence[str] = ("markdown",),
    only_main: bool = True,
    dns: DataFrame | None = None,
) -> DataFrame:
    """Web results with the content of their pages.

    The slice comes first: only pages that a result names and the URL policy allows are
    extracted, once per URL.  Other results stay as they are.  No formats, no join.
    """
    if not formats:
        return web
    judged = R.url_policy(web, "url", dns)
    asked = judged.withColumn("_asked", F.when(F.col("ok") & (F.col("url") != ""), F.col("url")))
    asked = shared.cut_lineage(asked.select(*web.columns, "_asked"))
    # pages that nobody asked for go in the scan; then one page per URL, chosen on the narrow columns
    known = shared.only_keys(pages.select("url", "page_id"), asked, "url", "_asked")
    chosen = shared.cut_lineage(known.groupBy("url").agg(F.min("page_id").alias("page_id")))
    located = left_join_spread(asked, chosen.withColumnRenamed("url", "_asked"), "_asked").select(*web.columns, "page_id")
    extracted = P.extract_pages(shared.only_keys(pages, chosen, "page_id"), formats, only_main)

    def filled(column: str) -> Column:
        value = F.col(column)
        return (value if column == "links" else F.when(value != "", value)).alias(column)

    wanted = ["markdown", *[f for f in ("html", "rawHtml", "links") if f in formats]]
    joined = left_join_spread(located, extracted.select("page_id", *wanted), "page_id")
    return joined.select(
        *web.columns, *[filled(c) for c in wanted]
    )


def corpus_hits(
    docs: DataFrame, queries: DataFrame, k: int = 10, snippet_chars: int = 160, index: CorpusIndex | None = None
) -> DataFrame:
    """The ``k`` best documents per query, by the number of matching words (ties by id).

    ``docs``: doc_id, text; ``queries``: query_id, query.  Without an ``index`` of the documents one
    is built first.  Texts are read again for the survivors only.
    """
    top = shared.cut_lineage(search(index or build_index(docs), queries, k))
    texts = shared.only_keys(docs, top, "doc_id")
    return top.join(
        texts.select("doc_id", F.substring("text", 1, snippet_chars).alias("snippet")), "doc_id"
    ).select("query_id", "doc_id", "score", "snippet")


def context_pack(results: DataFrame, style: str = "bold") -> DataFrame:
    """``(query_id, context)``: the results of a query as one prompt text."""
    body = F.coalesce("markdown", "description", F.lit(""))
    entry, sep = {
        "bold": (
            F.concat(F.lit("**"), "title", F.lit("** ("), "url", F.lit(")\n\n"), body),
            "\n\n---\n\n",
        ),
        "plain": (F.concat("title", F.lit("\n"), body), "\n\n"),
        "heading": (
            F.concat(F.lit("# "), "title", F.lit("\n"), "url", F.lit("\n\n"), body),
            "\n\n---\n\n",
        ),
    }[style]
    # at most 20 results per query (see top_hits), so the group is small
    ordered = F.array_sort(F.collect_list(F.struct("position", entry.alias("entry"))))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["entry"]), sep).alias("context")
    )
