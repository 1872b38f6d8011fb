"""Page metadata and links, all within one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import text as T
from pageframe.functions import urls as U
from pageframe.operators.tokens import with_lexemes


def tags(lex: Column, name: str) -> Column:
    """Open tags of one name, as written, in page order."""
    return U.let(lex, f"transform(filter(v, x -> x.n = '{name}' AND NOT x.c), x -> x.t)")


def title_text(lex: Column) -> Column:
    """Text of the first title, with its character references; '' where there is none."""
    at = "CAST(array_position(transform(v, x -> x.n <=> 'title' AND NOT x.c), true) AS INT)"
    return U.let(lex, U.bind(at, "at", "IF(at > 0 AND get(v, at).n IS NULL, coalesce(get(v, at).t, ''), '')"))


def meta_entries(lex: Column) -> Column:
    """``array<struct<key,content>>`` of usable meta tags, in page order."""

    fields = ", ".join(f"'{a}', {T.attr_sql('tg', a)}" for a in ("name", "property", "itemprop", "content"))
    key = "CASE WHEN m.name <> '' THEN m.name WHEN m.property <> '' THEN m.property ELSE m.itemprop END"
    read = f"transform(v, tg -> named_struct({fields}))"
    keyed = f"transform({read}, m -> named_struct('key', lower({key}), 'content', m.content))"
    return U.let(tags(lex, "meta"), f"filter({keyed}, e -> e.key <> '' AND e.content <> '')")


def meta_map(entries: Column) -> Column:
    """Entries as a map; the last tag of a key wins.  Sorted by key and place, the last of a key
    stands before another key."""
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["content"].alias("content"))))
    last = "filter(v, (e, i) -> i = size(v) - 1 OR get(v, i + 1).key <> e.key)"
    return F.map_from_entries(U.let(ranked, f"transform({last}, e -> struct(e.key, e.content))"))


def _link_entries(lex: Column) -> Column:
    entry = f"named_struct('rel', lower({T.attr_sql('tg', 'rel')}), 'href', {T.attr_sql('tg', 'href')})"
    return U.let(tags(lex, "link"), f"transform(v, tg -> {entry})")


def _first_link(links: Column, rels: list[str]) -> Column:
    href = F.get(F.filter(links, lambda x: x["rel"].isin(rels)), F.lit(0))["href"]
    return F.when(href != "", href)


def page_links(lex: Column, base: Column) -> Column:
    """Absolute http(s) targets of a page, unique, in first-seen order."""
    raw = f"regexp_extract(tg, {U.lit(T.attr_pattern('href'))}, 1)"
    present = f"filter(transform(v.tags, tg -> {raw}), rw -> rw <> '')"
    target = U.bind(T.unquote_sql("rw"), "hv", U.resolve_sql("hv", "v.base"))
    resolved = f"transform({present}, rw -> {target})"
    kept = f"array_distinct(filter({resolved}, lk -> lk RLIKE '^https?:'))"
    return U.let(F.struct(tags(lex, "a").alias("tags"), base.alias("base")), kept)


def link_edges(pages: DataFrame) -> DataFrame:
    """``(page_id, link_pos, link)``: one row per unique link of a page."""
    staged = with_lexemes(pages)
    return staged.select(
        "page_id",
        F.posexplode(page_links(F.col("_lex"), F.col("_base"))).alias("link_pos", "link"),
    )


def with_metadata(staged: DataFrame) -> DataFrame:
    """Add ``metadata`` to rows from :func:`with_lexemes`."""
    lex, base = F.col("_lex"), F.col("_base")
    status = F.col("status_code") if "status_code" in staged.columns else F.lit(None).cast("int")
    read = staged.withColumns(
        {
            "_entries": meta_entries(lex),
            "_links": _link_entries(lex),
            "_title": F.trim(
                F.regexp_replace(
                    T.decode_entities(title_text(lex)), r"[ \t\r\n\f]+", " "
                )
            ),
            "_lang": T.attr_value(F.coalesce(F.get(tags(lex, "html"), F.lit(0)), F.lit("")), "lang"),
        }
    ).withColumns(
        {"_meta": meta_map(F.col("_entries")), "_icon": _first_link(F.col("_links"), K.ICON_RELS)}
    )

    def meta(key: str) -> Column:
        return F.try_element_at(F.col("_meta"), F.lit(key))

    def filled(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column))

    icon = F.col("_icon")
    metadata = F.struct(
        F.coalesce(meta("og:title"), filled("_title"), F.lit("")).alias("title"),
        F.coalesce(meta("og:description"), meta("description"), F.lit("")).alias("description"),
        F.coalesce(filled("_lang"), meta("og:locale"), F.lit("")).alias("language"),
        F.col("url").alias("sourceURL"),
        F.coalesce(F.when(status != 0, status), F.lit(200)).alias("statusCode"),
        *[meta(key).alias(name) for name, key in K.OPTIONAL_META.items()],
        _first_link(F.col("_links"), ["canonical"]).alias("canonicalURL"),
        F.when(icon.isNotNull(), F.coalesce(U.resolve_against(icon, base), icon)).alias("favicon"),
    )
    return read.withColumn("metadata", metadata).drop(
        "_entries", "_links", "_title", "_lang", "_meta", "_icon"
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """``(page_id, metadata)`` per page."""
    return with_metadata(with_lexemes(pages)).select("page_id", "metadata")
