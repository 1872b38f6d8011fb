"""HTML as a relation: one row per tag or text run.

``page_id`` must be unique per row of the page table; it is the partition key
of every later step.  The page is shuffled *once, as one row*, before it is cut
into tokens: ``Generate`` keeps the partitioning of its child, so every window
and group below runs without a further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import text as T
from pageframe.functions import tree as R
from pageframe.functions import urls as U



def add(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns given as SQL text."""
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def running(*keys: str, order: str = "pos") -> WindowSpec:
    """Rows of a group up to the current one."""
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def same_level() -> WindowSpec:
    """Tags of one name at one nesting level: open and close are neighbours."""
    return Window.partitionBy("page_id", "tag", "lvl").orderBy("pos")


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle width, given by number: pages are small in bytes
    but costly to cut, so adaptive execution must not merge these partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_page(pages: DataFrame) -> DataFrame:
    """The one exchange of a page job: whole pages, dealt by ``page_id``."""
    return pages.repartition(shuffle_partitions(pages), "page_id")


def with_lexemes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the lexemes and the base of every page, once for all that reads them."""
    return pages.withColumns({"_lex": R.lexemes(F.col(html)), "_base": U.base_parts(F.col("url"))})


def page_tokens(
    pages: DataFrame, html: str = "html", carry: Column | None = None
) -> DataFrame:
    """``(page_id, pos, kind, tag, is_close, is_void, base, tok)`` of the repaired page: every
    element that is no void one has its close tag, and elements nest.

    ``carry`` is a per-page value that rides on one extra row of kind ``page``
    (``pos`` -1), so page-level columns need no join back at the end.
    """
    return cut_tokens(with_lexemes(by_page(pages), html), carry)


def cut_tokens(staged: DataFrame, carry: Column | None = None) -> DataFrame:
    """Tokens of rows from :func:`with_lexemes` that are dealt by ``page_id``."""
    tokens, kept = R.repaired(F.col("_lex")), ["page_id", "_base"]
    if carry is not None:
        page = F.expr(f"CAST(struct('', NULL, false, 0) AS {R.LEXEME_TYPE})")
        tokens = F.concat(F.array(page), tokens)
        staged = staged.withColumn("page", carry)
        kept.append("page")
    cut = staged.select(*kept, F.posexplode(tokens).alias("_at", "x"))
    tok, tag, is_close = F.col("x.t"), F.col("x.n"), F.col("x.c")
    pos = F.col("_at") - 1 if carry is not None else F.col("_at")
    named = cut.select(
        "page_id",
        pos.alias("pos"),
        F.when(tag.isNotNull(), "tag")
        .when(tok == "", "page")
        .when(tok.rlike("^<[!?/]"), "decl")
        .otherwise("text")
        .alias("kind"),
        tag.alias("tag"),
        is_close.alias("is_close"),
        F.coalesce(tag.isin(K.VOID_TAGS), F.lit(False)).alias("is_void"),
        F.when((tag == "a") & ~is_close, F.col("_base")).alias("base"),
        tok.alias("tok"),
        *([F.when(tok == "", F.col("page")).alias("page")] if carry is not None else []),
    )
    return named


def is_open_tag() -> Column:
    return (F.col("kind") == "tag") & ~F.col("is_close")


def pair_elements(tokens: DataFrame) -> DataFrame:
    """Add ``lvl``, ``end_pos`` (open tag) and ``start_pos`` (close tag).

    Nesting level per tag is a running sum; the partner is the neighbour at the
    same level.  Void tags end where they start.
    """
    step = F.when(
        (F.col("kind") != "tag") | F.col("is_void"), F.lit(0)
    ).otherwise(F.when(F.col("is_close"), F.lit(-1)).otherwise(F.lit(1)))
    run = F.sum(step).over(running("page_id", "tag"))
    levelled = tokens.withColumn(
        "lvl", F.when(F.col("is_close"), run + 1).otherwise(run)
    )
    level = same_level()
    body = (F.col("kind") == "tag") & ~F.col("is_void")
    next_close = F.lead("is_close").over(level)
    prev_close = F.lag("is_close").over(level)
    return levelled.withColumns(
        {
            "end_pos": F.when(is_open_tag() & F.col("is_void"), F.col("pos")).when(
                body & ~F.col("is_close") & next_close, F.lead("pos").over(level)
            ),
            "start_pos": F.when(
                body & F.col("is_close") & (prev_close == F.lit(False)),
                F.lag("pos").over(level),
            ),
        }
    )


def has_main_container(tokens: DataFrame) -> DataFrame:
    """``(page_id, has_main)``: does the page name its main content?"""
    tok = F.col("tok")
    names = "|".join(K.MAIN_CLASSES)
    match = is_open_tag() & (
        F.col("tag").isin(K.MAIN_TAGS)
        | (
            tok.contains("=")
            & (
                T.attr_raw(tok, "class").rlike(f"""(^|["' \\t\\r\\n\\f])({names})($|["' \\t\\r\\n\\f])""")
                | T.attr_raw(tok, "role").rlike("""^["']?main["']?$""")
                | T.attr_raw(tok, "id").rlike(f"""^["']?{K.MAIN_ID}["']?$""")
            )
        )
    )
    return tokens.groupBy("page_id").agg(
        F.bool_or(F.coalesce(match, F.lit(False))).alias("has_main")
    )


def extract_route(content_type: Column, html: Column) -> Column:
    """``fast`` for a long enough HTML answer, else ``render``."""
    fast = F.coalesce(content_type, F.lit("")).contains(K.HTML_TYPE) & (
        F.length(html) >= K.FAST_MIN_CHARS
    )
    return F.when(fast, "fast").otherwise("render")


def is_unsupported_type(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(K.PDF_TYPE), F.lit(False))
