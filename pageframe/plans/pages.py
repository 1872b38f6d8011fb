"""The page plan: stored pages in, Markdown and metadata out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.operators import main_content as C
from pageframe.operators import markdown as M
from pageframe.operators import metadata as D
from pageframe.operators import sanitize as S
from pageframe.operators import tokens as TK

ALL_FORMATS = ("markdown", "html", "rawHtml", "links")


def extract_pages(
    pages: DataFrame,
    formats: Sequence[str] = ("markdown",),
    only_main: bool = True,
    max_length: int = 0,
    consent: bool = False,
) -> DataFrame:
    """``(page_id, url, markdown, [html], [rawHtml], [links], metadata)``.

    One scan and one exchange: metadata, links and the raw page ride on a single
    extra token row per page, so nothing is joined back.  Outputs that are not
    requested are not computed.  PDF answers give no row; see
    ``extraction_errors``.
    """
    source = pages
    if "content_type" in pages.columns:
        source = source.where(~TK.is_unsupported_type(F.col("content_type")))
    staged = D.with_metadata(TK.with_lexemes(TK.by_page(source)))
    carried = [F.col("url"), F.col("metadata")]
    if "rawHtml" in formats:
        carried.append(F.col("html").alias("rawHtml"))
    if "links" in formats:
        carried.append(D.page_links(F.col("_lex"), F.col("_base")).alias("links"))
    tokens = TK.cut_tokens(staged, F.struct(*carried))
    clean = S.sanitized_tokens(tokens, consent)
    runs = M.text_runs(M.annotate(clean, with_html="html" in formats))
    body = C.select_body(C.mark_main(runs)) if only_main else runs
    done = M.join_blocks(M.markdown_blocks(body), max_length)
    page, meta = F.col("page"), F.col("page.metadata")
    excerpt = F.coalesce(F.when(meta["description"] != "", meta["description"]), "excerpt", F.lit(""))
    return done.select(
        "page_id",
        page["url"].alias("url"),
        "markdown",
        *(["html"] if "html" in formats else []),
        *[page[f].alias(f) for f in ("rawHtml", "links") if f in formats],
        meta.withField("description", excerpt).alias("metadata"),
    )


def extraction_errors(pages: DataFrame) -> DataFrame:
    """Pages whose answer cannot be extracted, with the reason."""
    return pages.where(TK.is_unsupported_type(F.col("content_type"))).select(
        "page_id", "url", F.lit("Unsupported content-type: application/pdf").alias("detail")
    )


def select_formats(extracted: DataFrame, formats: Sequence[str] | Column) -> DataFrame:
    """Markdown and metadata always; the other outputs only when requested.

    A constant list prunes columns; a column of lists blanks them per row.
    """
    optional = [f for f in ("html", "rawHtml", "links") if f in extracted.columns]
    if isinstance(formats, Column):
        return extracted.withColumns(
            {f: F.when(F.array_contains(formats, f), F.col(f)) for f in optional}
        )
    return extracted.drop(*[f for f in optional if f not in formats])
