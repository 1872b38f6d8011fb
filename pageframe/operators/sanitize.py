"""Subtree removal, figure captions, unwrapping and attribute stripping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import text as T
from pageframe.functions import urls as U
from pageframe.operators.tokens import is_open_tag, pair_elements, running, same_level


def _value_has(name: str, parts: list[str]) -> Column:
    """Does the attribute value contain one of ``parts``?"""
    return T.attr_raw(F.col("tok"), name).rlike("|".join(re.escape(p) for p in parts))


def boilerplate_match() -> Column:
    """Open tags that a removal selector names."""
    tok = F.col("tok")
    roles = "|".join(K.BOILERPLATE_ROLES)
    by_attr = (
        (tok.rlike("(?i)aria-live") & T.has_attr(tok, "aria-live"))
        | (tok.contains("=") & T.attr_raw(tok, "role").rlike(f"""^["']?({roles})["']?$"""))
        | (tok.contains("=") & _value_has("class", K.BOILERPLATE_CLASS_PARTS))
        | (tok.contains("=") & _value_has("id", K.BOILERPLATE_ID_PARTS))
    )
    return is_open_tag() & (F.col("tag").isin(K.BOILERPLATE_TAGS) | by_attr)


def consent_match() -> Column:
    """Open tags of cookie and consent banners."""
    by_attr = _value_has("class", K.CONSENT_CLASS_PARTS) | _value_has("id", K.CONSENT_ID_PARTS)
    return is_open_tag() & F.col("tok").contains("=") & by_attr


def _drop_subtrees(paired: DataFrame, match: Column) -> DataFrame:
    """Remove every token inside a matching element.

    +1 at a matching open tag and -1 at its own close tag, summed along the page.
    """
    marked = paired.withColumn("_hit", F.coalesce(match, F.lit(False)))
    marked = marked.withColumn(
        "_closes_hit",
        F.col("start_pos").isNotNull() & F.coalesce(F.lag("_hit").over(same_level()), F.lit(False)),
    )
    delta = F.when(F.col("_hit") & ~F.col("is_void"), 1).when(F.col("_closes_hit"), -1).otherwise(0)
    inside = marked.withColumn("_depth", F.sum(delta).over(running("page_id")))
    gone = (F.col("_depth") > 0) | F.col("_closes_hit") | (F.col("_hit") & F.col("is_void"))
    kept = (F.col("kind") == "page") | ((F.col("kind") != "decl") & ~gone)
    return inside.where(kept).drop("_hit", "_closes_hit", "_depth")


def drop_boilerplate(paired: DataFrame, consent: bool = False) -> DataFrame:
    """Remove navigation, forms, media and advertising subtrees (and consent
    banners when asked); input comes from ``pair_elements``."""
    match = boilerplate_match() | consent_match() if consent else boilerplate_match()
    return _drop_subtrees(paired, match)


def drop_consent(paired: DataFrame) -> DataFrame:
    return _drop_subtrees(paired, consent_match())


def figures_to_captions(tokens: DataFrame) -> DataFrame:
    """A figure becomes a paragraph of its first caption, or disappears."""
    matched = F.col("end_pos").isNotNull() | F.col("start_pos").isNotNull()
    fig = (F.col("tag") == "figure") & matched
    cap = (F.col("tag") == "figcaption") & matched
    along = running("page_id")
    opened = is_open_tag()
    step = F.when(F.col("is_close"), F.lit(-1)).otherwise(F.lit(1))
    counted = tokens.withColumns(
        {
            "_fig": F.sum(F.when(fig, step).otherwise(0)).over(along),
            "_cap": F.sum(F.when(cap, step).otherwise(0)).over(along),
            "_caps": F.sum(F.when(cap & opened, 1).otherwise(0)).over(along),
        }
    )
    # captions seen when the outermost open figure began
    counted = counted.withColumn(
        "_before",
        F.max(F.when(fig & opened & (F.col("_fig") == 1), F.col("_caps"))).over(along),
    )
    first = F.col("_caps") == F.col("_before") + 1
    is_fig = F.coalesce(fig, F.lit(False))
    is_cap = F.coalesce(cap, F.lit(False))
    in_figure = (F.col("_fig") > 0) | is_fig
    in_caption = ((F.col("_cap") > 0) | is_cap) & F.coalesce(first, F.lit(False))
    kept = counted.where(
        (F.col("kind") == "page") | (~is_fig & (~in_figure | in_caption))
    )
    caption_tag = is_cap & in_figure
    return kept.withColumns(
        {
            "tok": F.when(caption_tag & F.col("is_close"), "</p>")
            .when(caption_tag, "<p>")
            .otherwise(F.col("tok")),
            "tag": F.when(caption_tag, "p").otherwise(F.col("tag")),
        }
    ).drop("_fig", "_cap", "_caps", "_before")


def unwrap_disallowed(tokens: DataFrame) -> DataFrame:
    """Delete tag rows outside the allow-list; their content stays."""
    return tokens.where((F.col("kind") != "tag") | F.col("tag").isin(K.ALLOWED_TAGS))


def link_target() -> Column:
    """Absolute href of an ``<a>`` open tag; the raw text when it does not
    resolve, ``''`` when there is none."""
    anchor = is_open_tag() & (F.col("tag") == "a") & F.col("tok").contains("=")
    target = U.bind(
        T.attr_sql("v.t", "href"),
        "hv",
        f"CASE WHEN hv <> '' THEN coalesce({U.resolve_sql('hv', 'v.b')}, hv) ELSE '' END",
    )
    pair = F.struct(F.col("tok").alias("t"), F.col("base").alias("b"))
    return F.when(anchor, U.let(pair, target)).otherwise("")


def absolutise_hrefs(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("href", link_target())


def stripped_tag() -> Column:
    """Tag text with every attribute but the link target removed."""
    safe = F.replace(
        F.replace(F.col("href"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")
    )
    return (
        F.when(F.col("kind") != "tag", F.col("tok"))
        .when(F.col("is_close"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
        .when(
            (F.col("tag") == "a") & (F.col("href") != ""),
            F.concat(F.lit('<a href="'), safe, F.lit('">')),
        )
        .otherwise(F.concat(F.lit("<"), F.col("tag"), F.lit(">")))
    )


def strip_attrs(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("tok", stripped_tag())


def sanitized_tokens(tokens: DataFrame, consent: bool = False) -> DataFrame:
    """Absolute links, subtrees dropped, figures replaced; structure tags stay."""
    return figures_to_captions(
        drop_boilerplate(pair_elements(absolutise_hrefs(tokens)), consent)
    )


def join_tokens(column: str = "tok") -> Column:
    """Tokens of one group in page order, as one string."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", column)))
    return F.array_join(F.transform(ordered, lambda t: t[column]), "")


def sanitized_html(tokens: DataFrame) -> DataFrame:
    """``(page_id, html)`` of the whole page, in its sanitised form."""
    return (
        strip_attrs(unwrap_disallowed(sanitized_tokens(tokens)))
        .groupBy("page_id")
        .agg(join_tokens().alias("html"))
    )
