"""Markdown from the token table.

Tokens become short text pieces; pieces between two line-forming tags become a
*run*; runs that sanitising glues together become a *block*; blocks become the
page.  All three groups are keyed by ``page_id`` first, so they reuse the one
exchange of ``page_tokens``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import text as T
from pageframe.functions.urls import lit
from pageframe.operators.sanitize import stripped_tag
from pageframe.operators.tokens import add

RUN_CONTEXT = (
    "mb", "opener", "quote_depth", "quote_root", "list_depth", "list_root",
    "item_pos", "item_no", "list_tag", "in_pre", "in_pre_code",
)


def _rule_map(side: int, rules: dict[str, tuple[str, str]]) -> str:
    """Inline rules as one literal map."""
    return "map(" + ", ".join(f"{lit(t)}, {lit(r[side])}" for t, r in rules.items()) + ")"


def _in(column: str, values: list[str] | tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(lit(v) for v in values) + ")"


def _blank_to_space(text: str) -> str:
    return f"regexp_replace({text}, {lit('[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 'f]+')}, ' ')"


def annotate(
    tokens: DataFrame,
    rules: dict[str, tuple[str, str]] | None = None,
    with_html: bool = False,
) -> DataFrame:
    """Block numbers, nesting context and the text piece of every token."""
    rules = K.INLINE_RULES if rules is None else rules
    along = "OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    in_list = along.replace("page_id ", "page_id, list_depth ")
    lists = _in("tag", ("ul", "ol"))
    opened = "(kind = 'tag' AND NOT is_close)"

    def depth(*names: str) -> str:
        step = f"CASE WHEN {_in('tag', names)} AND NOT is_void THEN IF(is_close, -1, 1) ELSE 0 END"
        return f"sum({step}) {along}"

    def latest(value: str, window: str = along) -> str:
        return f"last_value({value}) IGNORE NULLS {window}"

    cell = (
        f"CASE WHEN {_in('tag', K.CELL_TAGS)} THEN {opened} "
        f"WHEN {_in('tag', ('tr', 'table', 'thead', 'tbody', 'tfoot'))} THEN false END"
    )
    row = f"CASE WHEN tag = 'tr' THEN {opened} WHEN tag = 'table' THEN false END"
    md_line = f"coalesce(kind = 'tag' AND NOT _in_cell AND {_in('tag', K.MARKDOWN_BLOCK_TAGS)}, false)"
    any_line = (
        "coalesce(kind = 'tag' AND NOT _in_cell AND "
        f"{_in('tag', K.MARKDOWN_BLOCK_TAGS + K.STRUCTURE_TAGS)}, false)"
    )
    # text is decoded once, before the first sort
    control = lit(K.CONTROL_CHARS)
    decoded = add(
        tokens,
        _raw=f"CASE WHEN kind = 'text' THEN regexp_replace({T.decode_sql('tok')}, {control}, '') END",
    )
    nested = add(
        decoded,
        _in_cell=f"coalesce({latest(cell)}, false)",
        _in_row=f"coalesce({latest(row)}, false)",
        _quote=depth("blockquote"),
        _list=depth("ul", "ol"),
        _pre=depth("pre"),
        _code=depth("code"),
    )
    context = add(
        nested,
        _line=any_line,
        _md_line=md_line,
        list_depth="greatest(_list, 0)",
        quote_depth="greatest(_quote, 0)",
        in_pre="_pre > 0",
        in_pre_code="_pre > 0 AND _code > 0",
        _plain=f"IF(_pre > 0, _raw, {_blank_to_space('_raw')})",
    )
    numbered = add(
        context,
        # a line tag owns an odd number, the content after it the next even one
        rb=f"2 * sum(CAST(_line AS INT)) {along} - CAST(_line AS INT)",
        mb=f"2 * sum(CAST(_md_line AS INT)) {along} - CAST(_md_line AS INT)",
        opener=latest("CASE WHEN _md_line THEN IF(is_close, '', tag) END"),
        quote_root=f"sum(IF(tag = 'blockquote' AND {opened} AND _quote = 1, 1, 0)) {along}",
        list_root=f"sum(IF({lists} AND {opened} AND _list = 1, 1, 0)) {along}",
        _li=f"sum(IF(tag = 'li' AND {opened}, 1, 0)) {in_list}",
        item_pos=latest(f"CASE WHEN tag = 'li' AND {opened} THEN pos END", in_list),
        # blank text between the cells of a row is layout, not content
        _between="_in_row AND NOT _in_cell AND trim(_plain) = ''",
    )
    started = latest(f"CASE WHEN {lists} AND {opened} THEN struct(_li AS li, tag) END", in_list)
    link = (
        f"CASE WHEN is_close THEN {lit(K.LINK_CLOSE)} "
        f"WHEN href <> '' THEN concat({lit(K.LINK_OPEN)}, href, {lit(K.LINK_MID)}) ELSE '' END"
    )
    marks = (
        f"coalesce(IF(is_close, try_element_at({_rule_map(1, rules)}, tag), "
        f"try_element_at({_rule_map(0, rules)}, tag)), '')"
    )
    written = add(
        numbered,
        _started=started,
        _escaped=T.escape_sql("_plain"),
    )
    piece = (
        "CASE WHEN kind = 'text' THEN CASE WHEN _between THEN '' WHEN _code > 0 THEN _plain ELSE _escaped END "
        f"WHEN kind <> 'tag' THEN '' WHEN tag = 'hr' THEN {lit(K.RULE_TEXT)} WHEN tag = 'a' THEN {link} "
        "WHEN _pre > 0 AND tag = 'code' THEN '' "
        f"WHEN _in_cell AND {_in('tag', K.MARKDOWN_BLOCK_TAGS)} THEN {lit(K.BREAK)} ELSE {marks} END"
    )
    columns = {
        "piece": piece,
        "txt_len": f"IF(kind = 'text' AND NOT _between, length(trim({_blank_to_space('_plain')})), 0)",
        "commas": "IF(kind = 'text', length(_raw) - length(replace(_raw, ',', '')), 0)",
        "item_no": "_li - _started.li",
        "list_tag": "_started.tag",
    }
    kept = [
        "page_id", "pos", "kind", "tag", "is_close", "start_pos", "end_pos", "rb", "_line", "mb",
        "opener", "quote_depth", "quote_root", "list_depth", "list_root", "item_pos", "in_pre",
        "in_pre_code", *(["page"] if "page" in tokens.columns else []),
    ]
    texts = [f"{sql} AS {name}" for name, sql in columns.items()]
    result = written.selectExpr(*kept, *texts, *(["href", "tok"] if with_html else []))
    if not with_html:
        return result
    shown = (F.col("kind") == "text") | ((F.col("kind") == "tag") & F.col("tag").isin(K.ALLOWED_TAGS))
    return result.withColumn("html_piece", F.when(shown, stripped_tag()).otherwise("")).drop("href", "tok")


def text_runs(annotated: DataFrame) -> DataFrame:
    """One row per run; a container tag is a run of its own."""

    def joined(column: str) -> Column:
        filled = F.when(F.col(column) != "", F.struct("pos", column))
        ordered = F.array_sort(F.collect_list(filled))
        return F.array_join(F.transform(ordered, lambda t: t[column]), "")

    container = F.col("_line") & F.col("tag").isin(K.CONTAINER_TAGS)
    extras = []
    if "page" in annotated.columns:
        extras.append(F.first("page", ignorenulls=True).alias("page"))
    if "html_piece" in annotated.columns:
        extras.append(joined("html_piece").alias("html"))
    return annotated.groupBy("page_id", "rb").agg(
        F.min("pos").alias("pos"),
        F.max(F.col("kind") == "page").alias("is_page"),
        joined("piece").alias("text"),
        F.sum("txt_len").alias("txt_len"),
        F.sum("commas").alias("commas"),
        F.max(
            F.when(container & F.col("end_pos").isNotNull(), 1)
            .when(container & F.col("start_pos").isNotNull(), -1)
            .otherwise(0)
        ).alias("container_up"),
        F.min(
            F.when(container & F.col("start_pos").isNotNull(), -1).otherwise(0)
        ).alias("container_down"),
        *[F.max(c).alias(c) for c in RUN_CONTEXT],
        *extras,
    )


def render_inline(text: Column) -> Column:
    """Turn the private marks of one block into Markdown."""
    t = text
    # code spans: a fence of two when the code itself holds a backtick
    t = F.regexp_replace(t, r"\x04([^\x04\x05`]*)\x05?", "`$1`")
    t = F.regexp_replace(t, r"\x04([^\x04\x05]*)\x05?", "`` $1 ``")
    t = F.replace(t, F.lit(K.CODE_CLOSE), F.lit(""))
    for opened, closed, mark in ((K.EM_OPEN, K.EM_CLOSE, "*"), (K.STRONG_OPEN, K.STRONG_CLOSE, "**")):
        # open without close ends with the block; close without open is noise;
        # blanks at the inner edges move outside
        t = F.regexp_replace(
            t, f"{opened}([^{opened}{closed}]*)(?:{closed}|$)", f"{opened}$1{closed}"
        )
        t = F.regexp_replace(t, f"{opened}([ \x03]*){closed}", "$1")
        t = F.regexp_replace(t, f"{opened}([ \x03]+)", f"$1{opened}")
        t = F.regexp_replace(t, f"([ \x03]+){closed}", f"{closed}$1")
        t = F.regexp_replace(t, f"{opened}([^{opened}{closed}]*){closed}", f"{mark}$1{mark}")
        t = F.regexp_replace(t, f"[{opened}{closed}]", "")
    t = F.regexp_replace(t, r"\x12([^\x12\x15]*)\x15([^\x12\x13]*)(?:\x13|$)", "[$2]($1)")
    return F.regexp_replace(F.regexp_replace(t, r"\x12[^\x15]*\x15|\x13", ""), "  +", " ")


def render_row(text: Column) -> Column:
    """Cells of one table row: trimmed, on one line, an empty cell is a blank."""
    t = F.regexp_replace(text, r"[\n\x03]+", " ")
    t = F.regexp_replace(t, r"\x01([^\x01\x02]*)\x02?", "\x01$1\x02")
    t = F.regexp_replace(t, r"\x01 +", "\x01")
    t = F.regexp_replace(t, r" +\x02", "\x02")
    t = F.replace(t, F.lit("\x01\x02"), F.lit("\x01 \x02"))
    return F.replace(F.replace(t, F.lit(K.CELL_OPEN), F.lit(" ")), F.lit(K.CELL_CLOSE), F.lit(" |"))


def markdown_blocks(runs: DataFrame) -> DataFrame:
    """One row per non-empty block, with its separator and line prefix."""
    has_page = "page" in runs.columns
    has_html = "html" in runs.columns
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("rb", "text")))),
            lambda r: r["text"],
        ),
        "",
    )
    context = [c for c in RUN_CONTEXT if c != "mb"]
    html = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rb", "html"))), lambda r: r["html"]), ""
    ) if has_html else None
    grouped = runs.groupBy("page_id", "mb").agg(
        joined.alias("_text"),
        F.max("is_page").alias("is_page"),
        *[F.max(c).alias(c) for c in context],
        *([html.alias("html")] if has_html else []),
        *([F.first("page", ignorenulls=True).alias("page")] if has_page else []),
    )
    flat = F.when(F.col("in_pre"), F.col("_text")).otherwise(
        F.trim(F.regexp_replace(F.regexp_replace(F.col("_text"), " +", " "), r" *\x03 *", "\x03"))
    )
    # only marks and blanks: nothing will be written (a cell mark writes a cell)
    visible = F.col("_text").rlike(r"[^ \t\r\n\f\x02-\x11\x13-\x1f]")
    wanted = F.col("is_page") | visible
    if has_html:
        wanted = wanted | (F.col("html") != "")
    shaped = grouped.where(wanted).withColumns({"_flat": flat, "_vis": visible}).withColumn(
        "_inline",
        F.when(F.col("_flat").rlike(r"[\x04\x05\x0e-\x15]"), render_inline(F.col("_flat")))
        .otherwise(F.col("_flat")),
    )
    fenced = F.concat(
        F.lit("```\n"), F.regexp_replace(F.col("_inline"), r"^\n|\n$", ""), F.lit("\n```")
    )
    lines = F.replace(F.col("_inline"), F.lit(K.BREAK), F.lit("  \n"))
    # breaks at the edge of a block leave no mark
    edge = F.regexp_replace(lines, r"^[ \n]+|[ \n]+$", "")
    body = (
        F.when(F.col("in_pre_code"), fenced)
        .when(F.col("in_pre"), F.regexp_replace(F.col("_inline"), r"^\n+|\n+$", ""))
        .when(F.col("_inline").contains(K.CELL_OPEN), render_row(F.col("_inline")))
        .otherwise(edge)
    )
    level = F.when(F.col("opener").isin(K.HEADING_TAGS), F.substring("opener", 2, 1).cast("int"))
    filled = shaped.withColumn("_part", body).withColumn(
        "_body",
        F.when(
            level.isNotNull() & (F.col("_part") != ""),
            F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("_part")),
        ).otherwise(F.col("_part")),
    )
    in_list = (F.col("list_depth") > 0) & F.col("item_pos").isNotNull()
    w_item = (
        Window.partitionBy("page_id", "item_pos", in_list)
        .orderBy("mb")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    w_before = (
        Window.partitionBy("page_id").orderBy("mb").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.sum(F.col("_vis").cast("int")).over(w_item) == 1
    staged = filled.withColumn("_first", in_list & F.col("_vis") & first).withColumn(
        "_prev",
        F.last(
            F.when(
                F.col("_vis"), F.struct("quote_root", "quote_depth", "list_root", "list_depth")
            ),
            ignorenulls=True,
        ).over(w_before),
    )

    def before(column: str) -> Column:
        return F.col("_prev")[column]

    listed = F.when(in_list, F.col("list_depth")).otherwise(0)
    marker = F.when(
        F.col("list_tag") == "ol", F.concat(F.col("item_no").cast("string"), F.lit(".  "))
    ).otherwise(F.lit(K.BULLET))
    indent = F.repeat(F.lit(" "), (listed * K.LIST_INDENT).cast("int"))
    lead = F.when(
        F.col("_first"),
        F.concat(
            F.repeat(F.lit(" "), ((listed - 1) * K.LIST_INDENT).cast("int")), marker
        ),
    ).otherwise(indent)
    quote = F.repeat(F.lit("> "), F.col("quote_depth").cast("int"))
    text = F.concat(
        quote,
        lead,
        F.replace(F.col("_body"), F.lit("\n"), F.concat(F.lit("\n"), quote, indent)),
    )
    same_quote = (before("quote_root") == F.col("quote_root")) & (before("quote_depth") > 0) & (
        F.col("quote_depth") > 0
    )
    shared = F.rtrim(
        F.repeat(F.lit("> "), F.least(before("quote_depth"), F.col("quote_depth")).cast("int"))
    )
    tight = F.col("_first") & (before("list_root") == F.col("list_root")) & (
        before("list_depth") > 0
    )
    gap = (
        F.when(F.col("_prev").isNull() | ~F.col("_vis"), F.lit(""))
        .when(tight, F.lit("\n"))
        .when(same_quote, F.concat(F.lit("\n"), shared, F.lit("\n")))
        .otherwise(F.lit("\n\n"))
    )
    return staged.select(
        "page_id",
        "mb",
        "is_page",
        "opener",
        gap.alias("gap"),
        F.when(F.col("_vis"), text).otherwise("").alias("block"),
        F.when(F.col("_vis") & (F.col("opener") == "p"), F.col("_inline")).alias("paragraph"),
        *(["html"] if has_html else []),
        *(["page"] if has_page else []),
    )


def plain_text(marked: Column) -> Column:
    """Block text without marks and escapes."""
    t = F.regexp_replace(marked, r"\[([^\[\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(^|[^\\])[*`]+", "$1")
    t = F.regexp_replace(t, r"[\x01-\x05\x0e-\x15]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\\(.)", "$1"), " +", " "))


def join_blocks(blocks: DataFrame, max_length: int = 0) -> DataFrame:
    """``(page_id, markdown, excerpt)`` from the blocks of each page."""

    def whole(text: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("mb", text.alias("text"))))
        return F.array_join(F.transform(ordered, lambda b: b["text"]), "")

    aggs = [
        whole(F.concat("gap", "block")).alias("_md"),
        F.min(F.when(F.col("paragraph").isNotNull(), F.struct("mb", "paragraph"))).alias("_first"),
    ]
    if "html" in blocks.columns:
        aggs.append(whole(F.col("html")).alias("html"))
    if "page" in blocks.columns:
        aggs.append(F.first("page", ignorenulls=True).alias("page"))
    return (
        blocks.groupBy("page_id")
        .agg(*aggs)
        .withColumns(
            {
                "markdown": T.truncate_md(T.normalize_md(F.col("_md")), max_length),
                "excerpt": plain_text(F.col("_first.paragraph")),
            }
        )
        .drop("_md", "_first")
    )


def to_markdown(tokens: DataFrame, max_length: int = 0) -> DataFrame:
    """``(page_id, markdown)`` of sanitised tokens."""
    blocks = markdown_blocks(text_runs(annotate(tokens)))
    return join_blocks(blocks, max_length).select("page_id", "markdown")
