"""Text expressions: HTML attributes, entities and Markdown clean-up."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions.urls import bind, let, lit

_WS = r"[ \t\r\n\f]"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\r\n\f"'>]++)"""


def _others(wanted: str) -> str:
    """From the tag name over all attributes before the first that ``wanted`` matches.  Each
    attribute is taken whole or not at all (possessive), so the time is linear, nothing
    recurses, and text inside another quoted value never counts as an attribute."""
    name = r"[^ \t\r\n\f>/][^ \t\r\n\f>/=]*+"
    pair = rf"[ \t\r\n\f/]*+(?!{wanted}){name}(?:{_WS}*+={_WS}*+{_VALUE})?+"
    return rf"(?i)^<[a-zA-Z][^ \t\r\n\f/>]*+(?:{pair})*+[ \t\r\n\f/]*+"


def attr_pattern(name: str) -> str:
    """Pattern whose group 1 is the value, quotes included, of the first attribute ``name``."""
    wanted = f"{name}{_WS}*+={_WS}*+"
    return _others(wanted + _VALUE) + f"{wanted}({_VALUE})"


def attr_flag_pattern(name: str) -> str:
    wanted = name + r"(?:[ \t\r\n\f/=>]|$)"
    return _others(wanted) + wanted


def attr_raw(tag_text: Column, name: str) -> Column:
    return F.regexp_extract(tag_text, attr_pattern(name), 1)


def unquote(raw: Column) -> Column:
    return let(raw, unquote_sql("v"))


def attr_value(tag_text: Column, name: str) -> Column:
    """Attribute value with entities decoded; ``''`` when absent."""
    return unquote(attr_raw(tag_text, name))


def has_attr(tag_text: Column, name: str) -> Column:
    return tag_text.rlike(attr_flag_pattern(name))


def clean_html(html: Column) -> Column:
    """Drop style blocks, stylesheet links and inline style attributes."""
    for pattern in (K.STYLE_BLOCK, K.STYLESHEET_LINK, K.INLINE_STYLE):
        html = F.regexp_replace(html, pattern, "")
    return html


# characters escaped anywhere, and at the start of a text
ESCAPED = r"([\\*`\[\]_])"
ESCAPED_FIRST = r"^(-|\+ |=+|#{1,6} |~~~|>)"
BACKSLASH = chr(92) * 2  # one backslash in a regex replacement

# what may follow "&" in a character reference: a number or a name; then a legacy name,
# which needs no semicolon and may have letters behind it
REFERENCE = r"^(#[xX]0*[0-9a-fA-F]{1,6}|#0*[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]*;)"
LEGACY = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def entity_table() -> dict[str, str]:
    """Names of the HTML standard (as Python ships them), the library's own choices first."""
    own = {n[1:-1]: c for n, c in [*K.NAMED_ENTITIES, ("&amp;", "&")]}
    return own | {n.rstrip(";"): c for n, c in html5.items() if n.rstrip(";") not in own}


def _code_point(ref: str) -> str:
    """``#65`` or ``#x41`` to its character."""
    number = (
        f"try_cast(CASE WHEN {ref} RLIKE '^#[xX]' THEN conv(substr({ref}, 3), 16, 10) "
        f"ELSE substr({ref}, 2) END AS BIGINT)"
    )
    return bind(
        number,
        "cp",
        "CASE WHEN cp BETWEEN 1 AND 55295 OR cp BETWEEN 57344 AND 1114111 "
        "THEN decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32') ELSE '\ufffd' END",
    )


def decode_sql(text: str) -> str:
    """Character references to text, one reference per piece after ``&``."""
    own = {n[1:-1] for n, _ in K.NAMED_ENTITIES} | {"amp"}
    table = entity_table()

    def named(names) -> str:
        # one constant text, read into a map when the plan is folded
        return f"str_to_map({lit(chr(1).join(f'{n}{chr(2)}{table[n]}' for n in names))}, '\\u0001', '\\u0002')"

    common, rest = named(sorted(own)), named(sorted(table.keys() - own))
    known = f"coalesce(try_element_at({common}, regexp_replace(rf, ';$', '')), try_element_at({rest}, regexp_replace(rf, ';$', '')))"
    char = f"CASE WHEN startswith(rf, '#') THEN {_code_point('rf')} ELSE {known} END"
    old = bind(
        f"regexp_extract(pc, {lit(LEGACY)}, 1)",
        "lg",
        f"CASE WHEN lg <> '' THEN concat(coalesce(try_element_at({common}, lg), try_element_at({rest}, lg)), "
        "substr(pc, length(lg) + 1)) END",
    )
    # the semicolon goes with its reference
    after = "substr(pc, length(rf) + CASE WHEN startswith(rf, '#') AND substr(pc, length(rf) + 1, 1) = ';' THEN 2 ELSE 1 END)"
    piece = bind(
        f"regexp_extract(pc, {lit(REFERENCE)}, 1)",
        "rf",
        f"coalesce(CASE WHEN rf <> '' THEN concat({char}, {after}) END, {old}, concat('&', pc))",
    )
    whole = bind(
        f"split({text}, '&')",
        "ps",
        f"concat(get(ps, 0), array_join(transform(slice(ps, 2, size(ps)), pc -> {piece}), ''))",
    )
    return f"CASE WHEN contains({text}, '&') THEN {whole} ELSE {text} END"


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to text, in one pass.

    Unknown names stay as they are.
    """
    return let(text, decode_sql("v"))


def attr_sql(tag: str, name: str) -> str:
    """SQL form of ``attr_value``."""
    return unquote_sql(f"regexp_extract({tag}, {lit(attr_pattern(name))}, 1)")


def unquote_sql(raw: str) -> str:
    quotes = lit(r"""^["']|["']$""")
    return bind(f"regexp_replace({raw}, {quotes}, '')", "uq", decode_sql("uq"))


def escape_sql(text: str) -> str:
    """SQL form of ``md_escape``."""
    inner = f"regexp_replace({text}, {lit(ESCAPED)}, {lit(BACKSLASH + '$1')})"
    head = f"regexp_replace({inner}, {lit(ESCAPED_FIRST)}, {lit(BACKSLASH + '$1')})"
    return f"regexp_replace({head}, {lit('^([0-9]+)[.] ')}, {lit('$1' + BACKSLASH + '. ')})"


def md_escape(text: Column) -> Column:
    """Backslash-escape characters that Markdown would read as markup."""
    return let(text, escape_sql("v"))


def normalize_md(text: Column) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    tight = F.regexp_replace(F.regexp_replace(unix, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return trim_all(tight)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")


def truncate_md(text: Column, max_length: int) -> Column:
    if max_length <= 0:
        return text
    cut = F.concat(F.substring(text, 1, max_length), F.lit(K.TRUNCATION_MARK))
    return F.when(F.length(text) > max_length, cut).otherwise(text)
