"""HTML cut into lexemes and repaired to a balanced token list, both within one row.

``lexemes`` knows comments, raw text (scripts, styles, titles and the like) and quoted
attribute values.  ``repaired`` folds the lexemes with a stack of open elements, by the rules
of the HTML standard for implied end tags, scopes, table parts, formatting elements that
are opened again, and end tags without a partner.  In its result every element that is no
void one has exactly one close tag, and elements nest.

The fold is an ``aggregate`` over the array.  Its output grows in chunks, so a page of n
lexemes costs about n * CHUNK copies of a pointer, not n * n.

Left out of the standard: text and tags that stand wrongly inside a table stay there, rows are
not wrapped in an implied table body, and a formatting element whose end tag comes inside a
block that it holds ends with that block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions.urls import let, lit

CHUNK = 128

_VALUES = r"""(?:=[ \t\r\n\f]*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
_END = r"(?:[ \t\r\n\f/][^>]*+)?>"
#: Comments, raw text elements, tags, text.  Possessive or lazy over single characters, so it never recurses.
LEXEME = "|".join(
    [
        r"(?i)<!--(?:-?>|[\s\S]*?(?:--!?>|\z))",
        *[rf"<{t}(?:[ \t\r\n\f/]{_VALUES})?+>[\s\S]*?(?:</{t}{_END}|\z)" for t in K.RAW_TEXT_TAGS],
        rf"<[a-z/!?]{_VALUES}>",
        r"<[a-z/!?][^>]*+(?:>|\z)",
        r"[^<]++",
        "<",
    ]
)
_RAW = r"(?i)^<(" + "|".join(K.RAW_TEXT_TAGS) + r")[ \t\r\n\f/>]"
_OPEN = rf"^<[a-zA-Z]{_VALUES}>"
_RAW_END = r"(?i)</(?:" + "|".join(K.RAW_TEXT_TAGS) + rf"){_END}\z"

LEXEME_TYPE = "struct<t:string,n:string,c:boolean,m:int>"
_STACK_TYPE = "array<struct<n:string,m:int,k:string>>"

#: The classes of a tag are bits of one number, found once per lexeme, so the fold compares numbers.
CLASSES = {
    "special": K.SPECIAL_TAGS,
    "scope": K.SCOPE_TAGS,
    "button": ["button"],
    "list": ["ul", "ol"],
    "formatting": K.FORMATTING_TAGS,
    "marker": K.MARKER_TAGS,
    "void": K.VOID_TAGS,
    "part": K.TABLE_PART_TAGS,
    "heading": K.HEADING_TAGS,
    "closes_p": K.CLOSES_P_TAGS,
    "head": K.HEAD_TAGS,
    "loose": ["address", "div", "p"],
    "rows": ["tbody", "thead", "tfoot"],
    "table": ["table"],
    "template": ["template"],
    "tr": ["tr"],
    "term": ["dd", "dt"],
    "foreign": ["svg", "math"],
    "cell": ["td", "th"],
}
_BIT = {name: 1 << k for k, name in enumerate(CLASSES)}


def bind(value: str, name: str, body: str) -> str:
    """SQL: compute ``value`` once and call it ``name`` inside ``body``.  As the end of an aggregate over
    nothing: unlike a transform it copies no result, and here results hold the page so far."""
    return f"aggregate(CAST(array() AS array<int>), {value}, ({name}, no) -> {name}, {name} -> {body})"


def _is(value: str, *classes: str) -> str:
    """Is the tag of ``value`` (a struct with ``m``) in one of the classes?"""
    return f"({value}.m & {sum(_BIT[c] for c in classes)}) <> 0"


def _mask(name: str) -> str:
    return " + ".join(f"IF({_in(name, tags)}, {_BIT[c]}, 0)" for c, tags in CLASSES.items())


def _one(tok: str, tag: str, close: str, mask: str = "0") -> str:
    return f"named_struct('t', {tok}, 'n', {tag}, 'c', {close}, 'm', {mask})"


def lexemes_sql(html: str) -> str:
    raw = f"lower(regexp_extract(tk, {lit(_RAW)}, 1))"
    text = f"regexp_replace(substr(tk, length(op) + 1), {lit(_RAW_END)}, '')"
    # a title's text has character references, that of the others has none
    safe = f"replace(IF(rw IN ('title', 'textarea'), {text}, replace({text}, '&', '&amp;')), '<', '&lt;')"
    parts = bind(
        f"regexp_extract(tk, {lit(_OPEN)}, 0)",
        "op",
        f"array({_one('op', 'rw', 'false')}, {_one(safe, 'CAST(NULL AS STRING)', 'false')}, {_one(lit('</') + ' || rw || ' + lit('>'), 'rw', 'true')})",
    )
    name = f"nullif(lower(regexp_extract(tk, {lit(K.TAG_NAME)}, 1)), '')"
    plain = _one("tk", f"IF(startswith(tk, '<'), {name}, NULL)", "startswith(tk, '</')")
    skipped = "startswith(tk, '<!--') OR (tk RLIKE '^<[a-zA-Z/!?]' AND NOT endswith(tk, '>'))"
    one = bind(
        raw,
        "rw",
        f"CASE WHEN rw IN ('script', 'style') THEN CAST(array() AS array<{LEXEME_TYPE}>) WHEN rw <> '' THEN {parts} "
        f"WHEN {skipped} THEN CAST(array() AS array<{LEXEME_TYPE}>) ELSE array({plain}) END",
    )
    found = f"regexp_extract_all({html}, {lit(LEXEME)}, 0)"
    whole = f"filter(flatten(transform({found}, tk -> IF(startswith(tk, '<'), {one}, array({_one('tk', 'CAST(NULL AS STRING)', 'false')})))), lx -> lx.t <> '')"
    return f"transform({whole}, lx -> IF(lx.n IS NULL, lx, {_one('lx.t', 'lx.n', 'lx.c', _mask('lx.n'))}))"


def lexemes(html: Column) -> Column:
    """``array<struct<t, n, c, m>>``: the text as written, the tag's name (null for text and
    declarations), whether it is a close tag, and the tag's classes.  Comments, scripts and styles are left out."""
    return let(F.coalesce(html, F.lit("")), lexemes_sql("v"))


def _in(value: str, names) -> str:
    return f"{value} IN (" + ", ".join(lit(n) for n in names) + ")"


def _first(test: str) -> str:
    """Place from 1 of the innermost open element that the test holds for, 0 for none."""
    return f"CAST(array_position(transform(s.st, e -> {test}), true) AS INT)"


def _above(*context: str) -> str:
    """Open elements inside the innermost one of ``context``."""
    return bind(_first(_is("e", *context)), "at", "IF(at > 0, at - 1, 0)")


def _find(wanted: str, barrier: str) -> str:
    """Place of the innermost open element that is wanted, 0 if a barrier lies inside of it."""
    return bind(
        _first(f"{wanted} OR {barrier}"), "at", f"IF(at > 0 AND {wanted.replace('e.', 'get(s.st, at - 1).')}, at, 0)"
    )


def _either(first: str, then: str) -> str:
    return bind(first, "f1", f"IF(f1 > 0, f1, {then})")


_SCOPE, _BUTTON_SCOPE = _is("e", "scope"), _is("e", "scope", "button")
_LOOSE = f"({_is('e', 'special')} AND NOT {_is('e', 'loose')})"


def _pops_of_open() -> str:
    """How many elements an open tag closes."""
    top, paragraph = "get(s.st, 0)", _find("e.n = 'p'", _BUTTON_SCOPE)
    item = bind(
        f"CASE WHEN x.n = 'li' THEN {_find(lit('li') + ' = e.n', _LOOSE)} WHEN {_is('x', 'term')} THEN {_find(_is('e', 'term'), _LOOSE)} ELSE 0 END",
        "it",
        f"CASE WHEN it > 0 THEN it WHEN {_is('x', 'closes_p')} THEN {bind(paragraph, 'pp', f'CASE WHEN pp > 0 THEN pp WHEN {_is("x", "heading")} AND {_is(top, "heading")} THEN 1 ELSE 0 END')} ELSE 0 END",
    )
    return (
        f"CASE WHEN {top}.n = 'head' AND NOT {_is('x', 'head')} THEN 1 "
        f"WHEN {_is('x', 'part')} THEN CASE WHEN x.n = 'tr' THEN {_above('rows', 'table')} "
        f"WHEN {_is('x', 'cell')} THEN {_above('tr', 'rows', 'table')} "
        f"WHEN x.n = 'col' THEN {bind(_first(f'e.n = {lit("colgroup")} OR ' + _is('e', 'table')), 'at', 'IF(at > 0, at - 1, 0)')} "
        f"ELSE {_above('table')} END "
        f"WHEN {_is('x', 'closes_p')} THEN {item} "
        f"WHEN x.n IN ('option', 'optgroup') THEN IF({top}.n = 'option', 1, 0) "
        f"WHEN x.n = 'a' THEN {_find(lit('a') + ' = e.n', _is('e', 'special'))} "
        f"WHEN x.n = 'button' THEN {_find(lit('button') + ' = e.n', _SCOPE)} ELSE 0 END"
    )


def _pops_of_close() -> str:
    """How many elements a close tag ends, its own last; 0 if it has no partner."""
    barrier = (
        "CASE WHEN x.n = 'p' THEN {button} WHEN x.n = 'li' THEN {items} WHEN {part} THEN {table} "
        "WHEN x.n IN ('table', 'head') THEN {template} WHEN {block} THEN {scope} ELSE {special} END"
    ).format(
        button=_bits("scope", "button"), items=_bits("scope", "list"), part=_is("x", "part"), table=_bits("table"),
        template=_bits("template"), block=_is("x", "special", "formatting"), scope=_bits("scope"), special=_bits("special"),
    )
    same = f"(e.n = x.n OR ({_is('x', 'heading')} AND {_is('e', 'heading')}))"
    return bind(barrier, "bar", _find(same, "(e.m & bar) <> 0"))


def _bits(*classes: str) -> str:
    return str(sum(_BIT[c] for c in classes))


def _action() -> str:
    """What a lexeme does: ``k`` elements end, ``own`` tells whether the last of them is meant;
    the element at ``fin`` ends with the block inside it; ``put`` is what is written (the lexeme, it
    and its close tag, an empty paragraph, a line break, nothing); ``push`` opens an element."""

    def act(k="0", own="false", fin="0", put="t", push="false") -> str:
        return f"named_struct('k', {k}, 'own', {own}, 'fin', {fin}, 'put', {lit(put)}, 'push', {push})"

    void, foreign = _is("x", "void"), f"exists(s.st, e -> {_is('e', 'foreign')})"
    blocks = f"exists(slice(s.st, 1, kc - 1), e -> {_is('e', 'special')})"
    closing = bind(
        _pops_of_close(),
        "kc",
        f"CASE WHEN kc > 0 AND {_is('x', 'formatting')} AND {blocks} THEN {act(fin='kc', put='')} "
        f"WHEN kc > 0 THEN {act(k='kc', own='true', put='')} WHEN x.n = 'p' THEN {act(put='p')} ELSE {act(put='')} END",
    )
    opening = bind(
        _pops_of_open(),
        "ko",
        f"CASE WHEN {void} THEN {act(k='ko')} "
        f"WHEN endswith(x.t, '/>') AND ({_is('x', 'foreign')} OR {foreign}) THEN {act(k='ko', put='v')} "
        f"ELSE {act(k='ko', own=lit('a') + ' = x.n', push='true')} END",
    )
    return (
        f"CASE WHEN x.n IS NULL THEN {act(k='1')} "
        f"WHEN x.c AND x.n = 'br' THEN {act(put='r')} WHEN x.c AND ({void} OR x.n IN ('html', 'body')) THEN {act(put='')} "
        f"WHEN x.c THEN {closing} "
        f"WHEN x.n IN ('html', 'head', 'body') AND exists(s.st, e -> e.n = x.n) THEN {act(put='')} "
        f"WHEN {_is('x', 'part')} AND NOT exists(s.st, e -> {_is('e', 'table')}) THEN {act(put='')} "
        f"ELSE {opening} END"
    )


def _closers(elements: str) -> str:
    return f"transform({elements}, e -> {_one(lit('</') + ' || e.n || ' + lit('>'), 'e.n', 'true')})"


def _step() -> str:
    """The fold: state ``s`` has the open elements (innermost first; ``k`` is the tag of a formatting
    element, '#' once it is finished), the formatting elements to open again (outermost first) and
    the output; ``x`` is the lexeme."""
    formatting = _is("x", "formatting")
    marker = f"(exists(pop, e -> {_is('e', 'marker')}) OR (a.push AND {_is('x', 'marker')}))"
    ended = "filter(pop, (e, i) -> e.k NOT IN ('', '#') AND NOT (a.own AND i = a.k - 1))"
    forget = f"a.k = 0 AND a.fin = 0 AND x.c AND {formatting} OR NOT x.c AND x.n = 'a'"
    waiting = bind(
        f"IF({marker}, CAST(array() AS {_STACK_TYPE}), array_distinct(concat(s.pd, reverse({ended}))))",
        "w",
        f"IF({forget}, filter(w, e -> e.n <> x.n), w)",
    )
    # finished elements that come to the top go with what was on them
    also = bind("array_position(transform(below, e -> e.k <> '#'), true)", "q", "IF(q = 0, size(below), CAST(q AS INT) - 1)")
    rest = "IF(a.fin > 0, transform(left, (e, i) -> IF(i = a.fin - 1, named_struct('n', e.n, 'm', e.m, 'k', '#'), e)), left)"
    pushed = f"concat(array(named_struct('n', x.n, 'm', x.m, 'k', IF({formatting}, x.t, ''))), left)"
    written = (
        f"CASE a.put WHEN 't' THEN array(x) WHEN 'v' THEN array(x, {_one(lit('</') + ' || x.n || ' + lit('>'), 'x.n', 'true')}) "
        f"WHEN 'p' THEN array({_one(lit('<p>'), lit('p'), 'false')}, {_one(lit('</p>'), lit('p'), 'true')}) "
        f"WHEN 'r' THEN array({_one(lit('<br>'), lit('br'), 'false')}) ELSE CAST(array() AS array<{LEXEME_TYPE}>) END"
    )
    whole = bind(
        _action(),
        "a",
        bind(
            "named_struct('pop', slice(s.st, 1, a.k), 'below', slice(s.st, a.k + 1, size(s.st)))",
            "c",
            bind(
                f"named_struct('m', IF(a.k > 0, {also.replace('below', 'c.below')}, 0))",
                "d",
                bind(
                    "slice(c.below, d.m + 1, size(c.below))",
                    "left",
                    f"named_struct('st', IF(a.push, {pushed}, {rest}), 'pd', {waiting.replace('pop', 'c.pop')}, "
                    f"'o', concat(s.o, {_closers('concat(c.pop, slice(c.below, 1, d.m))')}, {written}))",
                ),
            ),
        ),
    )
    opened = f"transform(s.pd, e -> {_one('e.k', 'e.n', 'false')})"
    quiet = "named_struct('st', s.st, 'pd', s.pd, 'o', concat(s.o, array(x)))"
    again = (
        f"named_struct('st', concat(reverse(s.pd), s.st), 'pd', CAST(array() AS {_STACK_TYPE}), "
        f"'o', concat(s.o, {opened}, array(x)))"
    )
    blank = "(NOT x.t RLIKE '[^ \\\\t\\\\r\\\\n\\\\f]' OR x.t RLIKE '^<[!?/]')"
    return (
        f"CASE WHEN x.n IS NULL AND ({blank} OR (size(s.pd) = 0 AND NOT get(s.st, 0).n <=> 'head')) THEN {quiet} "
        f"WHEN x.n IS NULL AND NOT get(s.st, 0).n <=> 'head' THEN {again} ELSE {whole} END"
    )


def repaired_sql(lexed: str) -> str:
    out = f"array<{LEXEME_TYPE}>"
    empty = f"CAST(array() AS {_STACK_TYPE})"
    # lexemes are fetched by place: a slice would copy the whole array for each chunk
    chunk = (
        f"aggregate(sequence(ci * {CHUNK}, least(size(b.lx), (ci + 1) * {CHUNK}) - 1), "
        f"named_struct('st', g.st, 'pd', g.pd, 'o', CAST(array() AS {out})), "
        f"(s, li) -> {bind('get(b.lx, li)', 'x', _step())})"
    )
    return bind(
        f"named_struct('lx', {lexed})",
        "b",
        f"aggregate(filter(sequence(0, CAST(size(b.lx) DIV {CHUNK} AS INT)), ci -> ci * {CHUNK} < size(b.lx)), "
        f"named_struct('st', {empty}, 'pd', {empty}, 'o', CAST(array() AS array<{out}>)), "
        f"(g, ci) -> {bind(chunk, 'r', 'named_struct(' + lit('st') + ', r.st, ' + lit('pd') + ', r.pd, ' + lit('o') + ', concat(g.o, array(r.o)))')}, "
        f"g -> flatten(concat(g.o, array({_closers('g.st')}))))",
    )


def repaired(lexed: Column) -> Column:
    """The lexemes as a balanced list of the same type."""
    return let(lexed, repaired_sql("v"))
