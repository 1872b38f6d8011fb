"""URL expressions.

Simple rules are plain columns.  Rules with many intermediate values are written
as SQL lambdas: ``bind`` names a value once and lets the rest of the expression
use the name, so no part is computed (or planned) twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe import constants as K

# scheme, //authority, host, port, path, query, fragment
URL = (
    r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
    r"(//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?)?"
    r"([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
)
V4_PART = r"(0x[0-9a-f]*|[0-9]+)"
V4_LIKE = r"(^|\.)" + V4_PART + r"\.?$"
V4_SHAPE = r"^" + V4_PART + r"(\." + V4_PART + r"){0,3}\.?$"
BAD_HOST_CHARS = r"""[\x00-\x20"<>^|%\[\]\\`{}\x7f]"""
# ideographic and full-width forms of the dot and of ASCII, which hosts may be spelled with
WIDE = "\u3002\uff61" + "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = ".." + "".join(map(chr, range(0x21, 0x7F)))
# characters that a host mapping would drop or turn into digits or letters: such hosts are not
# read at all, so that no other spelling of an address passes the policy
UNSAFE_HOST_CHARS = (
    r"[\x{ad}\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{200b}-\x{200d}\x{2060}\x{2070}-\x{209f}\x{2100}-\x{218f}"
    r"\x{2460}-\x{24ff}\x{3200}-\x{33ff}\x{fe00}-\x{fe0f}\x{feff}\x{ff5f}-\x{ffef}\x{1d400}-\x{1d7ff}]"
)
# the common case: lower-case name whose last label starts with a letter, no user,
# no port, nothing to clean; read by one regex in generated code
COMMON_URL = r"^(https?)://((?:[a-z0-9_-]+\.)*[a-z][a-z0-9_-]*)(?:[/?#][^\x00-\x20\\]*)?$"
V6_SIDES = r"^([0-9a-f:]*?)::([0-9a-f:]*)$"


def lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """SQL: compute ``value`` once and call it ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def let(value: Column, body: str) -> Column:
    """The SQL expression ``body`` over ``value``, which it calls ``v``."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"v -> {body}")), F.lit(0))


def _replace(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(to)})"


def _extract(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def clean_sql(url: str) -> str:
    """Trim blanks and control characters, remove tabs and line ends, and read
    backslashes before the query of a web reference as slashes."""
    bare = _replace(_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$"), r"[\t\r\n]")
    first = _extract("cl", r"^[^?#]*", 0)
    slash = lit("\\")
    return bind(
        bare,
        "cl",
        f"CASE WHEN contains(cl, {slash}) AND cl RLIKE {lit(r'(?i)^(https?:|[/' + chr(92) * 2 + '])')} "
        f"THEN concat(translate({first}, {slash}, '/'), substr(cl, length({first}) + 1)) ELSE cl END",
    )


def _v4_part(part: str) -> str:
    """One dotted part as a number: decimal, octal or hexadecimal."""
    return (
        f"try_cast(CASE WHEN {part} RLIKE '^0x[0-9a-f]{{0,8}}$' THEN conv(concat('0', substr({part}, 3)), 16, 10) "
        f"WHEN {part} RLIKE '^0[0-7]{{1,11}}$' THEN conv({part}, 8, 10) "
        f"WHEN {part} RLIKE '^(0|[1-9][0-9]{{0,9}})$' THEN {part} END AS BIGINT)"
    )


def ipv4_sql(host: str) -> str:
    """IPv4 address as BIGINT in any of its 1-4 part spellings, else null."""
    read = ", ".join(f"'v{i}', {_v4_part(f'get(pp, {i})')}" for i in range(4))
    join = (
        "CASE WHEN n4.n = 1 AND n4.v0 < 4294967296 THEN n4.v0 "
        "WHEN n4.n = 2 AND n4.v0 < 256 AND n4.v1 < 16777216 THEN n4.v0 * 16777216 + n4.v1 "
        "WHEN n4.n = 3 AND n4.v0 < 256 AND n4.v1 < 256 AND n4.v2 < 65536 "
        "THEN n4.v0 * 16777216 + n4.v1 * 65536 + n4.v2 "
        "WHEN n4.n = 4 AND n4.v0 < 256 AND n4.v1 < 256 AND n4.v2 < 256 AND n4.v3 < 256 "
        "THEN n4.v0 * 16777216 + n4.v1 * 65536 + n4.v2 * 256 + n4.v3 END"
    )
    parts = f"split({_replace('h4', '[.]$')}, '[.]')"
    numbers = bind(parts, "pp", f"named_struct('n', size(pp), {read})")
    return bind(
        f"lower({host})", "h4", f"CASE WHEN h4 RLIKE {lit(V4_SHAPE)} THEN {bind(numbers, 'n4', join)} END"
    )


def dotted_sql(number: str) -> str:
    """BIGINT to ``a.b.c.d``."""
    return "concat_ws('.', " + ", ".join(
        f"CAST(shiftright({number}, {s}) & 255 AS STRING)" for s in (24, 16, 8, 0)
    ) + ")"


def ipv6_sql(host: str) -> str:
    """IPv6 address as eight groups joined by ``:`` (brackets dropped), else null."""
    tail = _extract("b6", r":([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$", 1)
    hexed = bind(
        f"named_struct('t', {tail}, 'n', {ipv4_sql(tail)})",
        "t6",
        "concat(substr(b6, 1, length(b6) - length(t6.t)), lower(hex(shiftright(t6.n, 16))), ':', "
        "lower(hex(t6.n & 65535)))",
    )

    def groups(side: str) -> str:
        return f"CASE WHEN {side} = '' THEN 0 ELSE size(split({side}, ':')) END"

    missing = f"(8 - {groups('s6.l')} - {groups('s6.r')})"
    lead = "CASE WHEN s6.l = '' THEN '' ELSE concat(s6.l, ':') END"
    filled = _replace(f"concat({lead}, repeat('0:', {missing}), s6.r)", ":$")
    sides = (
        f"named_struct('l', {_extract('x6', V6_SIDES, 1)}, 'r', {_extract('x6', V6_SIDES, 2)})"
    )
    expanded = (
        "CASE WHEN contains(x6, '::') THEN "
        + bind(sides, "s6", f"CASE WHEN {missing} >= 1 THEN {filled} END")
        + " ELSE x6 END"
    )
    text = f"CASE WHEN contains(b6, '.') THEN {hexed} ELSE b6 END"
    checked = bind(
        bind(text, "x6", expanded),
        "f6",
        "CASE WHEN f6 RLIKE '^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$' THEN f6 END",
    )
    bare = f"lower({_replace(host, r'^' + chr(92) + '[|' + chr(92) + ']$')})"
    return bind(bare, "b6", f"CASE WHEN contains(b6, ':') THEN {checked} END")


def host_sql(raw: str) -> str:
    """Lower-cased http host with numeric spellings turned into ``a.b.c.d``;
    null when the host is not allowed in a URL."""
    number = bind(ipv4_sql("lh"), "n5", f"CASE WHEN n5 IS NOT NULL THEN {dotted_sql('n5')} END")
    return bind(
        f"lower(translate({raw}, {lit(WIDE)}, {lit(NARROW)}))",
        "lh",
        f"CASE WHEN startswith(lh, '[') THEN CASE WHEN {ipv6_sql('lh')} IS NOT NULL THEN lh END "
        f"WHEN lh = '' OR lh RLIKE {lit(BAD_HOST_CHARS)} OR lh RLIKE {lit(UNSAFE_HOST_CHARS)} THEN NULL "
        f"WHEN lh RLIKE {lit(V4_LIKE)} THEN {number} ELSE lh END",
    )


def parts_sql(url: str) -> str:
    """``struct<scheme,host,port,path,query,fragment>``, null when not a URL."""
    fields = ["scheme", "authority", "host", "port", "path", "query", "fragment"]
    raw = "named_struct(" + ", ".join(
        f"'{f}', {_extract('u1', URL, i + 1)}" for i, f in enumerate(fields)
    ) + ")"
    web = "lower(u2.scheme) IN ('http', 'https')"
    checked = (
        f"named_struct('scheme', lower(u2.scheme), 'web', {web}, 'host', CASE WHEN {web} THEN {host_sql('u2.host')} "
        "ELSE lower(u2.host) END, 'port', try_cast(u2.port AS INT), 'path', u2.path, 'query', u2.query, "
        "'fragment', u2.fragment)"
    )
    usual = "(u3.scheme = 'http' AND u3.port = 80) OR (u3.scheme = 'https' AND u3.port = 443)"
    result = (
        "CASE WHEN u3.scheme <> '' AND (NOT u3.web OR (u3.host IS NOT NULL AND u3.path RLIKE '^(/|$)')) "
        "AND coalesce(u3.port <= 65535, true) THEN named_struct('scheme', u3.scheme, 'host', u3.host, "
        f"'port', CASE WHEN {usual} THEN NULL ELSE u3.port END, "
        "'path', CASE WHEN u3.web AND u3.path = '' THEN '/' ELSE u3.path END, "
        "'query', u3.query, 'fragment', u3.fragment) END"
    )
    return bind(bind(bind(clean_sql(url), "u1", raw), "u2", checked), "u3", result)


def clean_reference(url: Column) -> Column:
    return let(url, clean_sql("v"))


def ipv4_number(host: Column) -> Column:
    return let(host, ipv4_sql("v"))


def ipv6_text(host: Column) -> Column:
    return let(host, ipv6_sql("v"))


def url_parts(url: Column) -> Column:
    """``struct<scheme,host,port,path,query,fragment>``, null when not a URL."""
    return let(url, parts_sql("v"))


def url_host(url: Column) -> Column:
    """Canonical host of an http(s) URL, else null."""
    pick = "CASE WHEN wh.scheme IN ('http', 'https') THEN wh.host END"
    return F.when(url.rlike(COMMON_URL), F.regexp_extract(url, COMMON_URL, 2)).otherwise(
        let(url, bind(parts_sql("v"), "wh", pick))
    )


def url_scheme(url: Column) -> Column:
    return F.when(url.rlike(COMMON_URL), F.regexp_extract(url, COMMON_URL, 1)).otherwise(
        F.lower(F.regexp_extract(clean_reference(url), URL, 1))
    )


def is_http(url: Column) -> Column:
    return F.coalesce(url_scheme(url).isin("http", "https"), F.lit(False))


def has_http_prefix(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def url_dedup_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/$", ""))


def host_matches(host: Column, domain: Column) -> Column:
    h, d = F.lower(host), F.lower(domain)
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns a suffix match into an equality."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )


def cache_key(prefix: str, fields: dict[str, Column]) -> Column:
    """First 24 hex digits of sha256 over ``prefix:json`` with sorted keys."""
    body = F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )
    digest = F.sha2(F.concat(F.lit(prefix + ":"), body), 256)
    return F.substring(digest, 1, K.CACHE_KEY_CHARS)


def extraction_key(url: Column, formats: Column, only_main: Column) -> Column:
    return cache_key(
        "extract", {"url": url, "f": F.array_join(formats, ","), "omc": only_main}
    )


def csv_list(text: Column) -> Column:
    parts = F.transform(
        F.split(F.coalesce(text, F.lit("")), ","),
        lambda x: F.regexp_replace(x, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""),
    )
    return F.filter(parts, lambda x: x != "")


def rstrip_slash(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


# --- reference resolution ---------------------------------------------------

PATH_ENCODE = r"""[^\x21-\x7e]|["<>`{}]"""
TAIL_ENCODE = r"""[^\x21-\x7e]|["<>]"""
# references that are already in their final form: an absolute path, no dot
# segments, nothing to encode
PLAIN_PATH = r"^/([A-Za-z0-9_~!$&()*+,;=:@%?#-][A-Za-z0-9_~!$&()*+,;=:@%?#/.-]*)?$"


def _encode_sql(text: str, pattern: str) -> str:
    """Percent-encode the UTF-8 bytes of characters that match ``pattern``."""
    encoded = _replace("hex(encode(ch, 'UTF-8'))", "(..)", "%$1")
    each = f"CASE WHEN ch RLIKE {lit(pattern)} THEN {encoded} ELSE ch END"
    return (
        f"CASE WHEN {text} RLIKE {lit(pattern)} THEN "
        f"array_join(transform(split({text}, ''), ch -> {each}), '') ELSE {text} END"
    )


def _squeeze_sql(path: str) -> str:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    fold = (
        f"aggregate(split(substr({path}, 2), '/'), '', (acc, sg) -> CASE WHEN sg = '..' "
        f"THEN {_replace('acc', '/[^/]*$')} WHEN sg = '.' THEN acc ELSE concat(acc, '/', sg) END)"
    )
    close = f"CASE WHEN {path} RLIKE '/[.][.]?$' THEN '/' ELSE '' END"
    return f"CASE WHEN contains({path}, '/.') THEN concat({fold}, {close}) ELSE {path} END"


def base_parts(url: Column) -> Column:
    """The pieces of a page URL that references are resolved against."""
    pieces = (
        "CASE WHEN bp.scheme IN ('http', 'https') THEN named_struct('scheme', bp.scheme, 'site', "
        "concat(bp.host, coalesce(concat(':', bp.port), '')), 'path', bp.path, 'query', bp.query) END"
    )
    return let(url, bind(parts_sql("v"), "bp", pieces))


def resolve_sql(href: str, base: str) -> str:
    """A reference against base parts; null when it is not a URL."""
    nothing = "CAST(NULL AS STRING)"
    outside = bind(
        parts_sql(f"CASE WHEN r1.scheme = '' THEN concat({base}.scheme, ':', r1.ref) ELSE r1.ref END"),
        "o1",
        f"named_struct('opaque', {nothing}, 'scheme', o1.scheme, 'site', concat(o1.host, "
        "coalesce(concat(':', o1.port), '')), 'path', o1.path, 'tail', concat(o1.query, o1.fragment))",
    )
    relative = (
        f"named_struct('path', {_extract('r1.ref', r'^[^?#]*', 0)}, "
        f"'query', {_extract('r1.ref', r'^[^?#]*([?][^#]*)', 1)}, "
        f"'frag', {_extract('r1.ref', r'(#[' + chr(92) + 's' + chr(92) + 'S]*)$', 1)})"
    )
    inside = bind(
        relative,
        "i1",
        f"named_struct('opaque', {nothing}, 'scheme', {base}.scheme, 'site', {base}.site, "
        f"'path', CASE WHEN startswith(i1.path, '/') THEN i1.path WHEN i1.path = '' THEN {base}.path "
        f"ELSE concat({_replace(base + '.path', '[^/]*$')}, i1.path) END, "
        f"'tail', concat(CASE WHEN i1.path = '' AND i1.query = '' THEN {base}.query ELSE i1.query END, i1.frag))",
    )
    located = (
        "CASE WHEN r1.scheme <> '' AND r1.scheme NOT IN ('http', 'https') THEN named_struct('opaque', r1.ref, "
        f"'scheme', {nothing}, 'site', {nothing}, 'path', {nothing}, 'tail', {nothing}) "
        f"WHEN r1.scheme <> '' OR startswith(r1.ref, '//') THEN {outside} ELSE {inside} END"
    )
    written = (
        "CASE WHEN w1.opaque IS NOT NULL THEN w1.opaque ELSE concat(w1.scheme, '://', w1.site, "
        f"{bind(_squeeze_sql('w1.path'), 'sq', _encode_sql('sq', PATH_ENCODE))}, "
        f"{_encode_sql('w1.tail', TAIL_ENCODE)}) END"
    )
    scheme = f"lower({_extract('r0', r'^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)})"
    split = bind(clean_sql(href), "r0", f"named_struct('ref', r0, 'scheme', {scheme})")
    slow = bind(bind(split, "r1", located), "w1", written)
    return (
        f"CASE WHEN {href} RLIKE {lit(PLAIN_PATH)} AND NOT contains({href}, '/.') "
        f"THEN concat({base}.scheme, '://', {base}.site, {href}) ELSE {slow} END"
    )


def resolve_against(href: Column, base: Column) -> Column:
    """One reference against base parts; null when it is not a URL."""
    return let(F.struct(href.alias("h"), base.alias("b")), resolve_sql("v.h", "v.b"))


def resolve_url(href: Column, base_url: Column) -> Column:
    """One reference against one page URL; null when it is not a URL."""
    return resolve_against(href, base_parts(base_url))
