"""DuckDB checks of the registered queries.

Each check is one SQL text over the driver tables.  Longer ones are chains of
common table expressions that are put together here by name.
"""

from __future__ import annotations

from html.entities import html5

from pageframe import constants as K
from pageframe.functions import policy as R
from pageframe.functions import text as T
from pageframe.functions import urls as U
from workload import inputs as I

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rep(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def ext(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def chain(*ctes: str, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# --- URLs --------------------------------------------------------------------

HEX = "'0123456789abcdef'"


def clean(expr: str) -> str:
    bare = rep(rep(expr, r"^[\x00-\x20]+|[\x00-\x20]+$"), r"[\t\r\n]")
    return bare


def base_number(expr: str, base: int) -> str:
    return (
        f"list_reduce(list_transform(string_split({expr}, ''), lambda c: "
        f"CAST(strpos({HEX}, c) - 1 AS BIGINT)), lambda a, b: a * {base} + b, CAST(0 AS BIGINT))"
    )


def v4_part(p: str) -> str:
    return (
        f"CASE WHEN {has(p, '^0x$')} THEN 0 "
        f"WHEN {has(p, '^0x[0-9a-f]{1,8}$')} THEN {base_number(f'substr({p}, 3)', 16)} "
        f"WHEN {has(p, '^0[0-7]{1,11}$')} THEN {base_number(p, 8)} "
        f"WHEN {has(p, '^(0|[1-9][0-9]{0,9})$')} THEN CAST({p} AS BIGINT) END"
    )


def ip_ctes(src: str, host: str, out: str) -> list[str]:
    """``src`` plus v4 (number) and v6 (eight groups) of column ``host``."""
    v = [v4_part(f"_p[{i + 1}]") for i in range(4)]
    left, right = r"^([0-9a-f:]*?)::([0-9a-f:]*)$", r"^([0-9a-f:]*?)::([0-9a-f:]*)$"
    return [
        f"{out}_a AS (SELECT *, {rep(f'lower(coalesce({host}, {q(chr(0x27)*0)}))', r'^[[]|]$')} AS _h FROM {src})",
        f"{out}_b AS (SELECT *, CASE WHEN {has('_h', U.V4_SHAPE)} THEN string_split({rep('_h', '[.]$')}, '.') END AS _p,"
        f" {ext('_h', r':([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$', 1)} AS _t FROM {out}_a)",
        f"{out}_c AS (SELECT *, {v[0]} AS _v0, {v[1]} AS _v1, {v[2]} AS _v2, {v[3]} AS _v3, len(_p) AS _n,"
        " CASE WHEN _t = '' THEN _h ELSE substr(_h, 1, length(_h) - length(_t)) ||"
        " lower(to_hex(CAST(split_part(_t, '.', 1) AS BIGINT) * 256 + CAST(split_part(_t, '.', 2) AS BIGINT))) || ':' ||"
        " lower(to_hex(CAST(split_part(_t, '.', 3) AS BIGINT) * 256 + CAST(split_part(_t, '.', 4) AS BIGINT))) END AS _s"
        f" FROM {out}_b)",
        f"{out}_d AS (SELECT *, CASE WHEN _n = 1 AND _v0 < 4294967296 THEN _v0"
        " WHEN _n = 2 AND _v0 < 256 AND _v1 < 16777216 THEN _v0 * 16777216 + _v1"
        " WHEN _n = 3 AND _v0 < 256 AND _v1 < 256 AND _v2 < 65536 THEN _v0 * 16777216 + _v1 * 65536 + _v2"
        " WHEN _n = 4 AND _v0 < 256 AND _v1 < 256 AND _v2 < 256 AND _v3 < 256"
        " THEN _v0 * 16777216 + _v1 * 65536 + _v2 * 256 + _v3 END AS v4,"
        f" {ext('_s', left, 1)} AS _l, {ext('_s', right, 2)} AS _r FROM {out}_c)",
        f"{out}_e AS (SELECT *, 8 - CASE WHEN _l = '' THEN 0 ELSE len(string_split(_l, ':')) END"
        f" - CASE WHEN _r = '' THEN 0 ELSE len(string_split(_r, ':')) END AS _m FROM {out}_d)",
        f"{out}_f AS (SELECT *, CASE WHEN NOT contains(_h, ':') THEN NULL WHEN contains(_s, '::') THEN"
        " CASE WHEN _m >= 1 THEN regexp_replace(CASE WHEN _l = '' THEN '' ELSE _l || ':' END ||"
        " repeat('0:', greatest(_m, 0)) || _r, ':$', '') END ELSE _s END AS _full"
        f" FROM {out}_e)",
        f"{out} AS (SELECT *, CASE WHEN {has('_full', '^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$')} THEN _full END AS v6"
        f" FROM {out}_f)",
    ]


def private_v4(n: str) -> str:
    ranges = " OR ".join(
        f"{n} BETWEEN {R.v4_bounds(a, b)[0]} AND {R.v4_bounds(a, b)[1]}" for a, b in K.PRIVATE_V4_RANGES
    )
    return f"(({ranges}) AND {n} <> {K.BROADCAST_V4})"


def private_ip_expr() -> str:
    g = [base_number(f"string_split(v6, ':')[{i}]", 16) for i in (1, 7, 8)]
    mapped = f"({g[1]} * 65536 + {g[2]})"
    return (
        f"coalesce(CASE WHEN v4 IS NOT NULL THEN {private_v4('v4')} WHEN v6 IS NOT NULL THEN "
        f"{has('v6', '^(0{1,4}:){7}0{0,3}1$')} OR {g[0]} & 65472 = 65152 OR {g[0]} & 65024 = 64512 "
        f"OR ({has('v6', '^(0{1,4}:){5}ffff:')} AND {private_v4(mapped)}) END, false)"
    )


def local_expr(h: str) -> str:
    ends = " OR ".join(f"ends_with({h}, {q(s)})" for s in K.LOCAL_SUFFIXES)
    return f"({h} IN {names(K.LOCAL_HOSTS)} OR {ends})"


def private_name_expr(h: str) -> str:
    ends = " OR ".join(f"ends_with({h}, {q(s)})" for s in K.PRIVATE_SUFFIXES)
    return (
        f"({local_expr(h)} OR {h} IN {names(K.PRIVATE_NAMES)} OR {ends} "
        f"OR {has(h, K.PRIVATE_V4_NAME_PATTERN)})"
    )


def url_ctes(src: str, url: str, out: str) -> list[str]:
    """``src`` plus scheme, host, port, path, query, fragment and ``valid``."""
    fields = ["sch", "auth", "hst", "prt", "pth", "qry", "frg"]
    picked = ", ".join(f"{ext('_u', U.URL, i + 1)} AS _{f}" for i, f in enumerate(fields))
    dotted = "CAST(v4 // 16777216 AS VARCHAR) || '.' || CAST(v4 // 65536 % 256 AS VARCHAR) || '.' || " \
             "CAST(v4 // 256 % 256 AS VARCHAR) || '.' || CAST(v4 % 256 AS VARCHAR)"
    return [
        f"{out}_1 AS (SELECT *, {clean(url)} AS _u FROM {src})",
        f"{out}_2 AS (SELECT *, {picked} FROM {out}_1)",
        *ip_ctes(f"{out}_2", "_hst", f"{out}_3"),
        f"{out}_4 AS (SELECT * EXCLUDE (_h, _p, _t, _s, _l, _r, _m, _n, _full, _v0, _v1, _v2, _v3),"
        f" lower(_sch) AS scheme, lower(_sch) IN ('http', 'https') AS web,"
        " CASE WHEN lower(_sch) NOT IN ('http', 'https') THEN lower(_hst)"
        " WHEN starts_with(_hst, '[') THEN CASE WHEN v6 IS NOT NULL THEN lower(_hst) END"
        f" WHEN _hst = '' OR {has('lower(_hst)', U.BAD_HOST_CHARS)} THEN NULL"
        f" WHEN {has('lower(_hst)', U.V4_LIKE)} THEN CASE WHEN v4 IS NOT NULL THEN {dotted} END"
        f" ELSE lower(_hst) END AS host, TRY_CAST(_prt AS INTEGER) AS _port FROM {out}_3)",
        f"{out} AS (SELECT *, _u IS NOT NULL AND scheme <> '' AND (NOT web OR (host IS NOT NULL AND"
        f" {has('_pth', '^(/|$)')})) AND coalesce(_port <= 65535, true) AS valid,"
        " CASE WHEN (scheme = 'http' AND _port = 80) OR (scheme = 'https' AND _port = 443) THEN NULL ELSE _port END AS port,"
        " CASE WHEN web AND _pth = '' THEN '/' ELSE _pth END AS path, _qry AS query, _frg AS fragment"
        f" FROM {out}_4)",
    ]


PROBE = f"probe AS ({I.duck(I.URL_PROBE)})"


def with_host(src: str, out: str) -> list[str]:
    """``src`` plus whost (canonical web host) and the IP columns of that host."""
    return [
        *url_ctes(src, "url", out + "_u"),
        f"{out}_w AS (SELECT * EXCLUDE (v4, v6), CASE WHEN valid AND web THEN host END AS whost FROM {out}_u)",
        *ip_ctes(f"{out}_w", "whost", out),
    ]


REASON = (
    f"CASE WHEN _u IS NULL OR scheme = '' OR (web AND whost IS NULL) THEN 'invalid_url' "
    f"WHEN NOT web THEN 'unsupported_protocol' WHEN {local_expr('_h')} THEN 'blocked_localhost' "
    f"WHEN {private_ip_expr()} THEN 'blocked_private_ip' "
    f"WHEN {private_name_expr('_h')} THEN 'blocked_private_hostname' END"
)

ORACLES["url_parts"] = chain(
    PROBE, *url_ctes("probe", "url", "parts"),
    final="SELECT id, CASE WHEN valid THEN scheme END AS scheme, CASE WHEN valid THEN host END AS host, "
          "CASE WHEN valid THEN port END AS port, CASE WHEN valid THEN path END AS path, "
          "CASE WHEN valid THEN query END AS query, CASE WHEN valid THEN fragment END AS fragment FROM parts",
)
ORACLES["url_flags"] = chain(
    PROBE, *with_host("probe", "w"),
    final="SELECT id, coalesce(web, false) AS is_http, "
          f"coalesce({has('url', '(?i)^https?://')}, false) AS has_prefix, "
          f"{local_expr('_h')} AS is_local, v4 IS NOT NULL OR v6 IS NOT NULL AS is_ip, "
          f"{private_ip_expr()} AS private_ip, {private_name_expr('_h')} AS private_name FROM w",
)
ORACLES["private_ip"] = chain(
    f"probe AS ({I.duck(I.IP_PROBE)})", *ip_ctes("probe", "ip", "w"),
    final=f"SELECT id, v4 IS NOT NULL OR v6 IS NOT NULL AS is_ip, {private_ip_expr()} AS is_private FROM w",
)
ORACLES["url_policy"] = chain(
    PROBE, *with_host("probe", "w"), f"r AS (SELECT id, {REASON} AS reason FROM w)",
    final="SELECT id, reason IS NULL AS ok, reason FROM r",
)
ORACLES["request_block"] = chain(
    PROBE, *with_host("probe", "w"),
    final=f"SELECT id, {REASON} IS NOT NULL AS blocked FROM w",
)
ORACLES["tracker_filter"] = chain(
    PROBE, final=f"SELECT id, url FROM probe WHERE {has('url', K.TRACKER_PATTERN)}"
)
_CAUSE = (
    f"CASE WHEN {REASON} IS NOT NULL THEN 'policy' WHEN resource_type IN "
    f"{names(K.BLOCKED_RESOURCE_TYPES)} THEN 'type' WHEN {has('url', K.TRACKER_PATTERN)} THEN 'tracker' END"
)
_SUB = [f"sub AS ({I.duck(I.SUBRESOURCES)})", *with_host("sub", "w")]
ORACLES["subresource_causes"] = chain(*_SUB, final=f"SELECT id, {_CAUSE} AS block_cause FROM w")
ORACLES["subresource_filter"] = chain(
    *_SUB, final=f"SELECT id, url, resource_type FROM w WHERE {_CAUSE} IS NULL"
)


def resolve_ctes(src: str, href: str, url: str, out: str) -> list[str]:
    """``src`` plus ``resolved``: column ``href`` against page URL ``url``."""

    def web_site(text: str) -> str:
        scheme = f"lower({ext(text, U.URL, 1)})"
        port = ext(text, U.URL, 4)
        return (
            f"lower({ext(text, U.URL, 3)}) || CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') "
            f"OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
        )

    def encode(text: str, pattern: str) -> str:
        return (
            f"CASE WHEN {has(text, pattern)} THEN array_to_string(list_transform(string_split({text}, ''), "
            f"lambda c: CASE WHEN regexp_matches(c, {q(pattern)}) THEN "
            rf"regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') ELSE c END), '') ELSE {text} END"
        )

    fold = (
        "list_reduce(string_split(substr(rp, 2), '/'), lambda acc, s: CASE WHEN s = '..' THEN "
        "regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')"
    )
    return [
        f"{out}_1 AS (SELECT *, {clean(href)} AS ref, {url} AS burl FROM {src})",
        f"{out}_2 AS (SELECT *, lower({ext('ref', '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)}) AS rs,"
        f" lower({ext('burl', U.URL, 1)}) AS bs, {web_site('burl')} AS bsite,"
        f" CASE WHEN {ext('burl', U.URL, 5)} = '' THEN '/' ELSE {ext('burl', U.URL, 5)} END AS bp,"
        f" {ext('burl', U.URL, 6)} AS bq FROM {out}_1)",
        f"{out}_3 AS (SELECT *, rs <> '' AND rs NOT IN ('http', 'https') AS opaque,"
        " rs IN ('http', 'https') OR (rs = '' AND starts_with(ref, '//')) AS absolute,"
        " CASE WHEN rs = '' THEN bs || ':' || ref ELSE ref END AS fullref,"
        f" {ext('ref', '^[^?#]*')} AS relp, {ext('ref', r'^[^?#]*([?][^#]*)', 1)} AS relq,"
        rf" {ext('ref', r'(#[\s\S]*)$', 1)} AS relf FROM {out}_2)",
        f"{out}_4 AS (SELECT *, CASE WHEN absolute THEN lower({ext('fullref', U.URL, 1)}) ELSE bs END AS us,"
        f" CASE WHEN absolute THEN {web_site('fullref')} ELSE bsite END AS usite,"
        f" NOT absolute OR ({ext('fullref', U.URL, 3)} <> '' AND NOT {has(ext('fullref', U.URL, 3), U.BAD_HOST_CHARS)}"
        f" AND {has(ext('fullref', U.URL, 5), '^(/|$)')}) AS good,"
        f" CASE WHEN absolute THEN CASE WHEN {ext('fullref', U.URL, 5)} = '' THEN '/' ELSE {ext('fullref', U.URL, 5)} END"
        " WHEN starts_with(relp, '/') THEN relp WHEN relp = '' THEN bp"
        " ELSE regexp_replace(bp, '[^/]*$', '') || relp END AS rp,"
        f" CASE WHEN absolute THEN {ext('fullref', U.URL, 6)} || {ext('fullref', U.URL, 7)}"
        " WHEN relp = '' AND relq = '' THEN bq || relf ELSE relq || relf END AS tail"
        f" FROM {out}_3)",
        f"{out}_5 AS (SELECT *, CASE WHEN contains(rp, '/.') THEN {fold} ||"
        rf" CASE WHEN regexp_matches(rp, '/\.\.?$') THEN '/' ELSE '' END ELSE rp END AS np FROM {out}_4)",
        f"{out} AS (SELECT *, CASE WHEN opaque THEN ref WHEN good THEN us || '://' || usite ||"
        f" {encode('np', U.PATH_ENCODE)} || {encode('tail', U.TAIL_ENCODE)} END AS resolved FROM {out}_5)",
    ]


ORACLES["resolve_url"] = chain(
    f"probe AS ({I.duck(I.REF_PROBE)})", *resolve_ctes("probe", "href", "url", "r"),
    final="SELECT id, resolved FROM r",
)
HITS = f"hits AS ({I.duck(I.HITS)})"
ORACLES["url_dedup_key"] = chain(
    HITS, final="SELECT src_pos, lower(regexp_replace(url, '/$', '')) AS key FROM hits"
)
ORACLES["host_matches"] = chain(
    HITS, *with_host("hits", "w"),
    final="SELECT src_pos, coalesce(whost = 'example.org' OR ends_with(whost, '.example.org'), false) AS hit FROM w",
)


def key_expr(url: str) -> str:
    return (
        "substr(sha256('extract:{\"f\":\"markdown\",\"omc\":true,\"url\":\"' || " + url + " || '\"}'), 1, 24)"
    )


ORACLES["cache_key"] = f"SELECT page_id, {key_expr('url')} AS cache_key FROM pages"
_ITEM = rep("x", r"^[\s\x{a0}]+|[\s\x{a0}]+$")
ORACLES["csv_list"] = (
    f"SELECT doc_id, coalesce((SELECT string_agg({_ITEM}, '|' ORDER BY i) FROM (SELECT unnest(string_split(text, ',')) AS x, "
    f"generate_subscripts(string_split(text, ','), 1) AS i) WHERE {_ITEM} <> ''), '') AS items FROM documents"
)
ORACLES["rstrip_slash"] = (
    "SELECT page_id, rtrim(url || repeat('/', page_id % 4), '/') AS url FROM pages"
)
_HOSTED = [*with_host("pages", "w"), f"dns AS ({I.duck(I.DNS)})"]
_DNS_FLAG = [
    *ip_ctes("dns", "address", "dip"),
    f"dflag AS (SELECT host AS dhost, bool_or({private_ip_expr()}) AS private FROM dip GROUP BY host)",
]
ORACLES["dns_fail_closed"] = chain(
    *_HOSTED, *_DNS_FLAG,
    final="SELECT whost AS host, coalesce(private, true) AS private FROM "
          "(SELECT DISTINCT whost FROM w WHERE whost IS NOT NULL) LEFT JOIN dflag ON dhost = whost",
)
ORACLES["url_policy_dns"] = chain(
    *_HOSTED, *_DNS_FLAG,
    f"r AS (SELECT page_id, whost, {REASON} AS r0 FROM w)",
    "v AS (SELECT page_id, coalesce(r0, CASE WHEN coalesce(private, true) THEN "
    "'blocked_private_resolution' END) AS reason FROM r LEFT JOIN dflag ON dhost = whost)",
    final="SELECT page_id, reason IS NULL AS ok, reason FROM v",
)

def _number(parts: str) -> str:
    return " + ".join(f"CAST({parts}[{k + 1}] AS BIGINT) * {256 ** (3 - k)}" for k in range(4))


ORACLES["network_lists"] = chain(
    f"nets AS ({I.duck(I.NETWORKS)})",
    "nr AS (SELECT DISTINCT CAST(split_part(network, '/', 2) AS INT) AS len, "
    f"{_number("string_split(split_part(network, '/', 1), '.')")} AS num FROM nets)",
    "bounds AS (SELECT DISTINCT num // (1::BIGINT << (32 - len)) * (1::BIGINT << (32 - len)) AS lo, "
    "num // (1::BIGINT << (32 - len)) * (1::BIGINT << (32 - len)) + (1::BIGINT << (32 - len)) - 1 AS hi FROM nr)",
    f"addr AS (SELECT DISTINCT address, {_number("string_split(address, '.')")} AS num FROM ({I.duck(I.ADDRESSES)}) a)",
    final="SELECT address, EXISTS (SELECT 1 FROM bounds WHERE num BETWEEN lo AND hi) AS listed FROM addr",
)

# --- pages: tokens and sanitising -------------------------------------------

RICH = f"src AS ({I.duck(I.RICH_PAGES)})"
FETCHED = f"src AS ({I.duck(I.FETCHED_PAGES)})"
PLAIN = "src AS (SELECT page_id, url, html FROM pages)"


# an attribute, and what may stand before it; names up to white space, "/", ">" or "="
ATTRIBUTE = r"""[ \t\r\n\f/]*[^ \t\r\n\f/>][^ \t\r\n\f/>=]*(?:[ \t\r\n\f]*=[ \t\r\n\f]*(?:"[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+))?"""
VALUED = r"""[ \t\r\n\f]*=[ \t\r\n\f]*((?s).+)$"""


def attributes(tok: str, pattern: str) -> str:
    """Attributes of a tag, as written, that match; the tag's own name comes first."""
    return (
        f"list_filter(regexp_extract_all({tok}, {q(ATTRIBUTE)})[2:], "
        f"lambda a: {has('a', pattern)})"
    )


def attr_raw(tok: str, name: str) -> str:
    start = r"(?i)^[ \t\r\n\f/]*" + name
    first = f"{attributes(tok, start + VALUED)}[1]"
    return f"coalesce(CASE WHEN {has(tok, '^<[a-zA-Z]')} THEN {ext(first, start + VALUED, 1)} END, '')"


def attr_flag(tok: str, name: str) -> str:
    start = r"(?i)^[ \t\r\n\f/]*" + name + r"([ \t\r\n\f]*=|$)"
    return f"({has(tok, '^<[a-zA-Z]')} AND len({attributes(tok, start)}) > 0)"


ENTITY_MAP = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in T.entity_table().items()) + "}"
OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


def decode(text: str) -> str:
    """Character references of a text, one reference per piece after ``&``."""
    ref = ext("p", "^(#[xX]0*[0-9a-fA-F]{1,6}|#0*[0-9]{1,7});?", 1)
    long, old = ext("p", "^([a-zA-Z][a-zA-Z0-9]*);", 1), ext("p", f"^({OLD_NAMES})", 1)
    code = (
        f"CASE WHEN {has(ref, '^#[xX]')} THEN {base_number(f'lower(substr({ref}, 3))', 16)} "
        f"ELSE TRY_CAST(substr({ref}, 2) AS BIGINT) END"
    )
    number = (
        f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 "
        f"THEN chr(CAST({code} AS INTEGER)) ELSE chr(65533) END"
    )
    numeric = "^(#[xX]0*[0-9a-fA-F]{1,6}|#0*[0-9]{1,7});?"
    piece = (
        f"CASE WHEN {ref} <> '' THEN {number} || substr(p, length({ext('p', numeric, 0)}) + 1) "
        f"WHEN {ENTITY_MAP}[{long}] IS NOT NULL THEN {ENTITY_MAP}[{long}] || substr(p, length({long}) + 2) "
        f"WHEN {old} <> '' THEN {ENTITY_MAP}[{old}] || substr(p, length({old}) + 1) ELSE '&' || p END"
    )
    rest = f"list_transform(string_split({text}, '&')[2:], lambda p: {piece})"
    return (
        f"CASE WHEN contains({text}, '&') THEN string_split({text}, '&')[1] || array_to_string({rest}, '') "
        f"ELSE {text} END"
    )


def unquote(raw: str) -> str:
    return decode(rep(raw, r"""^["']|["']$"""))


# --- the tree, lexeme by lexeme ----------------------------------------------

# the longest of: comment, raw text element, tag (quoted values whole), text
_ATTRS = r"""(?:[ \t\r\n\f/](?:=[ \t\r\n\f]*(?:"[^"]*"|'[^']*')|[^>])*)?"""
_RAW_NAMES = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
LEX = (
    r"(?i)<!--(?:>|->|[\s\S]*?(?:-->|--!>|\z))|"
    + "|".join(rf"<{n}{_ATTRS}>[\s\S]*?(?:</{n}>|</{n}[ \t\r\n\f/][^>]*>|\z)" for n in _RAW_NAMES)
    + r"""|<[a-z/!?](?:=[ \t\r\n\f]*(?:"[^"]*"|'[^']*')|[^>])*>|<[a-z/!?][^>]*(?:>|\z)|[^<]+|<"""
)
_LX = "STRUCT(t VARCHAR, n VARCHAR, c BOOLEAN)"
_EL = "STRUCT(n VARCHAR, m INT, k VARCHAR)"
# the classes of a tag as bits, so that the steps compare numbers
_CLASS = {
    name: (1 << k, tags)
    for k, (name, tags) in enumerate(
        {
            "special": K.SPECIAL_TAGS, "scope": K.SCOPE_TAGS, "button": ["button"], "list": ["ul", "ol"],
            "formatting": K.FORMATTING_TAGS, "marker": K.MARKER_TAGS, "void": K.VOID_TAGS, "part": K.TABLE_PART_TAGS,
            "heading": K.HEADING_TAGS, "closes_p": K.CLOSES_P_TAGS, "head": K.HEAD_TAGS, "loose": ["address", "div", "p"],
            "rows": ["tbody", "thead", "tfoot"], "table": ["table"], "template": ["template"], "tr": ["tr"],
            "term": ["dd", "dt"], "foreign": ["svg", "math"], "cell": ["td", "th"], "colgroup": ["colgroup"],
        }.items()
    )
}


def _of(m: str, *classes: str) -> str:
    return f"({m} & {sum(_CLASS[c][0] for c in classes)}) <> 0"


def _place(test: str) -> str:
    """Place of the innermost open element that the test holds for, or 0."""
    return f"coalesce(list_position(list_transform(st, lambda e: coalesce({test}, false)), true), 0)"


def _search(test: str, *barrier: str) -> str:
    """The same, 0 if a barrier is nearer."""
    own, any_ = _place(test), _place(f"{test} OR {_of('e.m', *barrier)}")
    return f"(CASE WHEN {own} = {any_} THEN {own} ELSE 0 END)"


def _inside(*context: str) -> str:
    return f"greatest({_place(_of('e.m', *context))} - 1, 0)"


def lexeme_ctes(src: str = "src") -> list[str]:
    """``lx``: page_id, i from 1, t, n, c."""
    raw = ext("l", r"(?i)^<(" + "|".join(_RAW_NAMES) + r")[ \t\r\n\f/>]", 1)
    opened = ext("l", r"""^<[a-zA-Z](?:=[ \t\r\n\f]*(?:"[^"]*"|'[^']*')|[^>])*>""")
    inner = rep(f"substr(l, length({opened}) + 1)", r"(?i)</(?:" + "|".join(_RAW_NAMES) + r")(?:[ \t\r\n\f/][^>]*)?>\z")
    return [
        f"lx0 AS (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS a FROM"
        f" (SELECT page_id, regexp_extract_all(html, {q(LEX)}) AS ls FROM {src}) u)",
        f"lx1 AS (SELECT *, lower({raw}) AS raw FROM lx0 WHERE l <> '')",
        f"lx2 AS (SELECT page_id, a, 0 AS b, l AS t, CASE WHEN {has('l', '^</?[a-zA-Z]')} THEN"
        f" lower({ext('l', K.TAG_NAME, 1)}) END AS n, starts_with(l, '</') AS c FROM lx1 WHERE raw = '' AND NOT"
        f" (starts_with(l, '<!--') OR ({has('l', '^<[a-zA-Z/!?]')} AND NOT ends_with(l, '>')))"
        f" UNION ALL SELECT page_id, a, 1, {opened}, raw, false FROM lx1 WHERE raw NOT IN ('', 'script', 'style')"
        f" UNION ALL SELECT page_id, a, 2, replace(CASE WHEN raw IN ('title', 'textarea') THEN {inner} ELSE"
        f" replace({inner}, '&', '&amp;') END, '<', '&lt;'), NULL, false FROM lx1 WHERE raw NOT IN ('', 'script', 'style')"
        f" UNION ALL SELECT page_id, a, 3, '</' || raw || '>', raw, true FROM lx1 WHERE raw NOT IN ('', 'script', 'style'))",
        "lx AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a, b) AS i, t, n, c FROM lx2 WHERE t <> '')",
    ]


def tree_ctes(src: str = "src") -> list[str]:
    """``tree``: the repaired tokens, built one lexeme of each page at a time."""
    same, void = "e.n = n", _of("m", "void")
    p_open = _search("e.n = 'p'", "scope", "button")
    part, heading, formatting = _of("m", "part"), _of("m", "heading"), _of("m", "formatting")

    def item(test: str) -> str:
        barred = f"{_of('e.m', 'special')} AND NOT {_of('e.m', 'loose')}"
        return f"(CASE WHEN {_place(test)} = {_place(f'{test} OR ({barred})')} THEN {_place(test)} ELSE 0 END)"

    li, term = item("e.n = 'li'"), item(_of("e.m", "term"))
    pops = (
        "CASE WHEN n IS NULL THEN CASE WHEN st[1].n = 'head' AND solid THEN 1 ELSE 0 END"
        f" WHEN c AND ({void} OR n IN ('html', 'body')) THEN 0"
        f" WHEN c AND n = 'p' THEN {_search(same, 'scope', 'button')}"
        f" WHEN c AND n = 'li' THEN {_search(same, 'scope', 'list')}"
        f" WHEN c AND {heading} THEN {_search(_of('e.m', 'heading'), 'scope')}"
        f" WHEN c AND {part} THEN {_search(same, 'table')}"
        f" WHEN c AND n IN ('table', 'head') THEN {_search(same, 'template')}"
        f" WHEN c AND {_of('m', 'special', 'formatting')} THEN {_search(same, 'scope')}"
        f" WHEN c THEN {_search(same, 'special')} WHEN unwanted THEN 0"
        f" WHEN st[1].n = 'head' AND NOT {_of('m', 'head')} THEN 1"
        f" WHEN n = 'tr' THEN {_inside('rows', 'table')} WHEN {_of('m', 'cell')} THEN {_inside('tr', 'rows', 'table')}"
        f" WHEN n = 'col' THEN {_inside('colgroup', 'table')} WHEN {part} THEN {_inside('table')}"
        f" WHEN n = 'li' THEN CASE WHEN {li} > 0 THEN {li} ELSE {p_open} END"
        f" WHEN {_of('m', 'term')} THEN CASE WHEN {term} > 0 THEN {term} ELSE {p_open} END"
        f" WHEN {heading} THEN CASE WHEN {p_open} > 0 THEN {p_open} WHEN {_of('st[1].m', 'heading')} THEN 1 ELSE 0 END"
        f" WHEN {_of('m', 'closes_p')} THEN {p_open}"
        " WHEN n IN ('option', 'optgroup') THEN CASE WHEN st[1].n = 'option' THEN 1 ELSE 0 END"
        f" WHEN n = 'a' THEN {_search(lit_eq('a'), 'special')}"
        f" WHEN n = 'button' THEN {_search(lit_eq('button'), 'scope')} ELSE 0 END"
    )
    block_inside = f"len(list_filter(st[1:k0 - 1], lambda e: {_of('e.m', 'special')})) > 0"
    marker = _of("e.m", "marker")
    closed = "{'t': '</' || e.n || '>', 'n': e.n, 'c': true}"
    foreign = f"({_of('m', 'foreign')} OR len(list_filter(st, lambda e: {_of('e.m', 'foreign')})) > 0)"
    steps = [
        # the lexeme meets the state
        "SELECT f.page_id, x.i, f.st, f.pd, x.t, x.n, x.c, x.m, x.n IS NULL AND "
        + has("x.t", "[^ \\t\\r\\n\\f]") + " AND NOT " + has("x.t", "^<[!?/]") + " AS solid,"
        f" coalesce(NOT x.c AND ((x.n IN ('html', 'head', 'body') AND list_contains(list_transform(f.st, lambda e: e.n), x.n))"
        f" OR ({_of('x.m', 'part')} AND NOT list_contains(list_transform(f.st, lambda e: e.n), 'table'))), false) AS unwanted"
        " FROM fold f JOIN lxm x ON x.page_id = f.page_id AND x.i = f.i + 1",
        f"SELECT *, {pops} AS k0 FROM ($) s1",
        f"SELECT *, coalesce(c AND {formatting} AND k0 > 0 AND {block_inside}, false) AS later,"
        f" coalesce(NOT c AND NOT unwanted AND n IS NOT NULL AND NOT ({void}) AND NOT (ends_with(t, '/>') AND {foreign}), false) AS push,"
        f" coalesce(NOT c AND NOT unwanted AND ends_with(t, '/>') AND NOT ({void}) AND {foreign}, false) AS alone FROM ($) s2",
        "SELECT *, CASE WHEN later THEN 0 ELSE k0 END AS k FROM ($) s3",
        "SELECT *, st[1:k] AS pop, st[k + 1:] AS below, coalesce((c AND k > 0) OR (push AND n = 'a'), false) AS own FROM ($) s4",
        "SELECT *, CASE WHEN k = 0 THEN 0 ELSE coalesce(list_position(list_transform(below, lambda e: e.k <> '#'), true), 0) END AS fresh FROM ($) s5",
        "SELECT *, CASE WHEN k = 0 THEN 0 WHEN fresh = 0 THEN len(below) ELSE fresh - 1 END AS done,"
        f" len(list_filter(pop, lambda e: {marker})) > 0 OR (push AND {_of('m', 'marker')}) AS forget FROM ($) s6",
        "SELECT *, below[done + 1:] AS rest, CASE WHEN forget THEN [] ELSE list_concat(pd, list_reverse(list_filter(pop,"
        " lambda e, j: e.k <> '' AND e.k <> '#' AND NOT (own AND j = k)))) END AS pd1 FROM ($) s7",
        # each waiting element once, where it stood first
        "SELECT *, list_filter(pd1, lambda e, j: list_position(pd1, e) = j AND NOT (coalesce((c AND k = 0 AND NOT later"
        f" AND {formatting}) OR (NOT c AND n = 'a'), false) AND e.n = n)) AS pd2 FROM ($) s8",
        f"SELECT page_id, i, CASE WHEN solid THEN list_concat(list_reverse(pd2), rest)"
        f" WHEN push THEN list_concat([{{'n': n, 'm': m, 'k': CASE WHEN {formatting} THEN t ELSE '' END}}], rest)"
        " WHEN later THEN list_transform(rest, lambda e, j: {'n': e.n, 'm': e.m, 'k': CASE WHEN j = k0 THEN '#' ELSE e.k END})"
        f" ELSE rest END::{_EL}[] AS st, CASE WHEN solid THEN [] ELSE pd2 END::{_EL}[] AS pd,"
        f" list_concat(list_transform(list_concat(pop, below[1:done]), lambda e: {closed}),"
        " CASE WHEN solid THEN list_concat(list_transform(pd2, lambda e: {'t': e.k, 'n': e.n, 'c': false}), [{'t': t, 'n': n, 'c': c}])"
        " WHEN n IS NULL THEN [{'t': t, 'n': n, 'c': c}] WHEN c AND n = 'br' THEN [{'t': '<br>', 'n': 'br', 'c': false}]"
        " WHEN c AND n = 'p' AND k0 = 0 THEN [{'t': '<p>', 'n': 'p', 'c': false}, {'t': '</p>', 'n': 'p', 'c': true}]"
        " WHEN alone THEN [{'t': t, 'n': n, 'c': c}, {'t': '</' || n || '>', 'n': n, 'c': true}]"
        f" WHEN c OR unwanted THEN [] ELSE [{{'t': t, 'n': n, 'c': c}}] END)::{_LX}[] AS o FROM ($) s9",
    ]
    step = steps[0]
    for outer in steps[1:]:
        step = outer.replace("$", step)
    bits = " + ".join(f"CASE WHEN n IN {names(tags)} THEN {bit} ELSE 0 END" for bit, tags in _CLASS.values())
    return [
        *lexeme_ctes(src),
        f"lxm AS MATERIALIZED (SELECT *, ({bits})::INT AS m FROM lx)",
        f"fold AS (SELECT page_id, CAST(0 AS BIGINT) AS i, []::{_EL}[] AS st, []::{_EL}[] AS pd, []::{_LX}[] AS o FROM {src}"
        f" UNION ALL {step})",
        f"ends AS (SELECT page_id, i + 1 AS i, list_transform(st, lambda e: {closed})::{_LX}[] AS o FROM fold"
        " QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i DESC) = 1)",
        "tree0 AS (SELECT page_id, i, unnest(o) AS e, generate_subscripts(o, 1) AS j FROM"
        " (SELECT page_id, i, o FROM fold UNION ALL SELECT page_id, i, o FROM ends) u)",
        "tree AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos, e.t AS tok, e.n AS tag,"
        " coalesce(e.c, false) AS cl FROM tree0)",
    ]


def lit_eq(name: str) -> str:
    return f"e.n = {q(name)}"


def token_ctes(src: str = "src") -> list[str]:
    return [
        *tree_ctes(src),
        "tok AS (SELECT r.page_id, s.url, r.pos, r.tok, r.tag, r.cl AND r.tag IS NOT NULL AS cl, CASE WHEN r.tag IS NOT NULL"
        f" THEN 'tag' WHEN {has('r.tok', '^<[!?/]')} THEN 'decl' ELSE 'text' END AS kind FROM tree r JOIN {src} s"
        " ON r.page_id = s.page_id)",
    ]


def pair_ctes(src: str = "tok") -> list[str]:
    void = f"coalesce(tag IN {names(K.VOID_TAGS)}, false)"
    return [
        f"pr0 AS (SELECT *, {void} AS void FROM {src})",
        "pr1 AS (SELECT *, sum(CASE WHEN kind <> 'tag' OR void THEN 0 WHEN cl THEN -1 ELSE 1 END) OVER "
        "(PARTITION BY page_id, tag ORDER BY pos) AS run FROM pr0)",
        "pr2 AS (SELECT *, CASE WHEN cl THEN run + 1 ELSE run END AS lvl FROM pr1)",
        "pair AS (SELECT *, CASE WHEN kind = 'tag' AND NOT cl AND void THEN pos WHEN kind = 'tag' AND NOT void AND NOT cl"
        " AND lead(cl) OVER l THEN lead(pos) OVER l END AS end_pos,"
        " CASE WHEN kind = 'tag' AND NOT void AND cl AND NOT lag(cl) OVER l THEN lag(pos) OVER l END AS start_pos"
        " FROM pr2 WINDOW l AS (PARTITION BY page_id, tag, lvl ORDER BY pos))",
    ]


def value_has(name: str, parts: list[str]) -> str:
    return has(attr_raw("tok", name), "|".join(p.replace("-", "[-]") for p in parts))


BOILERPLATE = (
    f"kind = 'tag' AND NOT cl AND (tag IN {names(K.BOILERPLATE_TAGS)} OR {attr_flag('tok', 'aria-live')} "
    f"OR trim({attr_raw('tok', 'role')}, '\"''') IN {names(K.BOILERPLATE_ROLES)} "
    f"OR {value_has('class', K.BOILERPLATE_CLASS_PARTS)} OR {value_has('id', K.BOILERPLATE_ID_PARTS)})"
)
CONSENT = (
    f"kind = 'tag' AND NOT cl AND ({value_has('class', K.CONSENT_CLASS_PARTS)} "
    f"OR {value_has('id', K.CONSENT_ID_PARTS)})"
)


def drop_ctes(match: str, out: str = "dropped") -> list[str]:
    run = "OVER (PARTITION BY page_id ORDER BY pos)"
    return [
        f"dr0 AS (SELECT *, {match} AS hit FROM pair)",
        "dr1 AS (SELECT *, start_pos IS NOT NULL AND coalesce(lag(hit) OVER "
        "(PARTITION BY page_id, tag, lvl ORDER BY pos), false) AS chit FROM dr0)",
        f"dr2 AS (SELECT *, sum(CASE WHEN hit AND NOT void THEN 1 WHEN chit THEN -1 ELSE 0 END) {run} AS depth FROM dr1)",
        f"{out} AS (SELECT * EXCLUDE (hit, chit, depth, run) FROM dr2 WHERE kind <> 'decl' AND NOT"
        " (depth > 0 OR chit OR (hit AND void)))",
    ]


def figure_ctes() -> list[str]:
    matched = "(end_pos IS NOT NULL OR start_pos IS NOT NULL)"
    run = "OVER (PARTITION BY page_id ORDER BY pos)"
    return [
        f"fg0 AS (SELECT *, coalesce(tag = 'figure' AND {matched}, false) AS isf,"
        f" coalesce(tag = 'figcaption' AND {matched}, false) AS isc FROM dropped)",
        f"fg1 AS (SELECT *, sum(CASE WHEN isf THEN CASE WHEN cl THEN -1 ELSE 1 END ELSE 0 END) {run} AS fd,"
        f" sum(CASE WHEN isc THEN CASE WHEN cl THEN -1 ELSE 1 END ELSE 0 END) {run} AS cd,"
        f" sum(CASE WHEN isc AND NOT cl THEN 1 ELSE 0 END) {run} AS cn FROM fg0)",
        f"fg2 AS (SELECT *, max(CASE WHEN isf AND NOT cl AND fd = 1 THEN cn END) {run} AS cb FROM fg1)",
        "fig AS (SELECT page_id, url, pos, kind, cl, void, lvl, start_pos, end_pos,"
        " CASE WHEN isc AND fd > 0 AND cl THEN '</p>' WHEN isc AND fd > 0 THEN '<p>' ELSE tok END AS tok,"
        " CASE WHEN isc AND fd > 0 THEN 'p' ELSE tag END AS tag FROM fg2"
        " WHERE NOT isf AND (fd <= 0 OR ((cd > 0 OR isc) AND coalesce(cn = cb + 1, false))))",
    ]


def href_ctes(src: str, out: str) -> list[str]:
    """``src`` plus the absolute link target of anchors."""
    return [
        f"{out}_a AS (SELECT page_id, pos, url, {unquote(attr_raw('tok', 'href'))} AS hv FROM {src}"
        " WHERE kind = 'tag' AND NOT cl AND tag = 'a')",
        *resolve_ctes(f"{out}_a", "hv", "url", f"{out}_r"),
        f"{out} AS (SELECT s.*, CASE WHEN coalesce(r.hv, '') = '' THEN '' ELSE coalesce(r.resolved, r.hv) END AS href"
        f" FROM {src} s LEFT JOIN {out}_r r USING (page_id, pos))",
    ]


SANITIZED = [*token_ctes(), *pair_ctes(), *drop_ctes(BOILERPLATE), *figure_ctes()]
TOKEN_COLUMNS = "page_id, pos, kind, tag, tok"
STRIPPED = (
    "CASE WHEN kind <> 'tag' THEN tok WHEN cl THEN '</' || tag || '>' WHEN tag = 'a' AND href <> '' THEN "
    "'<a href=\"' || replace(replace(href, '&', '&amp;'), '\"', '&quot;') || '\">' ELSE '<' || tag || '>' END"
)

ORACLES["clean_html"] = chain(
    RICH,
    final="SELECT page_id, "
    + rep(rep(rep("html", K.STYLE_BLOCK), K.STYLESHEET_LINK), K.INLINE_STYLE)
    + " AS html FROM src",
)
ORACLES["extract_route"] = chain(
    FETCHED,
    final="SELECT page_id, CASE WHEN contains(coalesce(content_type, ''), 'text/html') AND length(html) >= 2000 "
          "THEN 'fast' ELSE 'render' END AS route, coalesce(contains(lower(content_type), 'application/pdf'), false) "
          "AS unsupported FROM src",
)
ORACLES["page_status"] = chain(
    FETCHED, final="SELECT page_id, coalesce(nullif(status_code, 0), 200) AS status_code FROM src"
)
ORACLES["page_tokens"] = chain(PLAIN, *token_ctes(), final=f"SELECT {TOKEN_COLUMNS} FROM tok")
ORACLES["element_extents"] = chain(
    RICH, *token_ctes(), *pair_ctes(),
    final="SELECT page_id, pos, tag, end_pos, start_pos FROM pair WHERE kind = 'tag'",
)
ORACLES["drop_boilerplate"] = chain(
    RICH, *token_ctes(), *pair_ctes(), *drop_ctes(BOILERPLATE),
    final=f"SELECT {TOKEN_COLUMNS} FROM dropped",
)
ORACLES["consent_drop"] = chain(
    RICH, *token_ctes(), *pair_ctes(), *drop_ctes(CONSENT),
    final=f"SELECT {TOKEN_COLUMNS} FROM dropped",
)
ORACLES["figure_captions"] = chain(RICH, *SANITIZED, final=f"SELECT {TOKEN_COLUMNS} FROM fig")
ORACLES["unwrap_tags"] = chain(
    RICH, *SANITIZED,
    final=f"SELECT {TOKEN_COLUMNS} FROM fig WHERE kind <> 'tag' OR tag IN {names(K.ALLOWED_TAGS)}",
)
ORACLES["sanitized_html"] = chain(
    RICH, *SANITIZED, *href_ctes("fig", "hr"),
    final=f"SELECT page_id, string_agg({STRIPPED}, '' ORDER BY pos) AS html FROM hr "
          f"WHERE kind <> 'tag' OR tag IN {names(K.ALLOWED_TAGS)} GROUP BY page_id",
)
ORACLES["decode_entities"] = chain(
    RICH, *token_ctes(),
    final=f"SELECT page_id, pos, {decode('tok')} AS text FROM tok WHERE kind = 'text'",
)
_CLASSES = "|".join(K.MAIN_CLASSES)
ORACLES["main_container_flag"] = chain(
    RICH, *token_ctes(),
    final=f"SELECT page_id, bool_or(coalesce(kind = 'tag' AND NOT cl AND (tag IN {names(K.MAIN_TAGS)} OR "
          + has("' ' || trim(" + attr_raw("tok", "class") + ", '\"''') || ' '", rf"[ \t]({_CLASSES})[ \t]")
          + f" OR trim({attr_raw('tok', 'role')}, '\"''') = 'main' OR trim({attr_raw('tok', 'id')}, '\"''') = '{K.MAIN_ID}'),"
          " false)) AS has_main FROM tok GROUP BY page_id",
)

# --- Markdown ----------------------------------------------------------------


def chars(text: str) -> str:
    """SQL for a text that may hold control characters."""
    parts, run = [], ""
    for ch in text:
        if ord(ch) < 32:
            if run:
                parts.append(q(run))
                run = ""
            parts.append(f"chr({ord(ch)})")
        else:
            run += ch
    if run or not parts:
        parts.append(q(run))
    return "(" + " || ".join(parts) + ")"


def repc(expr: str, pattern: str, to: str) -> str:
    """Replacement text with control characters in it."""
    return f"regexp_replace({expr}, {q(pattern)}, {chars(to)}, 'g')"


def collapse(text: str) -> str:
    return rep(text, r"[ \t\r\n\f]+", " ")


def escape(text: str) -> str:
    inner = rep(text, r"([\\*`\[\]_])", r"\\\1")
    head = rep(inner, r"^(-|\+ |=+|#{1,6} |~~~|>)", r"\\\1")
    return rep(head, r"^([0-9]+)\. ", r"\1\\. ")


def normalized(text: str) -> str:
    tight = rep(rep(f"replace({text}, chr(13) || chr(10), chr(10))", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return rep(tight, r"^[\s\x{a0}]+|[\s\x{a0}]+$")


def truncated(text: str, n: int) -> str:
    return (
        f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || {chars(K.TRUNCATION_MARK)} ELSE {text} END"
    )


def rule_case(side: int) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {chars(r[side])}" for t, r in K.INLINE_RULES.items())
    return f"CASE tag {arms} ELSE '' END"


CONTEXT = (
    "opener quote_depth quote_root list_depth list_root item_pos item_no list_tag in_pre in_pre_code"
).split()


def annotate_ctes(src: str = "hr") -> list[str]:
    run = "OVER (PARTITION BY page_id ORDER BY pos)"
    lst = "OVER (PARTITION BY page_id, list_depth ORDER BY pos)"
    opened, is_tag = "(kind = 'tag' AND NOT cl)", "kind = 'tag'"

    def depth(*tags: str) -> str:
        return f"sum(CASE WHEN tag IN {names(tags)} AND NOT void THEN CASE WHEN cl THEN -1 ELSE 1 END ELSE 0 END) {run}"

    cell = (
        f"last_value(CASE WHEN tag IN {names(K.CELL_TAGS)} THEN {opened} WHEN tag IN ('tr', 'table', 'thead', 'tbody', "
        f"'tfoot') THEN false END IGNORE NULLS) {run}"
    )
    row = f"last_value(CASE WHEN tag = 'tr' THEN {opened} WHEN tag = 'table' THEN false END IGNORE NULLS) {run}"
    md_line = f"coalesce({is_tag} AND tag IN {names(K.MARKDOWN_BLOCK_TAGS)} AND NOT in_cell, false)"
    line = f"coalesce({is_tag} AND tag IN {names(K.MARKDOWN_BLOCK_TAGS + K.STRUCTURE_TAGS)} AND NOT in_cell, false)"
    link = (
        f"CASE WHEN cl THEN {chars(K.LINK_CLOSE)} WHEN href <> '' THEN {chars(K.LINK_OPEN)} || href || "
        f"{chars(K.LINK_MID)} ELSE '' END"
    )
    return [
        f"an1 AS (SELECT *, CASE WHEN kind = 'text' THEN {rep(decode('tok'), K.CONTROL_CHARS)} END AS raw,"
        f" coalesce({cell}, false) AS in_cell, coalesce({row}, false) AS in_row, {depth('blockquote')} AS dq,"
        f" {depth('ul', 'ol')} AS dl, {depth('pre')} AS dp, {depth('code')} AS dc FROM {src})",
        f"an2 AS (SELECT *, {md_line} AS md_line, {line} AS line, greatest(dl, 0) AS list_depth,"
        f" greatest(dq, 0) AS quote_depth, dp > 0 AS in_pre, dp > 0 AND dc > 0 AS in_pre_code,"
        f" CASE WHEN dp > 0 THEN raw ELSE {collapse('raw')} END AS plain FROM an1)",
        f"an3 AS (SELECT *, 2 * sum(line::INT) {run} - line::INT AS rb, 2 * sum(md_line::INT) {run} - md_line::INT AS mb,"
        f" last_value(CASE WHEN md_line THEN CASE WHEN cl THEN '' ELSE tag END END IGNORE NULLS) {run} AS opener,"
        f" sum(CASE WHEN tag = 'blockquote' AND {opened} AND dq = 1 THEN 1 ELSE 0 END) {run} AS quote_root,"
        f" sum(CASE WHEN tag IN ('ul', 'ol') AND {opened} AND dl = 1 THEN 1 ELSE 0 END) {run} AS list_root,"
        f" sum(CASE WHEN tag = 'li' AND {opened} THEN 1 ELSE 0 END) {lst} AS li,"
        f" last_value(CASE WHEN tag = 'li' AND {opened} THEN pos END IGNORE NULLS) {lst} AS item_pos,"
        f" in_row AND NOT in_cell AND NOT {has('plain', '[^ ]')} AS between_cells FROM an2)",
        f"an4 AS (SELECT *, last_value(CASE WHEN tag IN ('ul', 'ol') AND {opened} THEN li END IGNORE NULLS) {lst} AS li0,"
        f" last_value(CASE WHEN tag IN ('ul', 'ol') AND {opened} THEN tag END IGNORE NULLS) {lst} AS list_tag,"
        f" CASE WHEN kind = 'text' THEN CASE WHEN between_cells THEN '' WHEN dc > 0 THEN plain ELSE {escape('plain')} END"
        f" WHEN tag = 'hr' THEN {q(K.RULE_TEXT)} WHEN tag = 'a' THEN {link} WHEN dp > 0 AND tag = 'code' THEN ''"
        f" WHEN {is_tag} AND in_cell AND tag IN {names(K.MARKDOWN_BLOCK_TAGS)} THEN {chars(K.BREAK)}"
        f" WHEN cl THEN {rule_case(1)} ELSE {rule_case(0)} END AS piece,"
        f" CASE WHEN kind = 'text' AND NOT between_cells THEN length(trim({collapse('plain')}, ' ')) ELSE 0 END AS txt_len,"
        " CASE WHEN kind = 'text' THEN length(raw) - length(replace(raw, ',', '')) ELSE 0 END AS commas,"
        f" CASE WHEN kind = 'text' OR tag IN {names(K.ALLOWED_TAGS)} THEN {STRIPPED} ELSE '' END AS html_piece FROM an3)",
        "ann AS (SELECT *, li - li0 AS item_no FROM an4)",
    ]


def run_ctes() -> list[str]:
    box = f"line AND tag IN {names(K.CONTAINER_TAGS)}"
    keep = ", ".join(f"max({c}) AS {c}" for c in CONTEXT)
    return [
        "runs AS (SELECT page_id, rb, max(mb) AS mb, string_agg(piece, '' ORDER BY pos) AS text,"
        " string_agg(html_piece, '' ORDER BY pos) AS html, sum(txt_len) AS txt_len, sum(commas) AS commas,"
        f" max(CASE WHEN {box} AND end_pos IS NOT NULL THEN 1 ELSE 0 END) AS up,"
        f" max(CASE WHEN {box} AND start_pos IS NOT NULL THEN 1 ELSE 0 END) AS down, {keep}"
        " FROM ann GROUP BY page_id, rb)",
    ]


def main_ctes() -> list[str]:
    """The winner by joining runs with the containers around them."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(K.ANCESTOR_WEIGHTS))
    return [
        "mc0 AS (SELECT *, sum(up - down) OVER (PARTITION BY page_id ORDER BY rb) AS deep FROM runs)",
        "boxes AS (SELECT page_id, rb AS b, deep AS lv, (SELECT min(x.rb) FROM mc0 x WHERE x.page_id = o.page_id AND"
        " x.rb > o.rb AND x.down = 1 AND x.deep = o.deep - 1) AS e FROM mc0 o WHERE up = 1)",
        "inside AS (SELECT r.page_id, b, e, deep - lv AS dist, txt_len,"
        " 1 + commas + least(txt_len // 100, 3) AS pts FROM mc0 r JOIN boxes x ON r.page_id = x.page_id AND"
        " r.rb > x.b AND (x.e IS NULL OR r.rb < x.e) WHERE txt_len > 0)",
        f"totals AS (SELECT page_id, b, e, sum(pts * CASE dist {weights} ELSE 0 END) AS score, sum(txt_len) AS n"
        " FROM inside GROUP BY page_id, b, e)",
        f"best AS (SELECT page_id, b, e, score FROM totals WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id"
        f" ORDER BY CASE WHEN n >= {K.FIRST_PASS_CHARS} THEN 2 WHEN n >= {K.SECOND_PASS_CHARS} THEN 1 ELSE 0 END DESC,"
        " score DESC, b DESC) = 1)",
        "body AS (SELECT r.*, w.b IS NOT NULL AS found FROM runs r LEFT JOIN best w ON r.page_id = w.page_id"
        " WHERE w.b IS NULL OR r.rb BETWEEN w.b AND w.e)",
    ]


def inline_sql(text: str) -> str:
    t = rep(text, r"\x04([^\x04\x05`]*)\x05?", r"`\1`")
    t = rep(t, r"\x04([^\x04\x05]*)\x05?", r"`` \1 ``")
    t = rep(t, r"\x05")
    for o, c, oc, cc, mark in (
        (r"\x10", r"\x11", K.EM_OPEN, K.EM_CLOSE, "*"),
        (r"\x0e", r"\x0f", K.STRONG_OPEN, K.STRONG_CLOSE, "**"),
    ):
        t = repc(t, f"{o}([^{o}{c}]*)(?:{c}|$)", f"{oc}\\1{cc}")
        t = repc(t, f"{o}([ \\x03]*){c}", r"\1")
        t = repc(t, f"{o}([ \\x03]+)", f"\\1{oc}")
        t = repc(t, f"([ \\x03]+){c}", f"{cc}\\1")
        t = repc(t, f"{o}([^{o}{c}]*){c}", f"{mark}\\1{mark}")
        t = rep(t, f"[{o}{c}]")
    t = rep(t, r"\x12([^\x12\x15]*)\x15([^\x12\x13]*)(?:\x13|$)", r"[\2](\1)")
    return rep(rep(t, r"\x12[^\x15]*\x15|\x13"), "  +", " ")


def row_sql(text: str) -> str:
    t = rep(text, r"[\n\x03]+", " ")
    t = repc(t, r"\x01([^\x01\x02]*)\x02?", "\x01\\1\x02")
    t = repc(t, r"\x01 +", "\x01")
    t = repc(t, r" +\x02", "\x02")
    t = f"replace({t}, {chars(K.CELL_OPEN + K.CELL_CLOSE)}, {chars(K.CELL_OPEN + ' ' + K.CELL_CLOSE)})"
    return f"replace(replace({t}, chr(1), ' '), chr(2), ' |')"


def block_ctes(src: str) -> list[str]:
    keep = ", ".join(f"max({c}) AS {c}" for c in CONTEXT)
    nl = "chr(10)"
    listed = "list_depth > 0 AND item_pos IS NOT NULL"
    page = "PARTITION BY page_id ORDER BY mb"
    return [
        f"bl1 AS (SELECT page_id, mb, string_agg(text, '' ORDER BY rb) AS text, string_agg(html, '' ORDER BY rb) AS html,"
        f" {keep} FROM {src} GROUP BY page_id, mb)",
        "bl2 AS (SELECT *, CASE WHEN in_pre THEN text ELSE trim("
        + repc(rep("text", " +", " "), r" *\x03 *", "\x03")
        + f", ' ') END AS flat FROM bl1 WHERE {has('text', '[^ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 'f' + chr(92) + 'x02-' + chr(92) + 'x11' + chr(92) + 'x13-' + chr(92) + 'x1f]')})",
        f"bl3 AS (SELECT *, CASE WHEN {has('flat', '[' + chr(92) + 'x04' + chr(92) + 'x05' + chr(92) + 'x0e-' + chr(92) + 'x15]')} THEN {inline_sql('flat')} ELSE flat END AS inl FROM bl2)",
        f"bl4 AS (SELECT *, CASE WHEN in_pre_code THEN '```' || {nl} || " + rep("inl", r"^\n|\n$")
        + f" || {nl} || '```' WHEN in_pre THEN " + rep("inl", r"^\n+|\n+$")
        + f" WHEN contains(inl, chr(1)) THEN {row_sql('inl')} ELSE "
        + rep("replace(inl, chr(3), '  ' || chr(10))", r"^[ \n]+|[ \n]+$") + " END AS part FROM bl3)",
        f"bl5 AS (SELECT *, CASE WHEN opener IN {names(K.HEADING_TAGS)} AND part <> '' THEN"
        " repeat('#', CAST(substr(opener, 2, 1) AS INT)) || ' ' || part ELSE part END AS txt,"
        f" {listed} AS listed, {listed} AND row_number() OVER (PARTITION BY page_id, item_pos, {listed} ORDER BY mb) = 1 AS fst,"
        f" lag(mb) OVER ({page}) AS pmb, lag(quote_root) OVER ({page}) AS pqr, lag(quote_depth) OVER ({page}) AS pqd,"
        f" lag(list_root) OVER ({page}) AS plr, lag(list_depth) OVER ({page}) AS pld FROM bl4)",
        "bl6 AS (SELECT *, repeat('> ', quote_depth::INT) AS qp,"
        f" repeat(' ', ({K.LIST_INDENT} * CASE WHEN listed THEN list_depth ELSE 0 END)::INT) AS ind,"
        f" CASE WHEN fst THEN repeat(' ', ({K.LIST_INDENT} * (list_depth - 1))::INT) || CASE WHEN list_tag = 'ol' THEN"
        f" CAST(item_no AS VARCHAR) || '.  ' ELSE {q(K.BULLET)} END"
        f" ELSE repeat(' ', ({K.LIST_INDENT} * CASE WHEN listed THEN list_depth ELSE 0 END)::INT) END AS lead_in FROM bl5)",
        "blocks AS (SELECT page_id, mb, opener, inl, CASE WHEN pmb IS NULL THEN '' WHEN fst AND plr = list_root AND pld > 0"
        " THEN chr(10) WHEN pqr = quote_root AND pqd > 0 AND quote_depth > 0 THEN chr(10) ||"
        " rtrim(repeat('> ', least(pqd, quote_depth)::INT), ' ') || chr(10) ELSE chr(10) || chr(10) END AS gap,"
        " qp || lead_in || replace(txt, chr(10), chr(10) || qp || ind) AS block FROM bl6)",
        "joined AS (SELECT page_id, string_agg(gap || block, '' ORDER BY mb) AS md FROM blocks GROUP BY page_id)",
    ]


_TO_RUNS = [*SANITIZED, *href_ctes("fig", "hr"), *annotate_ctes(), *run_ctes()]
ORACLES["markdown_blocks"] = chain(
    RICH, *_TO_RUNS, *block_ctes("runs"), final="SELECT page_id, mb::BIGINT AS mb, gap, block FROM blocks"
)
ORACLES["table_cells"] = chain(
    RICH, *_TO_RUNS, *block_ctes("runs"),
    final="SELECT page_id, mb::BIGINT AS mb, block AS row_text FROM blocks WHERE opener = 'tr'",
)
ORACLES["full_page_markdown"] = chain(
    RICH, *_TO_RUNS, *block_ctes("runs"),
    final=f"SELECT page_id, coalesce({normalized('md')}, '') AS markdown FROM src LEFT JOIN joined USING (page_id)",
)
_NOISY = r"(' ' || chr(10) || replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(9) || chr(10)) || ' ' || chr(10))"
ORACLES["normalize_md"] = f"SELECT doc_id, {normalized(_NOISY)} AS md FROM documents"
ORACLES["md_escape"] = f"SELECT doc_id, {escape('text')} AS md FROM documents"
ORACLES["truncate_md"] = f"SELECT doc_id, {truncated('text', 500)} AS md FROM documents"
ORACLES["main_content"] = chain(
    RICH, *_TO_RUNS, *main_ctes(),
    final="SELECT b.page_id, max(w.b)::BIGINT AS main_start, max(w.score)::BIGINT AS main_score,"
          " count(CASE WHEN txt_len > 0 THEN 1 END) AS n_runs, sum(txt_len)::BIGINT AS n_chars"
          " FROM body b JOIN best w ON w.page_id = b.page_id GROUP BY b.page_id",
)
_PAGE_MD = [*_TO_RUNS, *main_ctes(), *block_ctes("body")]
ORACLES["page_markdown"] = chain(
    RICH, *_PAGE_MD,
    final=f"SELECT page_id, coalesce({normalized('md')}, '') AS markdown FROM src LEFT JOIN joined USING (page_id)",
)
ORACLES["extract_full_pages"] = ORACLES["full_page_markdown"]

# --- metadata ----------------------------------------------------------------


def tag_ctes(name: str, out: str) -> list[str]:
    return [f"{out} AS (SELECT x.page_id, s.url, x.t, x.i FROM lx x JOIN src s ON s.page_id = x.page_id WHERE x.n = {q(name)} AND NOT x.c)"]


def link_ctes() -> list[str]:
    return [
        *tag_ctes("a", "anc"),
        f"lk0 AS (SELECT page_id, url, i, {unquote(attr_raw('t', 'href'))} AS hv FROM anc WHERE {attr_raw('t', 'href')} <> '')",
        *resolve_ctes("lk0", "hv", "url", "lk1"),
        "lk2 AS (SELECT page_id, resolved AS link, min(i) AS i FROM lk1 WHERE regexp_matches(resolved, '^https?:')"
        " GROUP BY page_id, resolved)",
        "edges AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS link_pos, link FROM lk2)",
        "linked AS (SELECT page_id, string_agg(link, '|' ORDER BY link_pos) AS links FROM edges GROUP BY page_id)",
    ]


def meta_ctes() -> list[str]:
    def attr(name: str) -> str:
        return unquote(attr_raw("t", name))

    optional = ", ".join(
        f"max(CASE WHEN key = {q(k)} THEN content END) AS {q(n).replace(chr(39), chr(34))}" for n, k in
        {**K.OPTIONAL_META, "_ogt": "og:title", "_ogd": "og:description", "_dsc": "description", "_ogl": "og:locale"}.items()
    )
    return [
        *tag_ctes("meta", "mt"),
        f"me0 AS (SELECT page_id, i, {attr('name')} AS a, {attr('property')} AS b, {attr('itemprop')} AS c,"
        f" {attr('content')} AS content FROM mt)",
        "me1 AS (SELECT page_id, i, lower(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END) AS key, content FROM me0)",
        "meta AS (SELECT page_id, key, max_by(content, i) AS content FROM me1 WHERE key <> '' AND content <> ''"
        " GROUP BY page_id, key)",
        f"wide AS (SELECT page_id, {optional} FROM meta GROUP BY page_id)",
        *tag_ctes("link", "lt"),
        f"le0 AS (SELECT page_id, url, i, lower({attr('rel')}) AS rel, {attr('href')} AS hv FROM lt)",
        "canon AS (SELECT page_id, nullif(min_by(hv, i), '') AS can FROM le0 WHERE rel = 'canonical' GROUP BY page_id)",
        f"ic0 AS (SELECT page_id, url, min_by(hv, i) AS hv FROM le0 WHERE rel IN {names(K.ICON_RELS)} GROUP BY page_id, url)",
        *resolve_ctes("ic0", "hv", "url", "ic1"),
        "icon AS (SELECT page_id, CASE WHEN hv <> '' THEN coalesce(resolved, hv) END AS ico FROM ic1)",
        "first_title AS (SELECT page_id, min(i) AS i FROM lx WHERE n = 'title' AND NOT c GROUP BY page_id)",
        "title AS (SELECT f.page_id, x.t FROM first_title f JOIN lx x ON x.page_id = f.page_id AND x.i = f.i + 1 AND x.n IS NULL)",
        "root AS (SELECT page_id, min_by(t, i) AS root FROM lx WHERE n = 'html' AND NOT c GROUP BY page_id)",
        f"hd AS (SELECT src.*, trim({collapse(decode("coalesce(title.t, '')"))}, ' ') AS ttl,"
        f" {unquote(attr_raw("coalesce(root, '')", 'lang'))} AS lang FROM src LEFT JOIN title USING (page_id) LEFT JOIN root USING (page_id))",
        "allmeta AS (SELECT * FROM hd LEFT JOIN wide USING (page_id) LEFT JOIN canon USING (page_id)"
        " LEFT JOIN icon USING (page_id))",
    ]


_META_COLUMNS = (
    "coalesce(_ogt, nullif(ttl, ''), '') AS title, coalesce(_ogd, _dsc, {excerpt}'') AS description,"
    " coalesce(nullif(lang, ''), _ogl, '') AS language, url AS \"sourceURL\","
    " coalesce(nullif(status_code, 0), 200) AS \"statusCode\", "
    + ", ".join(f'"{n}"' for n in K.OPTIONAL_META)
    + ', can AS "canonicalURL", ico AS favicon'
)
ORACLES["page_links"] = chain(PLAIN, *lexeme_ctes(), *link_ctes(), final="SELECT page_id, link_pos, link FROM edges")
ORACLES["rich_page_links"] = chain(RICH, *lexeme_ctes(), *link_ctes(), final="SELECT page_id, link_pos, link FROM edges")
ORACLES["meta_map"] = chain(RICH, *lexeme_ctes(), *meta_ctes(), final="SELECT page_id, key, content FROM meta")
ORACLES["page_metadata"] = chain(
    FETCHED, *lexeme_ctes(), *meta_ctes(),
    final=f"SELECT page_id, {_META_COLUMNS.format(excerpt='')} FROM allmeta",
)
ORACLES["canonical_favicon"] = chain(
    RICH, *lexeme_ctes(), *meta_ctes(), final='SELECT page_id, can AS "canonicalURL", ico AS favicon FROM allmeta'
)
_PLAIN_P = rep(
    rep(
        rep(rep(rep("inl", r"\[([^\[\]]*)\]\([^)]*\)", r"\1"), r"(^|[^\\])[*`]+", r"\1"), r"[\x01-\x05\x0e-\x15]", " "),
        r"\\(.)", r"\1",
    ),
    " +", " ",
)
_EXCERPT = (
    f"exc AS (SELECT page_id, min_by(trim({_PLAIN_P}, ' '), mb) AS ex FROM blocks WHERE opener = 'p' GROUP BY page_id)"
)
_HTML_OUT = "hout AS (SELECT page_id, string_agg(html, '' ORDER BY rb) AS html_out FROM body GROUP BY page_id)"
ORACLES["extract_pages"] = chain(
    FETCHED, *_PAGE_MD, *meta_ctes(), *link_ctes(), _EXCERPT, _HTML_OUT,
    final=f"SELECT page_id, url, coalesce({normalized('md')}, '') AS markdown, coalesce(html_out, '') AS html,"
          f" html AS \"rawHtml\", coalesce(links, '') AS links, {_META_COLUMNS.format(excerpt='ex, ')}"
          " FROM allmeta LEFT JOIN joined USING (page_id) LEFT JOIN linked USING (page_id)"
          " LEFT JOIN exc USING (page_id) LEFT JOIN hout USING (page_id)"
          " WHERE NOT coalesce(contains(lower(content_type), 'application/pdf'), false)",
)
ORACLES["extraction_errors"] = chain(
    FETCHED,
    final="SELECT page_id, url, 'Unsupported content-type: application/pdf' AS detail FROM src "
          "WHERE contains(lower(content_type), 'application/pdf')",
)
ORACLES["select_formats"] = chain(
    PLAIN, *_PAGE_MD, *link_ctes(),
    final=f"SELECT page_id, coalesce({normalized('md')}, '') AS markdown, CASE WHEN page_id % 2 = 1 THEN html END AS \"rawHtml\","
          " CASE WHEN page_id % 2 = 0 THEN coalesce(links, '') END AS links FROM src LEFT JOIN joined USING (page_id)"
          " LEFT JOIN linked USING (page_id)",
)


def json_text(expr: str) -> str:
    return f"to_json({expr})::VARCHAR"


def _json_fields() -> str:
    """The metadata as JSON members in order, null ones left out."""
    columns = ["title", "description", "language", "sourceURL", "statusCode", *K.OPTIONAL_META, "canonicalURL", "favicon"]
    members = ", ".join(
        f"CASE WHEN \"{c}\" IS NOT NULL THEN '\"{c}\":' || " + json_text(f'"{c}"') + " END" for c in columns
    )
    return f"array_to_string(list_filter([{members}], lambda m: m IS NOT NULL), ',')"


ORACLES["response_json"] = chain(
    RICH, *lexeme_ctes(), *meta_ctes(),
    final=f"SELECT page_id, '{{\"success\":true,\"data\":{{' || {_json_fields()} || '}}}}' AS response FROM"
          f" (SELECT page_id, {_META_COLUMNS.format(excerpt='').replace('nullif(status_code, 0)', 'NULL::INT')} FROM allmeta) m",
)

# --- search ------------------------------------------------------------------

QUERIES = f"queries AS ({I.duck(I.QUERIES)})"
_RESPONSE_HITS = [
    PLAIN, *lexeme_ctes(), *link_ctes(),
    "rh AS (SELECT page_id AS query_id, link_pos AS src_pos, CASE WHEN link_pos % 3 > 0 THEN 'link ' || link_pos END AS title,"
    " link AS url, 'google' AS engine, CASE WHEN link_pos % 2 = 0 THEN 'brave|arxiv' END AS engines,"
    " CASE WHEN link_pos <> 1 THEN link_pos / 2.0::DOUBLE END AS score FROM edges WHERE page_id % 5 <> 0)",
]
ORACLES["read_hits"] = chain(
    *_RESPONSE_HITS,
    final="SELECT query_id, src_pos, title, url, engine, engines, score::DOUBLE AS score FROM rh",
)
ORACLES["read_requests"] = (
    "SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'html|links' ELSE 'markdown' END AS formats, "
    "page_id % 4 <> 0 AS only_main FROM pages"
)
ORACLES["read_search_requests"] = chain(
    QUERIES,
    final="SELECT query_id, query, limit_raw, array_to_string(sources, '|') AS sources, '' AS formats, "
          "true AS only_main FROM queries",
)
ORACLES["validate_query"] = chain(
    QUERIES,
    final="SELECT query_id, CASE WHEN coalesce(query, '') = '' THEN 400 WHEN trim(query) = '' THEN 500 ELSE 200 END "
          "AS code FROM queries",
)
_LIMIT = (
    "CASE WHEN TRY_CAST(nullif(trim(limit_raw), '') AS DOUBLE) > 0 THEN "
    "CAST(least(floor(TRY_CAST(limit_raw AS DOUBLE)), 20) AS INTEGER) ELSE 10 END"
)
ORACLES["coerce_limit"] = chain(QUERIES, final=f"SELECT query_id, {_LIMIT} AS result_limit FROM queries")
ORACLES["requested_engines"] = chain(
    QUERIES,
    final="SELECT query_id, coalesce(array_to_string(list_filter(sources, lambda s: s <> 'web'), '|'), '') AS engines "
          "FROM queries",
)
ORACLES["effective_query"] = chain(
    QUERIES,
    final="SELECT query_id, CASE WHEN len(domains) > 0 THEN query || ' (' || array_to_string("
          "list_transform(domains, lambda d: 'site:' || d), ' OR ') || ')' ELSE query END AS effective FROM queries",
)
NORMAL = [
    HITS,
    "nh AS (SELECT query_id, src_pos, coalesce(title, '') AS title, coalesce(url, '') AS url,"
    " coalesce(content, '') AS snippet,"
    " CASE WHEN engines IS NOT NULL THEN array_to_string(engines, '|') ELSE coalesce(engine, '') END AS engines,"
    " coalesce(score, 0) AS score, \"publishedDate\","
    " CASE WHEN coalesce(category, '') = '' THEN 'general' ELSE category END AS category FROM hits)",
]
SHOWN = "query_id, src_pos, url, score"
ORACLES["normalize_hits"] = chain(*NORMAL, final="SELECT * FROM nh")
_ENABLED = [n for n, off, _ in K.ENGINE_SETTINGS if not off]
ORACLES["engine_filter"] = chain(
    *NORMAL,
    final=f"SELECT {SHOWN} FROM nh WHERE len(list_filter(string_split(engines, '|'), lambda e: e IN {names(_ENABLED)})) > 0",
)
ORACLES["hit_filter"] = chain(
    *NORMAL,
    final=f"SELECT {SHOWN} FROM nh WHERE len(list_filter(string_split(engines, '|'), lambda e: e IN ('google', 'brave'))) > 0 "
          "AND category = 'general' AND \"publishedDate\" >= '2024-01-10'",
)
_NH_HOST = [*NORMAL, *with_host("nh", "w")]


def domain_test(domains: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM ({I.duck(domains)}) d WHERE whost = lower(d.domain) "
        "OR ends_with(whost, '.' || lower(d.domain)))"
    )


ORACLES["include_domains"] = chain(
    *_NH_HOST, final=f"SELECT {SHOWN} FROM w WHERE {domain_test(I.DOMAINS_INCLUDED)}"
)
ORACLES["exclude_domains"] = chain(
    *_NH_HOST, final=f"SELECT {SHOWN} FROM w WHERE NOT {domain_test(I.DOMAINS_EXCLUDED)}"
)


def dedup_cte(src: str, out: str) -> str:
    return (
        f"{out} AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY query_id, "
        "lower(regexp_replace(url, '/$', '')) ORDER BY src_pos) = 1)"
    )


ORACLES["dedup_hits"] = chain(*NORMAL, dedup_cte("nh", "dd"), final=f"SELECT {SHOWN} FROM dd")
ORACLES["hit_paging"] = chain(
    *NORMAL,
    final=f"SELECT {SHOWN} FROM nh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY src_pos) BETWEEN 11 AND 20",
)
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_pos) AS INTEGER)"
TOP = [
    *_NH_HOST,
    f"kept AS (SELECT * FROM w WHERE NOT {domain_test(I.DOMAINS_EXCLUDED)})",
    dedup_cte("kept", "dd"),
    f"top AS (SELECT * FROM (SELECT *, {_RANK} AS rnk FROM dd) WHERE rnk <= 10)",
]
ORACLES["top_hits"] = chain(*TOP, final="SELECT query_id, rnk AS position, src_pos, url, score FROM top")
ORACLES["top_hits_per_limit"] = chain(
    *NORMAL, QUERIES, dedup_cte("nh", "dd"), f"lim AS (SELECT query_id, {_LIMIT} AS n FROM queries)",
    final=f"SELECT query_id, rnk AS position, src_pos, url, score FROM (SELECT *, {_RANK} AS rnk FROM dd JOIN lim "
          "USING (query_id)) WHERE rnk <= n",
)
WEB = [*TOP, "web AS (SELECT query_id, rnk AS position, url, title, snippet AS description, 'web' AS category FROM top)"]
ORACLES["web_results"] = chain(*WEB, final="SELECT * FROM web")
ORACLES["search_meta"] = chain(
    *_RESPONSE_HITS, dedup_cte("rh", "dd"),
    "cnt AS (SELECT query_id, least(count(*), 3) AS n FROM dd GROUP BY query_id)",
    final="SELECT page_id AS query_id, 'q' || page_id AS query, 'q' || page_id AS effective_query, "
          "CAST(coalesce(CASE WHEN page_id % 3 = 0 THEN page_id * 10 END, n, 0) AS BIGINT) AS total_results, "
          "CASE WHEN page_id % 2 = 0 THEN 'more|less' ELSE '' END AS suggestions, '' AS answers, 0 AS n_unresponsive "
          "FROM pages LEFT JOIN cnt ON query_id = page_id",
)
# pages are read as the source of the extraction part, hits as the other
_EXTRACTED = [
    PLAIN, *_PAGE_MD, *link_ctes(),
    f"ext AS (SELECT page_id, url AS page_url, coalesce({normalized('md')}, '') AS markdown, coalesce(links, '') AS links"
    " FROM src LEFT JOIN joined USING (page_id) LEFT JOIN linked USING (page_id))",
]
_SEARCHED = [
    *_EXTRACTED, *WEB,
    *with_host("web", "wh"),
    f"wr AS (SELECT query_id, position, url, title, description, category, {REASON} AS reason FROM wh)",
    "found AS (SELECT wr.* EXCLUDE (reason), nullif(markdown, '') AS markdown, links FROM wr"
    " LEFT JOIN ext ON page_url = url AND reason IS NULL)",
]
ORACLES["search_and_extract"] = chain(*_SEARCHED, final="SELECT * FROM found")
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def pack_sql(src: str, entry: str, sep: str) -> str:
    return f"SELECT query_id, string_agg({entry}, {sep} ORDER BY position) AS context FROM {src} GROUP BY query_id"


ORACLES["context_pack"] = chain(
    *_SEARCHED,
    final=pack_sql(
        "found",
        "'**' || title || '** (' || url || ')' || chr(10) || chr(10) || coalesce(markdown, description, '')",
        _SEP,
    ),
)
ORACLES["context_pack_heading"] = chain(
    *WEB,
    final=pack_sql("web", "'# ' || title || chr(10) || url || chr(10) || chr(10) || description", _SEP),
)
ORACLES["context_pack_plain"] = chain(
    *WEB, final=pack_sql("web", "title || chr(10) || description", "chr(10) || chr(10)")
)
ORACLES["corpus_hits"] = chain(
    "dt AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents)",
    "qt AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM benchmark)",
    "dc AS (SELECT doc_id, term, count(*) AS n FROM dt WHERE term <> '' GROUP BY ALL)",
    "sc AS (SELECT item_id, doc_id, CAST(sum(n) AS BIGINT) AS score FROM dc JOIN qt USING (term) GROUP BY item_id, doc_id)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc)",
    final="SELECT item_id AS query_id, doc_id, score, substr(text, 1, 160) AS snippet FROM rk JOIN documents USING (doc_id) "
          "WHERE r <= 10",
)

# --- requests and store ------------------------------------------------------

REQUESTS = f"req AS ({I.duck(I.REQUESTS)})"
ORACLES["scrape_outcome"] = chain(
    FETCHED, REQUESTS, *with_host("req", "w"),
    f"r AS (SELECT request_id, url, {REASON} AS reason FROM w)",
    "f AS (SELECT DISTINCT url AS furl FROM src WHERE contains(lower(content_type), 'application/pdf'))",
    final="SELECT request_id, url, CASE WHEN coalesce(url, '') = '' THEN 400 WHEN reason IS NOT NULL THEN 422 "
          "WHEN furl IS NOT NULL THEN 500 ELSE 200 END AS code, CASE WHEN coalesce(url, '') = '' THEN "
          "'Missing URL in request body.' WHEN reason IS NOT NULL THEN 'blocked_url' WHEN furl IS NOT NULL THEN "
          "'extraction_failed' END AS error, CASE WHEN coalesce(url, '') = '' THEN NULL WHEN reason IS NOT NULL THEN reason "
          "WHEN furl IS NOT NULL THEN 'Unsupported content-type: application/pdf' END AS detail "
          "FROM r LEFT JOIN f ON furl = url",
)
STORED = f"st AS (SELECT *, {key_expr('url')} AS cache_key FROM ({I.duck(I.STORE)}))"
ORACLES["extract_batch"] = chain(
    *_EXTRACTED, REQUESTS, *with_host("req", "w"), STORED,
    f"r AS (SELECT request_id, url, {REASON} AS reason FROM w)",
    "fr AS (SELECT url AS surl, value FROM st WHERE age_minutes <= 60)",
    final="SELECT request_id, url, reason, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN surl IS NOT NULL THEN 'store' "
          "WHEN page_url IS NOT NULL THEN 'extracted' ELSE 'missing' END AS source, CASE WHEN reason IS NULL THEN "
          "coalesce(value, markdown) END AS content FROM r LEFT JOIN fr ON surl = url LEFT JOIN ext ON page_url = url",
)
ORACLES["store_upsert"] = chain(
    STORED,
    final="SELECT cache_key, url, CASE WHEN page_id % 2 = 0 THEN value ELSE 'new' || page_id END AS value FROM st",
)
ORACLES["store_versions"] = chain(
    STORED,
    final="SELECT 1 AS version, cache_key, url, value FROM st UNION ALL SELECT 2, cache_key, url, "
          "CASE WHEN page_id % 2 = 0 THEN value ELSE 'new' || page_id END FROM st",
)
ORACLES["store_fresh"] = chain(STORED, final="SELECT cache_key, value FROM st WHERE age_minutes <= 60")
ORACLES["store_retain"] = chain(
    STORED, final="SELECT cache_key, value FROM st ORDER BY age_minutes, cache_key LIMIT 100"
)
ORACLES["store_retain_half"] = chain(
    STORED,
    final="SELECT cache_key FROM st ORDER BY CASE WHEN page_id % 3 > 0 THEN age_minutes END NULLS LAST, cache_key "
          "LIMIT (SELECT count(*) // 2 FROM pages)",
)
# one step per miss: the next one is the first request after the time to live
ORACLES["ttl_hits"] = chain(
    "lg AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type <> 'error')",
    "ms AS (SELECT user_id, min(t) AS t FROM lg GROUP BY user_id UNION ALL "
    "SELECT m.user_id, (SELECT min(x.t) FROM lg x WHERE x.user_id = m.user_id AND x.t > m.t + 86400000) AS t "
    "FROM ms m WHERE m.t IS NOT NULL)",
    "fs AS (SELECT min(event_id) AS event_id FROM lg JOIN ms ON lg.user_id = ms.user_id AND lg.t = ms.t "
    "GROUP BY lg.user_id, lg.t)",
    final="SELECT event_id AS request_id, user_id AS cache_key, event_id IN (SELECT event_id FROM fs) AS is_miss FROM lg",
)
ORACLES["stream_ttl_exact"] = ORACLES["ttl_hits"]

# --- metrics and streaming ---------------------------------------------------

LOG = f"lg AS ({I.duck(I.REQUEST_LOG)})"
_BUCKETS = ", ".join(
    f"count(CASE WHEN duration_s <= {b} THEN 1 END) AS le_{f'{b:g}'.replace('.', '_')}" for b in K.DURATION_BUCKETS
)
ORACLES["duration_histogram"] = chain(
    LOG,
    final=f"SELECT method, route, code, {_BUCKETS}, round(sum(duration_s), 4) AS duration_sum, "
          "count(duration_s) AS duration_count FROM lg GROUP BY method, route, code",
)
ORACLES["run_summary"] = chain(
    LOG,
    final="SELECT count(*) AS total, count(CASE WHEN code = 200 THEN 1 END) AS ok, count(CASE WHEN code <> 200 THEN 1 END) "
          "AS failed, (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000.0::DOUBLE AS elapsed_s, "
          "round(count(*) / ((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000.0::DOUBLE), 9) AS rate FROM lg",
)
ORACLES["health_rollup"] = chain(
    f"ck AS ({I.duck(I.CHECKS)})",
    final="SELECT run_id, CASE WHEN bool_and(status = 'ok') THEN 'healthy' ELSE 'degraded' END AS status, "
          "CASE WHEN bool_and(status = 'ok') THEN 200 ELSE 503 END AS code, count(*) AS checks FROM ck GROUP BY run_id",
)
ORACLES["round_robin"] = (
    "SELECT event_id + 1 AS item, (['alpha', 'beta', 'gamma', 'delta', 'epsilon'])[(event_id + 1) % 5 + 1] AS target FROM events"
)
_NO_STATUS = _META_COLUMNS.replace("nullif(status_code, 0)", "NULL::INT")
ORACLES["stream_extract"] = chain(
    PLAIN, *lexeme_ctes(), *link_ctes(), *meta_ctes(),
    final="SELECT page_id, url, CASE WHEN length(html) >= 2000 THEN 'fast' ELSE 'render' END AS route, "
          f"coalesce(links, '') AS links, {_NO_STATUS.format(excerpt='')} FROM allmeta LEFT JOIN linked USING (page_id)",
)
ORACLES["stream_markdown"] = chain(
    PLAIN, *_PAGE_MD, *meta_ctes(), *link_ctes(), _EXCERPT,
    final=f"SELECT page_id, url, coalesce({normalized('md')}, '') AS markdown, coalesce(links, '') AS links,"
          f" {_NO_STATUS.format(excerpt='ex, ')} FROM allmeta LEFT JOIN joined USING (page_id)"
          " LEFT JOIN linked USING (page_id) LEFT JOIN exc USING (page_id)",
)
_ENGINE_LIST = "[" + ", ".join(q(n) for n, _, _ in K.ENGINE_SETTINGS) + "]"
ORACLES["stream_policy"] = chain(
    *with_host("pages", "w"),
    f"r AS (SELECT page_id, ({_ENGINE_LIST})[page_id % {len(K.ENGINE_SETTINGS)} + 1] AS engine, {REASON} AS reason FROM w)",
    final=f"SELECT page_id, engine, reason IS NULL AS ok, reason FROM r WHERE engine IN {names(_ENABLED)}",
)
ORACLES["stream_histogram"] = chain(
    LOG,
    final=f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, method, route, code, {_BUCKETS}, "
          "round(sum(duration_s), 4) AS duration_sum, count(duration_s) AS duration_count FROM lg GROUP BY ALL",
)
ORACLES["stream_arrival_dedup"] = (
    "SELECT DISTINCT user_id AS cache_key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events"
)
