"""Fixed values of the page and search contract.

Everything here must keep its value for results to be right: selector lists,
tag lists, patterns and limits.  Patterns use only syntax that Java regex and
RE2 share (no look-around, no back-references) unless they say otherwise.
"""

# --- URL policy (fixed values) ---------------------------------------------
LOCAL_HOSTS = ["localhost", "ip6-localhost", ""]
LOCAL_SUFFIXES = [".localhost", ".local"]
PRIVATE_SUFFIXES = [
    ".internal", ".intranet", ".home", ".lan", ".corp", ".test", ".example", ".invalid",
]
PRIVATE_NAMES = ["0.0.0.0", "::"]
PRIVATE_V4_NAME_PATTERN = (
    r"^(10\.[0-9]+\.[0-9]+\.[0-9]+"
    r"|192\.168\.[0-9]+\.[0-9]+"
    r"|172\.(1[6-9]|2[0-9]|3[0-1])\.[0-9]+\.[0-9]+)$"
)
# (network, prefix length) of the IPv4 ranges treated as private
PRIVATE_V4_RANGES = [
    ("127.0.0.0", 8),       # loopback
    ("10.0.0.0", 8),        # private
    ("172.16.0.0", 12),
    ("192.168.0.0", 16),
    ("169.254.0.0", 16),    # link local
    ("0.0.0.0", 8),         # unspecified
    ("192.0.0.0", 24),      # reserved
    ("192.0.2.0", 24),
    ("192.88.99.0", 24),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
BROADCAST_V4 = 4294967295   # inside 240/4, yet not a private address

TRACKER_PATTERN = (
    r"(?i)google-analytics|googletagmanager|doubleclick|facebook\.net|fbcdn|analytics"
    r"|hotjar|segment\.io|sentry\.io|newrelic|datadome|cloudflareinsights"
)
BLOCKED_RESOURCE_TYPES = [
    "image", "font", "media", "stylesheet", "texttrack", "eventsource",
    "websocket", "manifest", "other",
]

# --- HTML cleaning and parsing (fixed values) ------------------------------
WS = r"[ \t\r\n\f]"
STYLE_BLOCK = r"(?i)<style[\s\S]*?</style>"
STYLESHEET_LINK = r"""(?i)<link[^>]*rel=["']?stylesheet["']?[^>]*>"""
INLINE_STYLE = r"""(?i)[ \t\r\n\f]style=(?:"[^"]*"|'[^']*')"""
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9:-]*)"

# elements whose content is text up to their own end tag
RAW_TEXT_TAGS = ["script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"]
# tag classes of the HTML standard's tree construction
HEAD_TAGS = ["base", "basefont", "bgsound", "head", "link", "meta", "noscript", "script", "style", "template", "title"]
FORMATTING_TAGS = ["a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"]
SCOPE_TAGS = [
    "applet", "caption", "html", "marquee", "math", "object", "svg", "table", "td", "template", "th",
]
BUTTON_SCOPE = SCOPE_TAGS + ["button"]
MARKER_TAGS = ["applet", "caption", "marquee", "object", "td", "template", "th"]
TABLE_PART_TAGS = ["caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"]
CLOSES_P_TAGS = [
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "search", "section", "summary",
    "table", "ul", "xmp",
]
SPECIAL_TAGS = [
    "address", "applet", "area", "article", "aside", "base", "basefont", "bgsound", "blockquote", "body", "br",
    "button", "caption", "center", "col", "colgroup", "dd", "details", "dir", "div", "dl", "dt", "embed", "fieldset",
    "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "iframe", "img", "input", "keygen", "li", "link", "listing", "main", "marquee",
    "menu", "meta", "nav", "noembed", "noframes", "noscript", "object", "ol", "p", "param", "plaintext", "pre",
    "script", "search", "section", "select", "source", "style", "summary", "table", "tbody", "td", "template",
    "textarea", "tfoot", "th", "thead", "title", "tr", "track", "ul", "wbr", "xmp",
]

FAST_MIN_CHARS = 2000
HTML_TYPE = "text/html"
PDF_TYPE = r"(?i)application/pdf"

VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]
BOILERPLATE_TAGS = [
    "img", "picture", "source", "video", "audio", "iframe", "embed", "object",
    "canvas", "svg", "script", "style", "noscript", "form", "button", "input",
    "select", "textarea", "link", "nav", "header", "footer", "aside",
]
BOILERPLATE_ROLES = ["banner", "navigation", "contentinfo"]
BOILERPLATE_CLASS_PARTS = ["sidebar", "ad-", "advertisement", "social", "share", "related"]
BOILERPLATE_ID_PARTS = ["ad-"]
CONSENT_CLASS_PARTS = ["cookie", "consent", "gdpr"]
CONSENT_ID_PARTS = ["cookie", "consent"]
ALLOWED_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "a",
    "pre", "code", "blockquote", "table", "thead", "tbody", "tfoot",
    "tr", "th", "td", "em", "i", "strong", "b", "hr", "br", "dl", "dt", "dd",
    "sup", "sub", "abbr", "mark", "del", "ins", "details", "summary",
]
MAIN_TAGS = ["article", "main"]
MAIN_CLASSES = ["post-content", "entry-content"]
MAIN_ID = "content"

# tags that start a new line box; the first group survives sanitising
MARKDOWN_BLOCK_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "pre", "blockquote",
    "table", "thead", "tbody", "tfoot", "tr", "hr", "dl", "dt", "dd",
]
CELL_TAGS = ["th", "td"]
CONTAINER_TAGS = ["article", "main", "section", "div", "body"]
STRUCTURE_TAGS = [
    "html", "head", "title", "body", "article", "main", "section", "div", "nav",
    "header", "footer", "aside", "form", "fieldset", "figure", "figcaption",
    "address", "center", "details",
]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

NAMED_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
    ("&pound;", "£"), ("&deg;", "°"), ("&times;", "×"),
    ("&sect;", "§"), ("&para;", "¶"),
    ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"),
    ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"),
    ("&ccedil;", "ç"), ("&ntilde;", "ñ"),
]

# --- Markdown (fixed values) -----------------------------------------------
TRUNCATION_MARK = "\n\n[…truncated]"
BULLET = "-   "
LIST_INDENT = 4
RULE_TEXT = "* * *"

# private marks used between the token stage and the block stage; control
# characters never occur in text because the text stage removes them
CELL_OPEN, CELL_CLOSE = "\x01", "\x02"
BREAK = "\x03"
CODE_OPEN, CODE_CLOSE = "\x04", "\x05"
STRONG_OPEN, STRONG_CLOSE = "\x0e", "\x0f"
EM_OPEN, EM_CLOSE = "\x10", "\x11"
LINK_OPEN, LINK_MID, LINK_CLOSE = "\x12", "\x15", "\x13"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0e-\x1f]"

# tag -> (text written at the open tag, text written at the close tag)
INLINE_RULES = {
    "em": (EM_OPEN, EM_CLOSE),
    "i": (EM_OPEN, EM_CLOSE),
    "strong": (STRONG_OPEN, STRONG_CLOSE),
    "b": (STRONG_OPEN, STRONG_CLOSE),
    "code": (CODE_OPEN, CODE_CLOSE),
    "br": (BREAK, ""),
    "th": (CELL_OPEN, CELL_CLOSE),
    "td": (CELL_OPEN, CELL_CLOSE),
}

# --- Main content scoring --------------------------------------------------
ANCESTOR_WEIGHTS = [60, 30, 10, 6, 5]
FIRST_PASS_CHARS = 500
SECOND_PASS_CHARS = 100

# --- Metadata (fixed values): output field -> meta key ----------------------
OPTIONAL_META = {
    "author": "author",
    "generator": "generator",
    "keywords": "keywords",
    "siteName": "og:site_name",
    "ogType": "og:type",
    "ogUrl": "og:url",
    "image": "og:image",
    "publishedTime": "article:published_time",
    "modifiedTime": "article:modified_time",
}
ICON_RELS = ["icon", "shortcut icon", "apple-touch-icon"]

# --- Search, store and metrics (fixed values) ------------------------------
DEFAULT_LIMIT = 10
MAX_LIMIT = 20
CACHE_KEY_CHARS = 24
STORE_MAX_ITEMS = 500
STORE_TTL_MS = 3_600_000
DURATION_BUCKETS = [0.1, 0.3, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 15.0, 30.0]
# name, disabled, timeout seconds
ENGINE_SETTINGS = [
    ("google", False, 4.0),
    ("duckduckgo", False, 4.0),
    ("brave", False, 4.0),
    ("wikipedia", False, 3.0),
    ("github", False, 4.0),
    ("stackoverflow", False, 4.0),
    ("google news", False, 4.0),
    ("arxiv", True, None),
    ("google scholar", True, None),
]
