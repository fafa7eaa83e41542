"""Fixed values the rules are defined by.

They must equal the published behaviour for results to match, so they are kept
together as plain data.
"""

# --- fixed values: link discovery -------------------------------------------
SKIPPED_PREFIXES = ("mailto:", "tel:", "javascript:")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico")
STATIC_EXTENSIONS = (
    ".css", ".js", ".mjs", ".map", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".webmanifest",
)
ASSET_NAME_HINTS = ("favicon", "apple-touch-icon", "android-chrome", "logo", "sprite")
TRACKING_KEY_PREFIXES = ("utm_", "fbclid", "gclid", "msclkid")
INDEX_PATHS = ("/index", "/index.html")
DEFAULT_ATTACHMENT_EXTENSIONS = (".pdf", ".zip", ".png", ".jpg", ".jpeg")

# --- fixed values: URL schemes (as in the URL module of Python's library) ----
HIERARCHICAL_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)

# --- fixed values: content types ---------------------------------------------
HTML_CONTENT_TYPES = ("text/html", "application/xhtml+xml")
BINARY_CONTENT_TYPE_PREFIXES = (
    "image/", "audio/", "video/", "application/pdf", "application/octet-stream",
    "application/zip", "application/x-zip", "application/x-rar", "application/x-7z-compressed",
    "application/msword", "application/vnd.ms-", "application/vnd.openxmlformats-officedocument.",
)
NON_HTML_PATH_SUFFIXES = (
    ".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico", ".css", ".js",
)
HTML_SNIFF_PREFIXES = ("<!doctype html", "<html")
HTML_SNIFF_PARTS = ("<body", "<head")
HTML_SNIFF_LENGTH = 256
SMALL_HTML_LENGTH = 256

# --- fixed values: content selection -----------------------------------------
# A selector is (kind, value): tag, class, id, role or label (aria-label contains).
CONTAINER_SELECTORS = (
    ("tag", "main"), ("tag", "article"), ("role", "main"),
    ("class", "main-content"), ("class", "maincontent"),
    ("class", "page-content"), ("class", "pagecontent"),
    ("class", "content"), ("class", "content-area"), ("class", "entry-content"),
    ("class", "post-content"), ("class", "article-content"),
    ("id", "main"), ("id", "content"),
)
BOILERPLATE_SELECTORS = (
    ("tag", "nav"), ("tag", "header"), ("tag", "footer"), ("tag", "aside"),
    ("role", "navigation"), ("label", "breadcrumb"),
    ("class", "breadcrumb"), ("class", "breadcrumbs"), ("class", "toc"),
    ("class", "table-of-contents"), ("class", "sidebar"), ("class", "side-nav"),
    ("class", "sidenav"), ("class", "nav"), ("class", "navbar"), ("class", "menu"),
    ("class", "pagination"), ("class", "pager"), ("class", "social-share"),
    ("class", "related-posts"), ("class", "cookie"), ("class", "consent"),
)
AGGRESSIVE_SELECTORS = (
    ("class", "share"), ("class", "newsletter"), ("class", "cta"), ("class", "promo"),
    ("class", "teaser"), ("class", "recommendation"), ("class", "recommendations"),
    ("class", "related"),
)
SUBSTANTIAL_LENGTH = 120
SUBSTANTIAL_TAGS = ("p", "h1", "h2", "h3", "li")
CONTENT_MODES = ("raw", "main", "aggressive")

# --- fixed values: metadata ---------------------------------------------------
PAGE_ID_NAMES = (
    "page_id", "page-id", "pageid", "page.id", "id", "article:id", "article_id",
    "document_id", "doc-id", "content_id",
)
# field -> (meta property names, meta names, time classes, JSON-LD key)
DATE_SOURCES = {
    "created_at": ((), ("created_at", "creation_date", "date.created"), (), "dateCreated"),
    "published_at": (
        ("article:published_time",),
        ("pubdate", "publishdate", "publish_date", "published_at", "date"),
        ("pubdate", "published", "entry-date", "article-date"),
        "datePublished",
    ),
    "updated_at": (
        ("article:modified_time",),
        ("lastmod", "last-modified", "modified", "updated_at", "date.modified"),
        ("updated", "modified"),
        "dateModified",
    ),
    "last_modified": ((), ("last-modified",), (), "dateModified"),
}
ALIAS_RELS = ("alternate", "amphtml", "shortlink")
SCHEMA_PAGE_TYPES = {
    "faqpage": "faq",
    "newsarticle": "news",
    "reportage": "news",
    "blogposting": "blog",
    "blog": "blog",
}
SCHEMA_ARTICLE_TYPES = ("techarticle", "article")
# (page type, evidence when no schema type was seen, tokens), in order of precedence
TOKEN_PAGE_TYPES = (
    ("release_notes", "url/title",
     ("release notes", "release-notes", "changelog", "/releases", "/release-notes", "/changelog")),
    ("faq", "title/breadcrumbs", ("faq", "frequently asked questions")),
    ("meeting_notes", "title/breadcrumbs",
     ("meeting", "minutes", "protokoll", "protocol", "sitzung", "agenda")),
    ("news", "url/title", ("news", "press release", "newsroom", "/news/", "/press/")),
    ("documentation", "url/title",
     ("docs", "documentation", "guide", "reference", "manual", "knowledge base", "help center",
      "/docs/", "/documentation/")),
    ("blog", "url/title", ("blog", "/blog/")),
)
FRONTMATTER_FIELDS = (
    "title", "url", "canonical_url", "page_id", "created_at", "published_at", "updated_at",
    "last_modified", "authors", "language", "content_type", "page_type", "site_name", "version",
    "visibility", "tags", "aliases", "entities", "labels", "breadcrumbs", "section_path", "etag",
    "last_modified_header", "status_code", "content_length",
)

# --- fixed values: dates (RFC 2822 names and zones) ----------------------------
MONTH_NAMES = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
LONG_MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
ZONE_OFFSETS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -400, "ADT": -300, "EST": -500, "EDT": -400,
    "CST": -600, "CDT": -500, "MST": -700, "MDT": -600, "PST": -800, "PDT": -700,
}

# --- fixed values: HTML ---------------------------------------------------------
VOID_TAGS = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "spacer", "track", "wbr",
))
# Text inside these is never part of a page's visible text.
HIDDEN_TEXT_TAGS = frozenset(("script", "style", "template", "rt", "rp"))

# --- defaults ---------------------------------------------------------------------
DEFAULT_MAX_PAGES = 100
DEFAULT_MAX_DEPTH = 2
