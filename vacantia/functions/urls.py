"""URL expressions: canonical form, ids, company keys, host rules.

URLs are read with one pattern per part rather than a URI parser, because the strict parser
rejects many links that occur in feeds. Limits: percent-encoding, dot segments and
international host names are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, or_else, strip

_WEB = r"(?i)^(https?)://(?:[^/?#\\@\s]*@)?([^/?#\\@:\s<>^|%\[\]]+)(?::(\d{1,5}))?((?:/[^?#]*)?)(\?[^#]*)?(#.*)?$"
_ANY = r"(?i)^([a-z][a-z0-9+.\-]*):(.*)$"


def is_web_url(url: Column) -> Column:
    return strip(url).rlike(_WEB)


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(strip(url), _WEB, index)


def scheme(url: Column) -> Column:
    """Lower-case scheme of any absolute URL; '' when the text is none."""
    return F.lower(F.regexp_extract(strip(F.coalesce(url, F.lit(""))), _ANY, 1))


def host(url: Column) -> Column:
    """Lower-case host of a web URL; '' when it is none."""
    return F.lower(_part(F.coalesce(url, F.lit("")), 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 4)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


# Tracking parameters that never identify a listing.
_TRACKING = r"(?i)(?<=[?&])(?:utm_[^=&]*|gh_src|gh_jid_src|src|ref|source)(?:=[^&]*)?(?:&|$)"
# Pages of an application form below a listing.
_FORM_PAGE = r"/+(?:apply|application)/*$"
# The embedded application form and the page it stands for.
_EMBED_HOST, _EMBED_PATH = r"(?i)greenhouse\.io$", r"(?i)/embed/job_app"
_EMBED_TARGET = "https://job-boards.greenhouse.io/%s/jobs/%s"
# URLs that are canonical as they stand: most keys of a registry.
_PLAIN = r"^https?://(?!www\.)[a-z0-9.-]+(?:/(?!(?:apply|application)$)[^?#\s/\\]+)*$"
# Parts of a URL come from one match, joined by a control character and split again.
_CUT = "\u0001"


def _web_parts(text: Column) -> Column:
    """struct(scheme, domain, port, path, query) of a web URL."""
    pieces = F.split(F.regexp_replace(text, _WEB, _CUT.join(f"${i}" for i in range(1, 6))), _CUT)
    return let(pieces, lambda p: F.struct(
        F.lower(F.get(p, F.lit(0))).alias("scheme"), F.regexp_replace(F.lower(F.get(p, F.lit(1))), r"^www\.", "").alias("domain"),
        F.get(p, F.lit(2)).alias("port"), F.get(p, F.lit(3)).alias("path"), F.get(p, F.lit(4)).alias("query"),
    ))


def _clean_parts(p: Column) -> Column:
    form_page = p["path"].rlike(r"[^/]" + _FORM_PAGE)
    without_form = F.regexp_replace(F.regexp_replace(p["path"], _FORM_PAGE, ""), "/{2,}", "/")
    pairs = F.regexp_replace(F.regexp_replace(p["query"], _TRACKING, ""), "&{2,}", "&")
    default = F.when(p["scheme"] == "https", "443").otherwise("80")
    return F.struct(
        F.concat(
            p["scheme"], F.lit("://"), p["domain"],
            F.when(p["port"].isin("") | (p["port"] == default), "").otherwise(F.concat(F.lit(":"), p["port"])),
        ).alias("origin"),
        F.when(form_page, without_form).otherwise(F.regexp_replace(p["path"], "/+$", "")).alias("path"),
        F.regexp_replace(F.regexp_replace(pairs, r"^\?&", "?"), "[?&]+$", "").alias("query"),
    )


def _embedded(p: Column) -> Column:
    """The listing page an embedded application form stands for, else null."""
    board = F.lower(F.regexp_extract(p["query"], "[?&]for=([^&]*)", 1))
    token = F.regexp_extract(p["query"], "[?&]token=([^&]*)", 1)
    is_form = p["path"].rlike(_EMBED_PATH) & p["domain"].rlike(_EMBED_HOST)
    return F.when(is_form, F.when((board != "") & token.rlike(r"^\d+$"), F.format_string(_EMBED_TARGET, board, token)))


def canonical_url(raw: Column) -> Column:
    """One spelling per listing URL, so that it can serve as the registry key.

    Lower-case scheme and host without ``www.`` and without the scheme's default port, no
    fragment, no tracking parameters, no trailing ``/apply`` or ``/application``, no trailing
    slash. Null and blank give ''; text that is no web URL is only trimmed.
    """
    def joined(c: Column) -> Column:
        # The root path is written only in front of a query.
        shown = F.when((c["path"] == "") & (c["query"] != ""), "/").otherwise(c["path"])
        return F.concat(c["origin"], shown, c["query"])

    def from_text(text: Column) -> Column:
        web = let(_web_parts(text), lambda p: F.coalesce(_embedded(p), let(_clean_parts(p), joined)))
        return F.when(text.rlike(_PLAIN), text).when(text.rlike(_WEB), web).otherwise(text)

    return let(strip(F.coalesce(raw, F.lit(""))), from_text)


# What an id can come from; anything else has none, which one pattern decides.
_ID_SOURCE = r"[?&](?:token|gh_jid)=\d|/(?:jobs|roles)/\d"


_ID_IN_PATH = r"(?i)^https?://[^/?#]+[^?#]*?/(?-i:jobs|roles)/(\d+)"


def _parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"^[^#?]*\?(?:[^#]*?&)??{name}=([^&#]*)", 1)


def listing_id(url: Column) -> Column:
    """Numeric id shared by all URL shapes of one listing; '' when there is none.

    The query parameter ``token`` (or, when that is blank, ``gh_jid``) if it is a number, else the
    number after ``/jobs/`` or ``/roles/`` in the path.
    """
    def found(text: Column) -> Column:
        given = let(or_else(_parameter(text, "token"), _parameter(text, "gh_jid")), lambda q: F.when(q.rlike(r"^\d+$"), q))
        in_path = F.regexp_extract(text, _ID_IN_PATH, 1)
        return F.when(text.rlike(_WEB), F.coalesce(given, in_path)).otherwise("")

    text = F.coalesce(url, F.lit(""))
    return F.when(text.rlike(_ID_SOURCE), let(strip(text), found)).otherwise("")


def _staged(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    return df.withColumns(steps) if steps else df


def with_url_keys(df: DataFrame, urls: dict[str, Column] | None = None, ids: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with canonical URLs (``urls``: new column → text) and listing ids (``ids``) as columns.

    The values of :func:`canonical_url` and :func:`listing_id`. Every step is a column that the next ones use, so a
    shared part is computed once and all of it stays in generated code.
    """
    names = list(df.columns)
    at = lambda kind, part: F.col(f"__{kind}_{part}")
    kinds = {f"u{i}": (out, raw) for i, (out, raw) in enumerate((urls or {}).items())}
    df = _staged(df, {f"__{k}_text": strip(F.coalesce(raw, F.lit(""))) for k, (_, raw) in kinds.items()})
    pieces = lambda t: F.split(F.regexp_replace(t, _WEB, _CUT.join(f"${i}" for i in range(1, 6))), _CUT)
    df = _staged(df, {f"__{k}_pieces": F.when(at(k, "text").rlike(_WEB) & ~at(k, "text").rlike(_PLAIN), pieces(at(k, "text"))) for k in kinds})
    parts = {}
    for k in kinds:
        piece = lambda i, k=k: F.get(at(k, "pieces"), F.lit(i))
        parts |= {
            f"__{k}_scheme": F.lower(piece(0)), f"__{k}_domain": F.regexp_replace(F.lower(piece(1)), r"^www\.", ""),
            f"__{k}_port": piece(2), f"__{k}_path": piece(3), f"__{k}_query": piece(4),
        }
    df = _staged(df, parts)
    cleaned = {}
    for k in kinds:
        part = {x: at(k, x) for x in ("scheme", "domain", "port", "path", "query")}
        clean = _clean_parts(part)
        cleaned |= {f"__{k}_page": _embedded(part), **{f"__{k}_clean_{x}": clean[x] for x in ("origin", "path", "query")}}
    df = _staged(df, cleaned)
    out = {}
    for k, (name, _) in kinds.items():
        path_, query = at(k, "clean_path"), at(k, "clean_query")
        shown = F.when((path_ == "") & (query != ""), "/").otherwise(path_)
        out[name] = F.coalesce(at(k, "page"), F.concat(at(k, "clean_origin"), shown, query), at(k, "text"))

    found = {f"i{i}": (name, raw) for i, (name, raw) in enumerate((ids or {}).items())}
    df = _staged(df, {f"__{k}_text": F.when(raw.rlike(_ID_SOURCE), strip(raw)) for k, (_, raw) in found.items()})
    df = _staged(df, {f"__{k}_web": F.when(at(k, "text").rlike(_WEB), at(k, "text")) for k in found})
    df = _staged(df, {f"__{k}_given": or_else(_parameter(at(k, "web"), "token"), _parameter(at(k, "web"), "gh_jid")) for k in found})
    for k, (name, _) in found.items():
        out[name] = F.coalesce(F.when(at(k, "given").rlike(r"^\d+$"), at(k, "given")), F.regexp_extract(at(k, "web"), _ID_IN_PATH, 1), F.lit(""))
    # Passed through a generator of one row: a filter on a result can't be moved below, where it would repeat every step.
    kept = [F.col(f"`{c}`") for c in names if c not in out]
    made = F.explode(F.array(F.struct(*[v.alias(c) for c, v in out.items()]))).alias("__keys")
    return df.select(*kept, made).select(*kept, *[F.col(f"__keys.`{c}`").alias(c) for c in out])


# Where each board keeps the company slug in its URLs, in matching order.
BOARD_PATTERNS = (
    ("greenhouse.io", r"(?i)job-boards(?:\.eu)?\.greenhouse\.io/([^/?#]+)", "greenhouse"),
    ("greenhouse.io", r"(?i)boards\.greenhouse\.io/([^/?#]+)", "greenhouse"),
    ("ashbyhq.com", r"(?i)jobs\.ashbyhq\.com/([^/?#]+)", "ashby"),
    ("lever.co", r"(?i)jobs\.lever\.co/([^/?#]+)", "lever"),
    ("recruitee.com", r"(?i)([^/.]+)\.recruitee\.com", "recruitee"),
    ("breezy.hr", r"(?i)([^/.]+)\.breezy\.hr", "breezy"),
    ("bamboohr.com", r"(?i)([^/.]+)\.bamboohr\.com", "bamboohr"),
    ("workable.com", r"(?i)apply\.workable\.com/([^/?#]+)", "workable"),
    ("rippling.com", r"(?i)ats\.rippling\.com/([^/?#]+)", "rippling"),
    ("smartrecruiters.com", r"(?i)careers\.smartrecruiters\.com/([^/?#]+)", "smartrecruiters"),
)


def company_key(provider: Column, careers_url: Column, patterns=BOARD_PATTERNS) -> Column:
    """``provider:slug`` from the board URL, else ``provider:host``, else ``provider:text``.

    A pattern is tried only where its host occurs in the URL, which a substring test decides.
    """
    url = F.coalesce(careers_url, F.lit(""))
    lowered = F.lower(url)
    given = F.coalesce(provider, F.lit(""))
    owner = F.when(given == "", "unknown").otherwise(given)
    by_board = []
    for fragment, pattern, board in patterns:
        slug = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
        by_board.append(F.when(lowered.contains(fragment) & given.isin("", board), F.concat(F.lit(board + ":"), F.lower(slug))))
    fallback = F.concat(owner, F.lit(":"), F.when(is_web_url(url), bare_host(url)).otherwise(url))
    return F.coalesce(*by_board, fallback)


# Slug patterns used when a company is looked up in the board catalogue by URL.
CATALOGUE_PATTERNS = (
    (r"job-boards(?:\.eu)?\.greenhouse\.io/([^/?#]+)", "greenhouse"),
    (r"jobs\.ashbyhq\.com/([^/?#]+)", "ashby"),
    (r"jobs\.lever\.co/([^/?#]+)", "lever"),
    (r"([^./]+)\.recruitee\.com", "recruitee"),
    (r"jobs\.gem\.com/([^/?#]+)", "gem"),
    (r"apply\.workable\.com/([^/?#]+)", "workable"),
    (r"([^./]+)\.bamboohr\.com", "bamboohr"),
    (r"([^./]+)\.breezy\.hr", "breezy"),
    (r"ats\.rippling\.com/([^/?#]+)", "rippling"),
)


def board_and_slug(url: Column, patterns=CATALOGUE_PATTERNS) -> Column:
    """struct(provider, slug) of the first pattern that matches, else null."""
    text = F.coalesce(url, F.lit(""))
    hits = []
    for pattern, board in patterns:
        slug = F.regexp_extract(text, pattern, 1)
        hits.append(F.when(slug != "", F.struct(F.lit(board).alias("provider"), slug.alias("slug"))))
    return F.coalesce(*hits)


# Host fragments of supported boards, then of known unsupported ones.
PLATFORM_HOSTS = (
    ("greenhouse.io", "greenhouse"),
    ("ashbyhq.com", "ashby"),
    ("lever.co", "lever"),
    ("smartrecruiters.com", "smartrecruiters"),
    ("recruitee.com", "recruitee"),
    ("jobs.gem.com", "gem"),
    ("workable.com", "workable"),
    ("bamboohr.com", "bamboohr"),
    ("breezy.hr", "breezy"),
    ("rippling.com", "rippling"),
    ("rippling-ats.com", "rippling"),
    ("myworkdayjobs.com", "workday"),
    ("teamtailor.com", "teamtailor"),
    ("jazzhr.com", "jazzhr"),
    ("applytojob.com", "jazzhr"),
    ("jobscore.com", "jobscore"),
    ("pinpointhq.com", "pinpoint"),
    ("taleo.net", "taleo"),
    ("icims.com", "icims"),
)


def platform(url: Column, hosts=PLATFORM_HOSTS) -> Column:
    """Board behind a URL: a known one, ``unsupported``, or ``unresolved`` for no URL."""
    def named(h: Column) -> Column:
        chain = F.when(h == "", "unresolved")
        for fragment, name in hosts:
            chain = chain.when(h.contains(fragment), name)
        return chain.otherwise("unsupported")

    return let(host(url), named)


def slug_candidates(name: Column) -> Column:
    """Distinct guesses for a company's board slug, best first, two letters or more."""
    text = strip(F.lower(name))
    compact = F.regexp_replace(text, "[^a-z0-9]+", "")
    hyphened = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first_word = F.regexp_replace(F.element_at(F.split(text, r"\s+"), 1), "[^a-z0-9]", "")
    # Legal and branch suffixes.
    stripped = F.regexp_replace(compact, "(inc|llc|ltd|corp|technologies|labs|ai|io)$", "")
    return F.array_distinct(F.filter(F.array(compact, hyphened, first_word, stripped), lambda s: F.length(s) >= 2))


def workday_parts(url: Column) -> Column:
    """struct(host, tenant, data_centre, locale, site) of a Workday URL; null when it is none."""
    h = host(url)
    host_re = r"^([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com$"
    first = F.try_element_at(segments(url), F.lit(1))
    has_locale = F.coalesce(first.rlike("^[a-z]{2}-[A-Z]{2}$"), F.lit(False))
    site = F.when(has_locale, F.try_element_at(segments(url), F.lit(2))).otherwise(first)
    return F.when(
        h.rlike(host_re) & site.isNotNull(),
        F.struct(
            h.alias("host"),
            F.regexp_extract(h, host_re, 1).alias("tenant"),
            F.regexp_extract(h, host_re, 2).alias("data_centre"),
            F.when(has_locale, first).otherwise("").alias("locale"),
            site.alias("site"),
        ),
    )


# Job aggregators whose links are no company's own careers page.
AGGREGATORS = (
    "arbeitnow.com", "remotive.com", "remotive.io", "remotive.co", "www.arbeitnow.com",
    "www.remotive.com", "www.remotive.io", "localhost", "127.0.0.1",
)
AGGREGATOR_SUFFIXES = (".remotive.com", ".arbeitnow.com")


def valid_careers_url(url: Column) -> Column:
    def own(h: Column) -> Column:
        listed = h.isin("", *AGGREGATORS)
        for suffix in AGGREGATOR_SUFFIXES:
            listed = listed | h.endswith(suffix)
        return ~listed

    return let(host(url), own)


def https_on_host(url: Column, host_pattern: str) -> Column:
    """Guard: https and the host matches the (anchored) pattern."""
    return F.coalesce((scheme(url) == "https") & host(url).rlike(f"^(?:{host_pattern})$"), F.lit(False))


# Loopback, private and link-local hosts.
_PRIVATE_HOST = (
    r"(?i)^localhost$|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\.|^::1$"
    r"|^fc[0-9a-f]{2}:|^fe80:"
)


def url_guard(url: Column) -> Column:
    """Why a URL must not be opened; null when it is safe."""
    text = strip(F.coalesce(url, F.lit("")))
    bracketed = F.regexp_extract(text, r"(?i)^https?://(?:[^/?#@\s]*@)?\[([0-9a-f:.]+)\]", 1)
    target = F.when(bracketed != "", bracketed).otherwise(host(text))
    proto = scheme(text)
    return (
        F.when(proto == "", "invalid_url")
        .when(~proto.isin("http", "https"), "unsupported_protocol")
        .when(target == "", "invalid_url")
        .when(target.rlike(_PRIVATE_HOST), "blocked_host")
    )


# Board and careers links inside free text, in order of preference.
_TEXT_LINKS = (
    r"""(?i)https?://[a-z0-9-]+\.greenhouse\.io/[^\s"'>]+""",
    r"""(?i)https?://job-boards(?:\.eu)?\.greenhouse\.io/[^\s"'>]+""",
    r"""(?i)https?://jobs\.ashbyhq\.com/[^\s"'>]+""",
    r"""(?i)https?://jobs\.lever\.co/[^\s"'>]+""",
    r"""(?i)https?://[a-z0-9-]+\.recruitee\.com[^\s"'>]*""",
    r"""(?i)https?://jobs\.gem\.com/[^\s"'>]+""",
    r"""(?i)https?://apply\.workable\.com/[^\s"'>]+""",
    r"""(?i)https?://[a-z0-9-]+\.bamboohr\.com/[^\s"'>]+""",
    r"""(?i)https?://[a-z0-9-]+\.breezy\.hr/[^\s"'>]+""",
    r"""(?i)https?://ats\.rippling\.com/[^\s"'>]+""",
    r"""(?i)https?://[a-z0-9-]+\.myworkdayjobs\.com/[^\s"'>]+""",
    r"""(?i)https?://[^\s"'>]+/(?:careers|jobs|join)(?:/[^\s"'>]*)?""",
)


def board_url_in_text(text: Column) -> Column:
    """The first valid board or careers link in free text, else null."""
    hits = []
    for pattern in _TEXT_LINKS:
        link = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), "[.,;)]+$", "")
        hits.append(let(link, lambda x: F.when((x != "") & valid_careers_url(x), x)))
    return F.coalesce(*hits)


# Where a directory's detail page holds the company's own site.
_SITE_LINKS = (
    r"""(?i)href="([^"]+)"[^>]*class="[^"]*button[^"]*outline[^"]*\"""",
    r"""(?i)class="company__logo-link"[^>]*href="([^"]+)\"""",
    r"""(?i)class="company__logo"[^>]*href="([^"]+)\"""",
    r"""(?i)href="([^"]+)"[^>]*target="_blank"[^>]*>Visit Website""",
)


def website_in_page(html: Column, patterns=_SITE_LINKS) -> Column:
    """Company site linked from a directory page, else null."""
    source = F.coalesce(html, F.lit(""))
    return F.coalesce(*[F.nullif(F.regexp_extract(source, p, 1), F.lit("")) for p in patterns])


def resolve_link(link: Column, base: Column) -> Column:
    """Absolute form of a link found on a page; '' when it cannot be one."""
    text = strip(F.coalesce(link, F.lit("")))
    origin = F.regexp_extract(strip(F.coalesce(base, F.lit(""))), r"(?i)^https?://[^/?#]+", 0)
    folder = F.regexp_replace(path(F.coalesce(base, F.lit(""))), "[^/]*$", "")
    return (
        F.when(text == "", "")
        .when(text.rlike(_ANY), F.when(text.rlike(r"^(?i)https?://[^/?#\s]+$"), F.concat(text, F.lit("/"))).otherwise(text))
        .when(origin == "", "")
        .when(text.startswith("//"), F.concat(F.lower(F.regexp_extract(strip(base), "(?i)^https?:", 0)), text))
        .when(text.startswith("/"), F.concat(origin, text))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), text))
    )


def first_urls(text: Column) -> Column:
    """All URLs of a text, up to a blank, ``|`` or ``)``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s|)]+"), F.lit(0))
