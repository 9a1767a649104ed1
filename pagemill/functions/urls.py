"""URL functions as column expressions.

URLs are taken apart by pattern rather than by a parser class: characters such as blanks or | that browsers
accept must not make a URL null. Percent-coding inside a query is kept but for %20, which is written as +.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track, and schemes of pages that can't be read.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "vero_id"]
RESTRICTED_SCHEMES = ["chrome", "edge", "about", "data", "chrome-extension", "view-source", "file"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# Sites whose paths end in a title after the id: host, part the path must hold, the path's stable part.
SITE_RULES = [("hk01.com", None, r"^(/[^/]+/\d+)/.+$"), ("mingpao.com", "/article/", r"^(/article/[^/]+/[^/]+)/.+$")]

_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)"
_HEAD = _SCHEME[:4] + r"[A-Za-z][A-Za-z0-9+.\-]*://"
_PARSEABLE = _HEAD + r"(?:[^@/?#]*@)?[^\s<>\\^|%#\[\]/?:@]+(?::\d*)?(?:[/?#][\s\S]*)?$"


def bound(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it; long expressions would else outgrow what compiles."""
    return F.transform(F.array(x), f)[0]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme_of(url: Column | str) -> Column:
    """Lower-case scheme, '' where there is none."""
    return F.lower(F.regexp_extract(_c(url), _SCHEME + ":", 1))


def host_of(url: Column | str) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(_c(url), _HEAD + r"(?:[^@/?#]*@)?([^/?#:]*)", 1))


def path_of(url: Column | str) -> Column:
    """The path, / where it is empty."""
    path = F.regexp_extract(_c(url), _HEAD + r"[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column | str) -> Column:
    """The query without its question mark."""
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def is_parseable(url: Column | str) -> Column:
    """Whether the URL has a scheme, and a host free of blanks and brackets. Null is not."""
    return F.coalesce(_c(url).rlike(_PARSEABLE), F.lit(False))


def _without_usual_port(authority: Column) -> Column:
    usual = "|".join(f"^({scheme}://[^/]*):{port}$" for scheme, port in DEFAULT_PORTS.items())
    return F.regexp_replace(authority, usual, "".join(f"${k + 1}" for k in range(len(DEFAULT_PORTS))))


def origin_of(url: Column | str) -> Column:
    return _without_usual_port(F.lower(F.regexp_replace(F.regexp_extract(_c(url), "(" + _HEAD[1:] + r"[^/?#]*)", 1), r"//[^@]*@", "//")))


def _query_kept(url: Column) -> Column:
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING_PARAMS))
    return F.array_join(F.transform(pairs, lambda p: F.replace(F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))), F.lit("%20"), F.lit("+"))), "&")


def normalize_url(url: Column | str) -> Column:
    """The storage key of a URL: no fragment, no tracking parameters, no trailing slashes but the root's.

    Null and '' give ''; what has no :// or can't be parsed stays as it is. Scheme and host variants stay apart."""
    return bound(_c(url), lambda u: F.when(u.isNull() | (u == ""), "").when(is_parseable(u), _normal_form(u)).otherwise(u))


def _normal_form(url: Column) -> Column:
    user = F.regexp_extract(url, _HEAD + r"([^@/?#]*@)", 1)
    with_user = lambda o: F.when(F.contains(url, F.lit("@")), F.concat(F.regexp_extract(o, r"^([^/]*//)", 1), user, F.regexp_extract(o, r"^[^/]*//(.*)$", 1))).otherwise(o)
    path = F.regexp_replace(path_of(url), r"(?<=.)/+$", "")
    return F.concat(bound(origin_of(url), with_user), path, F.regexp_replace(F.concat(F.lit("?"), _query_kept(url)), r"^\?$", ""))


def stable_url(url: Column | str) -> Column:
    """For the sites of SITE_RULES the URL without its title part; null elsewhere."""
    url = _c(url)
    host, path = host_of(url), path_of(url)
    out = F.lit(None).cast("string")
    for site, needs, pattern in reversed(SITE_RULES):
        fits = is_parseable(url) & ((host == site) | host.endswith(f".{site}")) & path.rlike(pattern)
        if needs:
            fits = fits & F.contains(path, F.lit(needs))
        query = query_of(url)
        cut = F.concat(origin_of(url), F.regexp_extract(path, pattern, 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        out = F.when(fits, normalize_url(cut)).otherwise(out)
    return out


def stable_url_from_route(page: Column | str, query: Column | str, url: Column | str) -> Column:
    """A URL from a route pattern (/[category]/[id]/[slug]) and its values (a map), without title-like parts.

    A part is title-like if its name says slug or title and its value isn't a number, or its value has non-ASCII
    characters and its name says nothing of category, section, channel, topic or tag. Null if no part is, or all are,
    or anything is missing."""
    page, query, url = _c(page), _c(query), _c(url)
    names = F.regexp_extract_all(page, F.lit(r"\[(\w+)\]"), F.lit(1))

    def title_like(n):
        value = F.coalesce(query[n], F.lit(""))
        return F.when(F.lower(n).rlike("slug|title"), ~value.rlike(r"^[0-9]+$")).when(F.lower(n).rlike("category|section|channel|topic|tag"), F.lit(False)).otherwise(value.rlike(r"[^\x20-\x7e]"))

    gone = F.filter(names, title_like)
    path = F.aggregate(names, page, lambda p, n: F.when(F.array_contains(gone, n), F.replace(p, F.concat(F.lit("/["), n, F.lit("]")), F.lit(""))).otherwise(F.replace(p, F.concat(F.lit("["), n, F.lit("]")), F.coalesce(query[n], F.lit("")))))
    return F.when(page.isNotNull() & (page != "") & query.isNotNull() & is_parseable(url) & (F.size(gone) > 0) & (F.size(gone) < F.size(names)), normalize_url(F.concat(origin_of(url), path)))


def has_same_origin(a: Column | str, b: Column | str) -> Column:
    """Scheme, host and port are equal; null and invalid URLs never are."""
    return is_parseable(a) & is_parseable(b) & (origin_of(a) == origin_of(b))


def resolve_storage_url(url: Column | str, page: Column | None = None, query: Column | None = None, shortlink: Column | None = None) -> Column:
    """Site rule, then route, then a same-origin shortlink with a query, then the normal form."""
    url = _c(url)
    options = [stable_url(url)]
    if page is not None and query is not None:
        options.append(stable_url_from_route(page, query, url))
    if shortlink is not None:
        options.append(F.when(has_same_origin(shortlink, url) & (query_of(shortlink) != ""), shortlink))
    return F.coalesce(*options, normalize_url(url))


def is_root_url(url: Column | str) -> Column:
    """Null and '' are root; what can't be parsed isn't; else path / and no query."""
    url = _c(url)
    return F.when(url.isNull() | (url == ""), True).otherwise(is_parseable(url) & (path_of(url) == "/") & (query_of(url) == ""))


def is_http_url(url: Column | str) -> Column:
    return is_parseable(url) & scheme_of(url).isin("http", "https")


def is_safe_stable_url(url: Column | str, require_normalized: bool = False) -> Column:
    """Not blank, http or https, not root once normal; with require_normalized also equal to its normal form."""
    url = _c(url)
    root = path_of(url).rlike("^/*$") & (_query_kept(url) == "")
    ok = url.isNotNull() & (F.trim(url) != "") & is_http_url(url) & ~root
    return F.coalesce(ok & (normalize_url(url) == url) if require_normalized else ok, F.lit(False))


def is_valid_alias(value: Column | str) -> Column:
    """Safe and of ten characters or more. The value is bound first: it may be a long expression, and is named often."""
    return bound(_c(value), lambda v: F.coalesce((F.char_length(v) >= 10) & is_safe_stable_url(v), F.lit(False)))


def is_remote_url(url: Column | str, hosts: list[str]) -> Column:
    """https with one of the hosts or a host below it; a trailing dot is tolerated."""
    host = F.regexp_replace(host_of(url), r"\.$", "")
    match = F.lit(False)
    for h in hosts:
        match = match | (host == h) | host.endswith(f".{h}")
    return is_parseable(url) & (scheme_of(url) == "https") & match


def filter_restricted(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose scheme can be read; null URLs stay out."""
    return pages.where(F.col(url).isNotNull() & ~scheme_of(url).isin(RESTRICTED_SCHEMES))


def extract_domain(url: Column | str) -> Column:
    """The host, or the input where it can't be parsed."""
    return F.when(is_parseable(url), host_of(url)).otherwise(_c(url))


def is_temporary_image_url(url: Column | str, suffixes: list[str]) -> Column:
    """A signed image URL: one of the host suffixes and a token parameter."""
    match = F.lit(False)
    for s in suffixes:
        match = match | (host_of(url) == s) | host_of(url).endswith(f".{s}")
    return is_parseable(url) & match & F.concat(F.lit("&"), query_of(url)).rlike(r"&token-(time|hash)=")
