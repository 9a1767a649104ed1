"""Image URLs: their clean form and whether they can stand for an image of an article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_LISTS = 1000  # lists of URLs that a task turns into Python strings at a time
# Limits, and what image URLs and other URLs look like.
MAX_URL_LENGTH = 2000
MAX_UNWRAPS = 5
EXTENSIONS = r"\.(jpg|jpeg|png|webp|svg|bmp|ico|tiff|tif|avif|heic|heif)$"
IMAGE_PATHS = [
    r"/images?/", r"/imgs?/", r"/photos?/", r"/pictures?/", r"/media/", r"/uploads?/", r"/assets?/", r"/files?/", r"/content/", r"/wp-content/", r"/cdn/", r"cdn\d*\.", r"/static/", r"/thumbs?/", r"/thumbnails?/",
    r"/resize/", r"/crop/", r"/(\d{4})/(\d{2})/", r"/avatars?/", r"/u/\d+($|/|\?)", r"/profile_images/", r"/creatr-uploaded-images/", r"/ny/api/res/", r"\.gtimg\.com/",
]
OTHER_PATHS = [r"\.(js|css|html|htm|php|asp|jsp|json|xml)(\?|$)", r"/api/", r"/ajax/", r"/callback", r"/track", r"/analytics", r"/pixel"]
PLACEHOLDERS = ["placeholder", "loading", "spinner", "blank", "empty", "1x1", "transparent", "miscellaneous_sprite"]
_RESERVED = ";/?:@&=+$,#"
_KEPT = _RESERVED + "-_.!~*'()"


def _recoded(url: str) -> str:
    """Percent-coding made regular: escapes of reserved characters stay escapes of escapes, all else is coded once."""

    def plain(m):
        return "".join(quote(c, safe="") if c in _RESERVED else c for c in unquote(m[0], errors="strict"))

    if re.search(r"%(?![0-9A-Fa-f]{2})", url):
        return url
    try:
        return quote(re.sub(r"(?:%[0-9A-Fa-f]{2})+", plain, url), safe=_KEPT)
    except UnicodeError:
        return url


def _clean(url: str | None) -> str | None:
    for _ in range(MAX_UNWRAPS):
        if not url:
            return None
        s = url.strip()
        s = "https:" + s if s.startswith("//") else "https://" + s[7:] if s.startswith("http://") else s
        s = re.sub(r"[\[\]^|{}<>]", lambda m: quote(m[0]), s) if re.search("https?%3A%2F%2F", s, re.I) else _recoded(s)
        try:
            u = urlsplit(s)
            host = u.hostname or ""
        except ValueError:
            return None
        if u.scheme and (u.scheme not in ("http", "https") or not host or re.search(r"[%\s<>^|{}]", host)):
            return None
        pairs = parse_qsl(u.query, keep_blank_values=True)
        first: dict[str, str] = {}
        for k, v in pairs:
            first.setdefault(k, v)
        inner = None
        if "/_next/image" in u.path and first.get("url"):
            to = first["url"]
            to = unquote(to) if re.match(r"(https?%3A%2F%2F|%2F)", to, re.I) else to
            inner = to if re.match("https?://", to, re.I) else urljoin(f"{u.scheme}://{u.netloc}/", to)
        elif ("/photo.php" in u.path or "/gw/" in u.path) and first.get("u"):
            to = unquote(first["u"])
            inner = to if re.match("https?://", to, re.I) else None
        if inner:
            url = inner
            continue
        if re.search(r"(^|\.)inmediahk\.net$", host):
            first.pop("itok", None)
        query = "&".join(f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}".replace("~", "%7E") for k, v in first.items())
        path = u.path if u.path.startswith("/") else "/" + u.path
        tail = path + ("?" + query if query else "") + ("#" + u.fragment if u.fragment else "")
        if not u.scheme:
            return tail
        return re.sub("[()']", lambda m: f"%{ord(m[0]):02X}", f"{u.scheme}://{u.netloc.lower()}{tail}")
    return url


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cleaned(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in urls:
        for at in range(0, len(a), PIECE_LISTS):
            yield pa.array([None if x is None else [_clean(v) for v in x] for x in a.slice(at, PIECE_LISTS).to_pylist()], pa.list_(pa.string()))


def clean_image_urls(urls: Column) -> Column:
    """clean_image_url of each of an array, in one pass; null for null."""
    return _cleaned(urls)


def clean_image_url(url: Column) -> Column:
    """The https form, regularly coded, without what wraps it (five times at most) and with the first of repeated
    parameters; a relative URL as an absolute path. Null for null, '' and other schemes."""
    return _cleaned(F.array(url))[0]


def _early(url: Column, gif: str) -> Column:
    low = F.lower(F.trim(url))
    return F.coalesce(url, F.lit("")).isin("") | low.rlike("^(data|blob|javascript):") | low.rlike(gif) | low.rlike("|".join(PLACEHOLDERS))


def is_valid_clean_image_url(url: Column) -> Column:
    """Whether a clean URL can be an image: https or a path, no placeholder, at most 2,000 characters, by extension or else
    by the look of its path. Null is not."""
    path = F.regexp_extract(url, r"^(?:https://[^/?#]*)?([^?#]*)", 1)
    shape = url.rlike("(?i)^(https://|/)") & (F.char_length(url) <= MAX_URL_LENGTH) & ~url.rlike(r"[<>\[\]^|{}]")
    looks = path.rlike("(?i)" + EXTENSIONS) | url.rlike("(?i)" + "|".join(IMAGE_PATHS)) & ~url.rlike("(?i)" + "|".join(OTHER_PATHS))
    return F.coalesce(~_early(url, r"\.gif") & shape & looks, F.lit(False))


def is_valid_image_url(url: Column, clean: Column | None = None) -> Column:
    """The same of a URL as written; ``clean`` is its clean form where that is known already."""
    clean = clean_image_url(url) if clean is None else clean
    return F.coalesce(~_early(url, r"\.gif(\?|$)"), F.lit(False)) & is_valid_clean_image_url(clean)
