"""URL expressions: parts, normal form, reference resolution and crawl rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let_sql

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*:"

# File endings and paths that are never followed, and social domains.
SKIP_EXTENSIONS = (
    r"(?i)\.(pdf|docx?|xlsx?|zip|rar|7z|jpg|jpeg|png|gif|svg|webp|ico|mp4|mp3|wav|css|js|woff2?|ttf|eot)(\?.*)?$"
)
SKIP_PATHS = r"(?i)/(basket|cart|login|logout|register|personal|compare|favicon|captcha|tel:|mailto:)"
SOCIAL_DOMAINS = {
    "facebook.com": "Facebook", "instagram.com": "Instagram", "twitter.com": "Twitter",
    "x.com": "X", "linkedin.com": "LinkedIn", "youtube.com": "YouTube", "t.me": "Telegram",
    "vk.com": "VK", "tiktok.com": "TikTok", "ok.ru": "OK",
}


def site_of(url: Column) -> Column:
    """Authority of a URL ('' when there is none); never fails on malformed input."""
    return F.regexp_extract(url, rf"^(?:{SCHEME})?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)


def same_site(a: Column, b: Column) -> Column:
    return site_of(a) == site_of(b)


def normalize_url(url: Column) -> Column:
    """Drop the fragment; strip trailing slashes only when the path is empty or '/'."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.when(path_of(u).isin("", "/"), F.rtrim(u, F.lit("/"))).otherwise(u)


def _remove_dots_sql(path: str) -> str:
    """Resolve '.' and '..' segments of an absolute path; the root has no parent."""
    kept = f"""aggregate(split(substring({path}, 2), '/'), cast(array() AS array<string>), (acc, s) ->
      CASE WHEN s = '.' THEN acc WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) ELSE array_append(acc, s) END)"""
    closing = rf"if({path} rlike r'(^|/)\.\.?$', array(''), cast(array() AS array<string>))"
    return rf"""CASE WHEN {path} rlike r'(^|/)\.\.?(/|$)' THEN concat('/', array_join(concat({kept}, {closing}), '/'))
      ELSE {path} END"""


def _resolve_sql() -> str:
    scheme, origin = f"regexp_extract(u.base, r'^{SCHEME}', 0)", f"regexp_extract(u.base, r'^{SCHEME}//[^/?#]*', 0)"
    base_path = rf"regexp_extract(u.base, r'^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)', 1)"
    rel, rest = "regexp_extract(u.ref, '^[^?#]*', 0)", "regexp_extract(u.ref, '^[^?#]*(.*)$', 1)"
    merged = f"regexp_replace(concat('/', regexp_replace(regexp_replace({base_path}, '[^/]*$', ''), '^/', ''), {rel}), '//+', '/')"
    return rf"""u -> CASE
      WHEN u.ref = '' THEN u.base
      WHEN u.ref rlike r'^{SCHEME}' THEN u.ref
      WHEN startswith(u.ref, '//') THEN concat({scheme}, u.ref)
      WHEN startswith(u.ref, '#') THEN concat(regexp_replace(u.base, '(?s)#.*$', ''), u.ref)
      WHEN startswith(u.ref, '?') THEN concat(regexp_replace(u.base, '(?s)[?#].*$', ''), u.ref)
      WHEN startswith(u.ref, '/') THEN concat({origin},
        element_at(transform(array({rel}), q -> {_remove_dots_sql("q")}), 1), {rest})
      ELSE concat({origin}, element_at(transform(array({merged}), q -> {_remove_dots_sql("q")}), 1), {rest}) END"""


RESOLVE = _resolve_sql()


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a reference found on page ``base`` (RFC 3986 joining)."""
    ref = F.regexp_replace(F.regexp_replace(F.coalesce(href, F.lit("")), r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return let_sql(F.struct(base.alias("base"), ref.alias("ref")), RESOLVE)


def is_followable(url: Column, site: Column) -> Column:
    """True for same-site URLs that match neither skip rule."""
    return (site_of(url) == site) & ~url.rlike(SKIP_EXTENSIONS) & ~url.rlike(SKIP_PATHS)


def classify_social(href: Column, match: str = "contains") -> Column:
    """array<struct(type, value)>: one entry per social network the link points to.

    ``match='contains'`` is a plain substring test, so 'netflix.com' counts as 'x.com';
    ``match='host'`` accepts only the domain itself and its subdomains.
    """
    def hit(domain: str) -> Column:
        if match == "host":
            host = F.lower(site_of(href))
            return (host == domain) | F.endswith(host, F.lit("." + domain))
        return F.contains(href, F.lit(domain))

    rows = [
        F.when(hit(d), F.struct(F.lit(f"social:{n}").alias("type"), href.alias("value")))
        for d, n in SOCIAL_DOMAINS.items()
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())
