"""URL parts and canonical forms as native column expressions; nothing here raises on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that say where a visit came from and not what the page is (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
#: scheme, authority, path, query (with its mark), fragment (with its mark)
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def bare_host(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def section(url: Column) -> Column:
    """The first path segment between slashes, or one slash."""
    first = F.regexp_extract(part(url, 3), r"^/+([^/]+)", 1)
    return F.when(first == "", F.lit("/")).otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tracking parameters, fragment or trailing slash; sorted query."""
    full = with_scheme(url)
    scheme, authority = F.lower(part(full, 1)), F.lower(F.regexp_replace(part(full, 2), r"^.*@", ""))
    site = F.when(scheme == "http", F.regexp_replace(authority, r":80$", "")).when(scheme == "https", F.regexp_replace(authority, r":443$", "")).otherwise(authority)
    pairs = F.split(F.regexp_replace(part(full, 4), r"^\?", ""), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    path = F.regexp_replace(part(full, 3), r"/+$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(scheme, F.lit("://"), site, F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(full.rlike(PARTS), made).otherwise(full)


def url_hash(url: Column) -> Column:
    """The first 16 hexadecimal digits of the normalized URL's SHA-256."""
    return F.substring(F.sha2(normalized(url).cast("binary"), 256), 1, 16)


def display(url: Column) -> Column:
    """scheme, host and path: what may be shown without giving credentials or tokens away."""
    return F.concat(part(url, 1), F.lit("://"), F.regexp_replace(part(url, 2), r"^.*@", ""), part(url, 3))


def reversed_host(name: Column) -> Column:
    """www.a.example -> example.a, as web-graph files write hosts."""
    return F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(F.trim(name)), r"^www\.", ""), r"\.")), ".")


def domain(raw: Column) -> Column:
    """A bare domain from what people type: no scheme, path or www., then lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^https?://", ""), r"/.*$", ""), r"^www\.", ""))


def encoded(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
