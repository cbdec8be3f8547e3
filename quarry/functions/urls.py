"""URL expressions: parts, canonical form, resolution, file names. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Beginnings of the names of tracking parameters.
TRACKING = "utm_|fbclid|gclid|msclkid|mc_cid|mc_eid"
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?"
SLUG_LENGTH = 80


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """With port and user, as written."""
    return part(url, 2)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters and default port; scheme and host in lower case; an empty path after a host is /."""
    return let(url, _normalized)


def _normalized(url: Column) -> Column:
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike(f"^(?:{TRACKING})"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    netloc = F.lower(host(url))
    netloc = F.when(scheme(url) == "http", F.regexp_replace(netloc, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(netloc, ":443$", "")).otherwise(netloc)
    path = F.when((part(url, 3) == "") & (netloc != ""), F.lit("/")).otherwise(part(url, 3))
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments applied."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    held = F.aggregate(segments, none, lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.when(F.get(a, F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0)), F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    last = F.element_at(segments, -1)
    return F.concat(F.array_join(held, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """A reference as seen from a base, after RFC 3986."""
    return let(F.struct(base.alias("base"), href.alias("href")), lambda x: _resolved(x["base"], x["href"]))


def _resolved(base: Column, href: Column) -> Column:
    root = F.concat(F.when(part(base, 1) != "", F.concat(part(base, 1), F.lit(":"))).otherwise(""), F.when(host(base) != "", F.concat(F.lit("//"), host(base))).otherwise(""))
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    folder = F.regexp_extract(part(base, 3), r"^(.*/)", 1)
    folder = F.when((folder == "") & (host(base) != ""), F.lit("/")).otherwise(folder)
    query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise("")
    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(href.startswith("?"), F.concat(root, part(base, 3), rest))
        .when(href.startswith("#"), F.concat(root, part(base, 3), query, rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def slugify(url: Column) -> Column:
    """A file name for a URL: host and path in safe characters, cut to SLUG_LENGTH, and six digits of the URL's hash."""
    stem = F.regexp_replace(F.concat(host(url), part(url, 3)), "^/+|/+$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}._-]", "-"), "^-+|-+$", "")
    stem = F.substring(stem, 1, SLUG_LENGTH)
    stem = F.regexp_replace(F.when(stem == "", F.lit("index")).otherwise(stem), r"\.html$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(url), 1, 6), F.lit(".html"))


def followable(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)
