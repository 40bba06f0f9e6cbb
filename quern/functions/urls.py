"""Functions on urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def authority(url: Column) -> Column:
    """Host and port of an absolute url, as written; null where there is none."""
    a = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)", 1)
    return F.when(F.length(a) > 0, a)


def site(url: Column) -> Column:
    """The host in lower case without user, port and leading `www.`; null where there is none."""
    s = F.regexp_replace(F.lower(authority(url)), r"^.*@", "")
    s = F.regexp_replace(F.regexp_replace(s, r":\d*$", ""), r"^www\.", "")
    return F.when(F.length(s) > 0, s)


def same_domain(a: Column, b: Column) -> Column:
    """Whether two urls have the same host and port."""
    return F.lower(authority(a)) == F.lower(authority(b))


def _without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def resolved(base: Column, link: Column) -> Column:
    """The absolute url of a link found on the page base: absolute, `//host`, `/path`, `?query`, `#part` or relative, with dots resolved."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1)
    origin = F.concat(scheme, F.lit("//"), F.coalesce(authority(base), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(bare, "[^/]*$", ""), "^/", ""))
    path, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    whole = F.concat(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)))
    whole = F.when(whole.contains("/."), _without_dots(whole)).otherwise(whole)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(origin, bare, link))
        .otherwise(F.concat(origin, whole, rest))
    )
