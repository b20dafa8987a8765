"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def is_valid(url: Column) -> Column:
    """Whether scheme and host are both there; null for null."""
    return (scheme(url) != "") & (host(url) != "")


def collapse(p: Column) -> Column:
    """An absolute path without '.', '..', empty segments and trailing slash; '/' if nothing is left."""
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def normalize(url: Column, parent: Column) -> Column:
    """The absolute form of ``url`` as found on the page ``parent``; null if it names no http page.

    Absolute URLs stay as they are, query and fragment included.  Protocol-
    relative ones take the parent's scheme.  Root-relative and relative ones are
    resolved against the parent; their query and fragment are dropped.
    """
    u = F.trim(url)
    base = F.concat(scheme(parent), F.lit("://"), host(parent))
    bare = F.regexp_extract(u, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path(parent), r"^(.*/)[^/]*$", 1)
    rel = F.concat(F.when(folder == "", "/").otherwise(folder), bare)
    return (
        F.when(u.rlike(r"(?i)^https?://[^/?#]+"), u)
        .when(u.rlike(r"^//[^/?#]+"), F.concat(scheme(parent), F.lit(":"), u))
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | u.startswith("//"), F.lit(None).cast("string"))
        .when(~is_valid(parent), F.lit(None).cast("string"))
        .when(u.startswith("/"), F.concat(base, bare))
        .when(bare == "", F.concat(base, path(parent)))
        .otherwise(F.concat(base, collapse(rel)))
    )


def http_date(c: Column) -> Column:
    """Timestamp of an RFC-1123 date such as 'Sun, 06 Nov 1994 08:49:37 GMT'; null where it isn't one."""
    bare = F.regexp_extract(c, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))
