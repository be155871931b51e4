"""URL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotativa.functions.text import as_col


def url_path(c: Column | str) -> Column:
    """Path of a URL, empty when it has none; a malformed URL gives null, not an error."""
    url = as_col(c)
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(url.isNotNull(), F.coalesce(path, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)))


def has_base(c: Column | str, base: str) -> Column:
    return as_col(c).startswith(base)


def in_sections(c: Column | str, sections: list[str]) -> Column:
    """True when the path holds ``/section/`` for any of ``sections``, ignoring case; without sections, never."""
    path = F.lower(url_path(c))
    return reduce(lambda a, b: a | b, [path.contains(f"/{s.lower()}/") for s in sections], F.lit(False))


def first_segment(c: Column | str) -> Column:
    return F.nullif(F.split_part(F.ltrim(url_path(c), F.lit("/")), F.lit("/"), F.lit(1)), F.lit(""))


def nid(c: Column | str) -> Column:
    """Digits after ``-nid``, null when absent. They are a date in practice, not an article key."""
    return F.nullif(F.regexp_extract(as_col(c), r"-nid(\d+)", 1), F.lit(""))


def absolute_url(c: Column | str, host: Column | str) -> Column:
    """Prefix ``host`` (a literal text or a column) unless the link starts with ``http``."""
    link = as_col(c)
    prefix = F.lit(host) if isinstance(host, str) else host
    return F.when(link.startswith("http"), link).otherwise(F.concat(prefix, link))


def site_root(c: Column | str) -> Column:
    """``scheme://host`` of a URL."""
    return F.regexp_extract(as_col(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
