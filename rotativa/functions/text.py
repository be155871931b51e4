"""Text expressions. Whitespace means Unicode whitespace plus the ASCII separators 1C-1F."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotativa.constants import SENTINELS

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def strip_space(c: Column | str) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(as_col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column | str) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(as_col(c), rf"(?U){SPACE}+", " "))


def char_count(c: Column | str) -> Column:
    return F.length(F.coalesce(as_col(c), F.lit("")))


def word_count(c: Column | str) -> Column:
    """Whitespace-separated words; empty and null text have none."""
    return F.regexp_count(F.coalesce(as_col(c), F.lit("")), F.lit(rf"(?U){NOT_SPACE}+"))


def truncate_chars(c: Column | str, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def or_default(c: Column | str, default: str = "") -> Column:
    return F.coalesce(as_col(c), F.lit(default))


def null_if_sentinel(c: Column | str, sentinels: list[str] = SENTINELS) -> Column:
    """Null where the scraper wrote a "not found" text."""
    c = as_col(c)
    return F.when(~c.isin(*sentinels), c)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    c = as_col(c)
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def strip_site_suffix(c: Column | str, site: str) -> Column:
    """Drop a trailing " - SITE", ignoring case."""
    return F.regexp_replace(as_col(c), rf"(?iU)\s*-\s*\Q{site}\E\s*$", "")


def long_paragraphs(c: Column | str, min_chars: int = 40) -> Column:
    """Paragraphs longer than ``min_chars`` from an array of texts."""
    return F.filter(as_col(c), lambda p: F.length(p) > min_chars)


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """``str.format`` for columns: literals and ``{name}`` placeholders, concatenated."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)
