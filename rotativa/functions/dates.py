"""Date expressions.

One text such as ``2025-02-01T01:30:00Z`` belongs to three different days: the day as written
(``written``), the UTC day (``utc``) and the day in the paper's zone (``local``). ``day_of``
takes the meaning as its ``mode``. Points in time are kept as TIMESTAMP_NTZ in UTC, so nothing here
depends on the session time zone, and every parser yields null on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotativa.constants import LOCAL_ZONE, MONTHS_ES, NO_DATE
from rotativa.functions.text import as_col, bind, clean_text, strip_space

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_OFFSET_AT_END = r":\d{2}(?:[.,]\d+)?\s?([+-]\d{2}(?::?\d{2})?)$"
_FEED_DATE = r"^([A-Za-z]+,? +)?\d{1,2} +[A-Za-z]{3,} +\d{4} +\d{1,2}:\d{2}"
_MONTHS_EN = "JanFebMarAprMayJunJulAugSepOctNovDec"
# Zone names of RFC 822; any other name counts as UTC.
_ZONES = {
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def utc_wall(instant: Column | str) -> Column:
    """UTC wall clock of a TIMESTAMP, as TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(as_col(instant)), epoch)


def utc_instant(wall: Column | str) -> Column:
    """TIMESTAMP of a TIMESTAMP_NTZ that shows UTC; the inverse of ``utc_wall``."""
    w = as_col(wall)
    seconds = F.datediff(w.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    seconds = seconds + F.hour(w) * 3600 + F.minute(w) * 60
    return F.timestamp_micros(seconds * 1_000_000 + (F.extract(F.lit("SECOND"), w) * 1_000_000).cast("long"))


def local_wall(utc: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock in ``zone`` of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(utc))


def _minus_offset(wall: Column, offset: Column) -> Column:
    """Wall clock minus an offset such as ``-03:00``, ``-0300`` or ``-03``; none if the text is empty."""

    def shifted(digits: Column) -> Column:
        minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
        return F.timestamp_add("MINUTE", minutes * F.when(digits.startswith("-"), 1).otherwise(-1), wall)

    return bind(F.rpad(F.replace(offset, F.lit(":"), F.lit("")), 5, "0"), lambda digits: F.when(digits == "00000", wall).otherwise(shifted(digits)))


def _iso_date_utc(s: Column) -> Column:
    # The cast keeps the clock as written and ignores the offset, which is applied afterwards.
    wall, offset = s.try_cast("timestamp_ntz"), F.regexp_extract(s, _OFFSET_AT_END, 1)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), _minus_offset(wall, offset))


def iso_utc(c: Column | str) -> Column:
    """UTC wall clock of an ISO 8601 text; without an offset it is taken as UTC."""
    return bind(strip_space(c), _iso_date_utc)


def _feed_date_utc(s: Column) -> Column:
    """UTC wall clock of ``Fri, 31 Jan 2025 22:30:00 -0300``, weekday and zone optional."""
    zones = F.create_map(*[F.lit(text) for pair in _ZONES.items() for text in pair])

    def from_parts(parts: Column) -> Column:
        day, month, year, clock, zone = (F.get(parts, F.lit(i)) for i in range(5))
        short = F.initcap(F.left(month, F.lit(3)))
        number = F.floor((F.instr(F.lit(_MONTHS_EN), short) + 2) / 3)
        text = F.concat(
            year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"),
            F.lit("T"), F.lpad(clock, F.when(F.length(clock) < 6, 5).otherwise(8), F.lit("0")),
        )
        offset = F.when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), zone).otherwise(F.try_element_at(zones, zone))
        return _minus_offset(text.try_cast("timestamp_ntz"), F.coalesce(offset, F.lit("")))

    parts = F.split(F.regexp_replace(s, r"^[A-Za-z]+,? +", ""), " +")
    return F.when(s.rlike(_FEED_DATE), bind(parts, from_parts))


def feed_utc(c: Column | str, fallback: Column | str | None = None) -> Column:
    """UTC wall clock of a feed date (RFC 822 or ISO; no zone means UTC).

    Missing or unreadable dates take the TIMESTAMP ``fallback``, the time the feed was read.
    """
    parsed = bind(strip_space(c), lambda s: F.coalesce(_iso_date_utc(s), _feed_date_utc(s)))
    return parsed if fallback is None else F.coalesce(parsed, utc_wall(fallback))


def written_day(c: Column | str) -> Column:
    """Day as written, whatever the offset; null unless the text is ISO 8601."""
    s = as_col(c)
    return F.when(s.rlike(_ISO), F.substring(s, 1, 10).try_cast("date"))


def utc_day(c: Column | str) -> Column:
    return iso_utc(c).cast("date")


def local_day(c: Column | str, fallback: Column | str | None = None, zone: str = LOCAL_ZONE) -> Column:
    return local_wall(feed_utc(c, fallback), zone).cast("date")


def day_of(c: Column | str, mode: str) -> Column:
    """Day of a date text under one of the meanings ``local``, ``written``, ``utc``."""
    return {"local": local_day, "written": written_day, "utc": utc_day}[mode](c)


def day_or_raw(c: Column | str) -> Column:
    """ISO day as text; unreadable text is kept, a missing date becomes the sentinel."""

    def made(s: Column) -> Column:
        return F.when(F.coalesce(s, F.lit("")) == "", NO_DATE).otherwise(F.coalesce(written_day(s).cast("string"), s))

    return bind(as_col(c), made)


def publication_iso(c: Column | str) -> Column:
    """Publication date in ISO form with the offset as written; falls back to the first ten chars."""

    def made(s: Column) -> Column:
        day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date").cast("string"))
        wall = F.replace(s.try_cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
        offset = F.when(s.endswith("Z"), "+00:00").otherwise(F.regexp_extract(s, _OFFSET_AT_END, 1))
        digits = F.rpad(F.replace(offset, F.lit(":"), F.lit("")), 5, "0")
        offset = F.when(offset != "", F.concat(F.left(digits, F.lit(3)), F.lit(":"), F.right(digits, F.lit(2)))).otherwise("")
        return F.coalesce(F.when(s.rlike(_ISO), F.concat(wall, offset)), F.concat(day, F.lit("T00:00:00")))

    return bind(as_col(c), made)


def _month_as_number(s: Column) -> Column:
    """The text with the first listed month name it contains written as a number."""
    numbered = s
    for name, number in reversed(list(MONTHS_ES.items())):
        numbered = F.when(s.contains(name), F.replace(s, F.lit(name), F.lit(f"{number:02d}"))).otherwise(numbered)
    return numbered


def spanish_timestamp(c: Column | str) -> Column:
    """``15 de abril 2025 - 14:30`` as TIMESTAMP_NTZ; null when it does not fit that layout."""

    def from_parts(parts: Column) -> Column:
        day, month, year, clock = (F.get(parts, F.lit(i)) for i in range(4))
        hour, minute = F.split_part(clock, F.lit(":"), F.lit(1)), F.split_part(clock, F.lit(":"), F.lit(2))
        text = F.concat(
            year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"),
            F.lit("T"), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":00"),
        )
        return text.try_cast("timestamp_ntz")

    def from_plain(plain: Column) -> Column:
        fits = plain.rlike(r"^\d{1,2} \d{1,2} \d{4} \d{1,2}:\d{1,2}$")
        return F.when(fits, bind(F.split(plain, " "), from_parts))

    def from_lower(s: Column) -> Column:
        plain = F.replace(F.regexp_replace(_month_as_number(s), r"(?U)\bde\b", ""), F.lit("-"), F.lit(""))
        return bind(clean_text(plain), from_plain)

    return bind(F.lower(as_col(c)), from_lower)


def parse_day(c: Column | str, errors: str = "coerce") -> Column:
    """``coerce`` gives null for a bad date; ``raise`` stops the job on the first one."""
    s = as_col(c)
    day = s.try_cast("date")
    if errors == "coerce":
        return day
    return F.when(s.isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("bad date: "), s)).cast("date")).otherwise(day)


def year_month(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "MM")


def month_end(c: Column | str) -> Column:
    return F.last_day(as_col(c))


def local_iso(utc: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """ISO text of a UTC wall clock on the wall clock of ``zone``, with its offset."""

    def made(utc: Column, wall: Column) -> Column:
        apart = wall - utc
        minutes = F.extract(F.lit("HOUR"), apart) * 60 + F.extract(F.lit("MINUTE"), apart)
        size = F.abs(minutes)
        return F.concat(
            F.replace(wall.cast("string"), F.lit(" "), F.lit("T")),
            F.when(minutes < 0, "-").otherwise("+"),
            F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((size % 60).cast("string"), 2, "0"),
        )

    return bind(as_col(utc), lambda u: bind(local_wall(u, zone), lambda wall: made(u, wall)))
