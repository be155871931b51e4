from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rotativa.functions import dates as d

NIGHT, EARLY = "2025-01-31T22:30:00-03:00", "2025-02-01T01:30:00Z"


@pytest.mark.parametrize(
    "mode,text,day",
    [
        ("local", NIGHT, date(2025, 1, 31)),
        ("written", NIGHT, date(2025, 1, 31)),
        ("utc", NIGHT, date(2025, 2, 1)),
        ("local", EARLY, date(2025, 1, 31)),
        ("written", EARLY, date(2025, 2, 1)),
        ("utc", EARLY, date(2025, 2, 1)),
        ("local", "2025-01-31", date(2025, 1, 30)),
        ("written", "2025-01-31", date(2025, 1, 31)),
        ("utc", "2025-01-31", date(2025, 1, 31)),
        ("utc", "2025-01-31T22:30:00-03", date(2025, 2, 1)),
        ("utc", "2025-01-31 22:30:00.250-0300", date(2025, 2, 1)),
    ],
)
def test_three_meanings_of_a_day(one, mode, text, day):
    assert one(d.day_of("s", mode), s=text) == day


@pytest.mark.parametrize("mode", ["local", "written", "utc"])
@pytest.mark.parametrize("text", ["Fecha no encontrada", "", None, "2025-13-01", "2025-02-30", "2025-01-31Tnoon"])
def test_bad_dates_are_null(one, mode, text):
    assert one(d.day_of("s", mode), s=text) is None


@pytest.mark.parametrize(
    "text,utc",
    [
        ("Fri, 31 Jan 2025 22:30:00 -0300", datetime(2025, 2, 1, 1, 30)),
        ("Sat, 01 Feb 2025 01:30:00 GMT", datetime(2025, 2, 1, 1, 30)),
        ("1 Feb 2025 01:30", datetime(2025, 2, 1, 1, 30)),
        ("Friday, 31 January 2025 20:30:00 EST", datetime(2025, 2, 1, 1, 30)),
        ("2025-02-01T01:30:00", datetime(2025, 2, 1, 1, 30)),
        (NIGHT, datetime(2025, 2, 1, 1, 30)),
        ("soon", None),
    ],
)
def test_feed_dates(one, text, utc):
    assert one(d.feed_utc("s"), s=text) == utc


def test_feed_date_falls_back_to_reading_time(one):
    read = F.lit("2025-03-01T12:00:00Z").cast("timestamp")
    assert one(d.feed_utc("s", read), s=None) == datetime(2025, 3, 1, 12)
    assert one(d.feed_utc("s", read), s="soon") == datetime(2025, 3, 1, 12)


def test_local_iso(one):
    assert one(d.local_iso(d.feed_utc("s")), s=EARLY) == NIGHT
    assert one(d.local_iso(d.feed_utc("s"), "Asia/Kolkata"), s=EARLY) == "2025-02-01T07:00:00+05:30"


@pytest.mark.parametrize(
    "text,expected",
    [
        (NIGHT, NIGHT),
        (EARLY, "2025-02-01T01:30:00+00:00"),
        ("2025-02-01", "2025-02-01T00:00:00"),
        ("2025-02-01 10:30", "2025-02-01T10:30:00"),
        ("2025-02-01T99:99:99Z", "2025-02-01T00:00:00"),
        ("ayer", None),
        (None, None),
    ],
)
def test_publication_iso(one, text, expected):
    assert one(d.publication_iso("s"), s=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("15 de abril 2025 - 14:30", datetime(2025, 4, 15, 14, 30)),
        ("1 de Enero 2025 - 9:05", datetime(2025, 1, 1, 9, 5)),
        ("31 diciembre 2024 23:59", datetime(2024, 12, 31, 23, 59)),
        ("31 de febrero 2025 - 10:00", None),
        ("15 de abril 2025", None),
        ("No encontrada", None),
        (None, None),
    ],
)
def test_spanish_dates(one, text, expected):
    assert one(d.spanish_timestamp("s"), s=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [(NIGHT, "2025-01-31"), ("ayer", "ayer"), ("", "Fecha no encontrada"), (None, "Fecha no encontrada")],
)
def test_day_or_raw(one, text, expected):
    assert one(d.day_or_raw("s"), s=text) == expected


def test_strict_and_lenient_days(one):
    assert one(d.parse_day("s"), s="nope") is None
    assert one(d.parse_day("s", "raise"), s="2025-01-05") == date(2025, 1, 5)
    assert one(d.parse_day("s", "raise"), s=None) is None
    with pytest.raises(Exception, match="bad date: nope"):
        one(d.parse_day("s", "raise"), s="nope")


def test_months(one):
    day = F.col("s").cast("date")
    assert one(d.year_month(day), s="2025-02-10") == "2025-02"
    assert one(d.month_start(day), s="2025-02-10") == date(2025, 2, 1)
    assert one(d.month_end(day), s="2024-02-10") == date(2024, 2, 29)


def test_days_do_not_depend_on_the_session_zone(spark, one):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert one(d.utc_day("s"), s=NIGHT) == date(2025, 2, 1)
            assert one(d.local_day("s"), s=EARLY) == date(2025, 1, 31)
            assert one(d.utc_wall(d.utc_instant(F.lit("2025-03-09T02:30:00").cast("timestamp_ntz")))) == datetime(2025, 3, 9, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
