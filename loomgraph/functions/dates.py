"""Date parsing as Column expressions; every result is a UTC timestamp or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import let

# --- fixed values: the accepted ISO 8601 spellings and feed date formats ---------------
DAY = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
CLOCK = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
ZONE = r"(Z|[+-]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?|\d{2}(?:\d{2})?)?)"
ISO = rf"(?s)^{DAY}(?:.{CLOCK}{ZONE}?)?$"
FEED_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z")
# --- end of fixed values ----------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _number(c: Column, start: int, length: int) -> Column:
    return F.coalesce(F.substring(c, start, length).try_cast("int"), F.lit(0))


def _date(digits: Column) -> Column:
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def _day(text: Column, digits: Column) -> Column:
    year, week = F.substring(digits, 1, 4), _number(digits, 5, 2)
    day = F.when(F.length(digits) == 7, _number(digits, 7, 1)).otherwise(1)
    # Week 1 holds 4 January, the last week holds 28 December.
    by_week = let(
        _date(F.concat(year, F.lit("0104"))),
        lambda fourth: F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1),
    )
    in_year = week.between(1, F.weekofyear(_date(F.concat(year, F.lit("1228")))))
    return F.when(text.contains("W"), F.when(in_year, by_week)).otherwise(_date(digits))


def _clock(text: Column) -> Column:
    """``HH:mm:ss.ffffff`` of the local time."""
    fraction = F.regexp_extract(text, r"[.,](\d{1,6})", 1)
    hms = F.rpad(_digits(F.regexp_extract(text, r"^([0-9:]*)", 1)), 6, "0")
    return F.concat(
        F.substring(hms, 1, 2), F.lit(":"), F.substring(hms, 3, 2), F.lit(":"), F.substring(hms, 5, 2),
        F.lit("."), F.rpad(fraction, 6, "0"),
    )


def _offset_seconds(zone: Column) -> Column:
    digits = _digits(F.regexp_replace(zone, r"\..*$", ""))
    size = _number(digits, 1, 2) * 3600 + _number(digits, 3, 2) * 60 + _number(digits, 5, 2)
    return F.when(zone.startswith("-"), -size).otherwise(size)


def _parsed(c: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(local time, zone text, offset in seconds)`` of an ISO date-time."""
    parts = F.struct(*(F.regexp_extract(c, ISO, i).alias(n) for i, n in ((1, "day"), (2, "clock"), (3, "zone"))))
    read = let(
        parts,
        lambda p: F.struct(
            _day(p.day, _digits(p.day)).alias("date"), _clock(p.clock).alias("time"), p.zone.alias("zone"),
            _offset_seconds(p.zone).alias("offset"),
        ),
    )

    def local(r: Column) -> Column:
        valid = r.date.isNotNull() & (r.time < "24") & (F.abs(r.offset) < 86400)
        stamp = F.concat(F.date_format(r.date, "yyyy-MM-dd"), F.lit(" "), r.time)
        time = F.try_to_timestamp(F.when(valid, stamp), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        return let(time, lambda t: use(t, r.zone, r.offset))

    return let(read, local)


def parse_iso(c: Column) -> Column:
    """UTC timestamp of an ISO 8601 date or date-time (no zone means UTC); null otherwise."""
    return _parsed(
        c, lambda time, _, offset: F.timestamp_micros(F.unix_micros(time) - offset.cast("bigint") * 1_000_000)
    )


def iso_or_empty(c: Column) -> Column:
    """The date-time in one ISO spelling, '' when missing or unparseable."""

    def spell(time: Column, zone: Column, offset: Column) -> Column:
        seconds = F.abs(offset)
        rest = F.when(seconds % 60 > 0, F.format_string(":%02d", seconds % 60)).otherwise("")
        suffix = F.concat(
            F.when(offset < 0, "-").otherwise("+"),
            F.format_string("%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60),
            rest,
        )
        micros = F.regexp_replace(F.date_format(time, ".SSSSSS"), r"^\.0{6}$", "")
        return F.concat(
            F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.when(zone == "", "").otherwise(suffix)
        )

    return F.coalesce(_parsed(c, spell), F.lit(""))


def parse_feed_date(c: Column) -> Column:
    """UTC timestamp of a feed date: RFC 822 with or without weekday, else ISO 8601."""
    plain = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]+,\s*", ""))
    mail = [F.try_to_timestamp(plain, F.lit(pattern)) for pattern in FEED_FORMATS]
    return F.coalesce(*mail, parse_iso(F.trim(c)))


def iso_text(c: Column) -> Column:
    """A stored timestamp as ISO text, null when missing."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
