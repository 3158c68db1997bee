"""Scalar parsers as Column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, marks of missing figures, and the hours of named periods.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MISSING = ["", "X", "NA", "N/A", "NO DATA", "-"]
PERIOD_TIMES = {"morning": "10:30", "midday": "13:00", "afternoon": "16:00", "evening": "19:00", "am": "10:30", "pm": "19:00"}


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _int(c: Column, pattern: str, group: int) -> Column:
    return _part(c, pattern, group).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def _month(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c)).cast("int"), F.lit(0))


def archive_date(c: Column) -> Column:
    """D-Mon-Y with a year of two to four digits; two-digit years up to 79 are of this century."""
    p = r"^\s*(\d{1,2})-([A-Za-z]{3})-(\d{2,4})\s*$"
    y = _int(c, p, 3)
    year = F.when(y > 99, y).when(y <= 79, y + 2000).otherwise(y + 1900)
    return F.when(c.rlike(p), _date(year, _month(_part(c, p, 2)), _int(c, p, 1)))


def either_date(c: Column, hint: Column) -> Column:
    """YYYYMMDD, Y-M-D, or day and month in either order before the year; parts between slashes or dashes.

    Of two readings the nearest to hint is taken, on a tie the one not after it; the
    month comes first without a hint.
    """
    s, p, q = F.trim(c), r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    a, b, y = (_int(s, p, k) for k in (1, 2, 3))
    first, second = _date(y, a, b), _date(y, b, a)
    far = lambda x: F.abs(F.datediff(x, hint)) * 2 + (x > hint).cast("int")
    slash = F.when(first.isNull(), second).when(second.isNull() | hint.isNull() | (far(first) <= far(second)), first).otherwise(second)
    plain = F.try_to_timestamp(F.when(s.rlike(r"^\d{8}$"), s), F.lit("yyyyMMdd")).cast("date")
    year_first = F.when(s.rlike(q), _date(*(_int(s, q, k) for k in (1, 2, 3))))
    return F.coalesce(plain, year_first, F.when(s.rlike(p), slash))


def clock(c: Column) -> Column:
    """HH:MM of 12- or 24-hour times; minutes as they stand, hours over 23 are null."""
    s, p = F.lower(F.trim(c)), r"^(\d{1,2}):(\d{2})(?::\d{2})?\s*(am|pm)?$"
    h, half = _int(s, p, 1), _part(s, p, 3)
    hour = F.when((half == "pm") & (h != 12), h + 12).when((half == "am") & (h == 12), F.lit(0)).otherwise(h)
    return F.when(s.rlike(p) & (hour <= 23), F.format_string("%02d:%s", hour, _part(s, p, 2)))


def period(hhmm: Column) -> Column:
    h = F.substring(hhmm, 1, 2).try_cast("int")
    return F.when(h < 12, "Morning").when(h < 15, "Midday").when(h < 18, "Afternoon").when(h.isNotNull(), "Evening")


def normal_period(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "am", "Morning").when(s == "pm", "Evening").when(s != "", F.initcap(s))


def period_time(c: Column) -> Column:
    """The usual hour of a named period."""
    names = F.create_map(*[F.lit(x) for kv in PERIOD_TIMES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.trim(c)))


def cents(c: Column) -> Column:
    """Money text to integer cents, rounding half to even; marks of missing figures are null."""
    s = F.trim(F.regexp_replace(c, r"[$,]", ""))
    p = r"(?i)^(\d+(?:\.\d+)?)\s*(million|m|billion|b|k)?$"
    unit = F.lower(_part(s, p, 2))
    times = F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).when(unit == "k", 1e3).otherwise(1.0)
    return F.when(~F.upper(F.trim(c)).isin(*MISSING, "TBA") & s.rlike(p), F.rint(_part(s, p, 1).try_cast("double") * times * 100).cast("long"))


def cents_of_thousandths(c: Column) -> Column:
    """A figure in thousandths of a unit to cents; text that is no number is null."""
    return F.rint(F.trim(c.cast("string")).try_cast("double") / 10).cast("long")


def integer(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("int"))


def numbers(c: Column) -> Column:
    """Ball numbers of one to three digits between bars, dashes, commas, slashes or spaces."""
    kept = F.filter(F.split(c, r"[|\-,/\s]+"), lambda x: x.rlike(r"^\d{1,3}$"))
    return F.transform(kept, lambda x: x.cast("int"))


def header(c: Column) -> Column:
    """A column title in lower case with single spaces; the sign of the draw number falls away."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"^draw ?#$", "draw")


def winner_date(c: Column, today: Column) -> Column:
    """'Friday 9th January, 2026' and 'December 1st'; the latter in the latest of three years in which it is not after today."""
    full, short = r"(\d{1,2})(?:st|nd|rd|th)\s+([A-Z][a-z]{2})[a-z]*,?\s+(\d{4})", r"^\s*([A-Z][a-z]{2})[a-z]*\s+(\d{1,2})(?:st|nd|rd|th)\s*$"
    month, other = _month(_part(c, full, 2)), _month(_part(c, short, 1))
    near = F.array(*[_date(F.year(today) - k, other, _int(c, short, 2)) for k in range(3)])
    past = F.array_max(F.filter(near, lambda x: x <= today))
    return F.when(c.rlike(full) & month.isNotNull(), _date(_int(c, full, 3), month, _int(c, full, 1))).when(c.rlike(short), past)


def fingerprint(*cols: Column) -> Column:
    """SHA-1 of the fields between bars; null is empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
