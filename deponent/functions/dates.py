"""Times of transcript rows: the six accepted spellings, clocks read from screens, dates and years of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The beginnings of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
_NAMED_DAY, _NAMED_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\b\.?(?:,?\s+(20\d{{2}})\b)?", rf"(?i)\b{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?:,?\s+(20\d{{2}})\b)?"
_ROW_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: |, |,)(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"


def row_time(c: Column) -> Column:
    """The timestamp of a transcript row (day/month/year, optional comma, seconds optional); null if it is no such time."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(s.rlike(_ROW_TIME), F.try_to_timestamp(F.regexp_replace(s, r",\s?", " "), F.when(s.rlike(r":\d{1,2}:"), "d/M/yyyy H:m:s").otherwise("d/M/yyyy H:m")))


def row_text(ts: Column) -> Column:
    """A timestamp as transcript rows write it."""
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


#: A clock on a screen: hours, a mark that may be missing between four signs, minutes, receipt marks; narrow letters stand for digits.
CLOCK = r"^\s*([0-9IJilOo](?:\s*[0-9IJilOo])?)\s*([:.,;*]?)\s*([0-9IJilOo]\s*[0-9IJilOo])\s*(?:(?:[vV][iI]?|✓|✔)\s*)*$"
#: A day and time anywhere in a text.
DAY_AND_TIME = r"(\d{1,2})/(\d{1,2})/20\d{2}\s*,?\s*(\d{1,2})[:.;,*](\d{2})"


def clock(c: Column) -> Column:
    """A clock read from a screen as HH:MM, receipt marks and misread digits allowed; null if it is none."""
    digits = lambda i: F.translate(F.regexp_replace(F.regexp_extract(c, CLOCK, i), r"\s", ""), "IJilOo", "111100")
    hour, minute, apart = digits(1), digits(3), F.regexp_extract(c, CLOCK, 2) != ""
    fits = (apart | (F.length(hour) == 2)) & hour.try_cast("int").between(0, 23) & minute.try_cast("int").between(0, 59)
    return F.when(fits, F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def forced_time(c: Column, visible_date: Column, year: Column) -> Column:
    """A row's time with the date visible on its screen, or with the given year where no date is visible; a text without a time stays."""
    said = F.regexp_replace(F.translate(F.regexp_replace(F.trim(c), r'^"+|"+$', ""), ";", ":"), r"\s+", " ")
    field = lambda i: F.lpad(F.regexp_extract(said, DAY_AND_TIME, i), 2, "0")
    whole = said.rlike(DAY_AND_TIME)
    at = F.when(whole, F.concat_ws(":", field(3), field(4))).otherwise(clock(said))
    day = F.coalesce(F.nullif(visible_date, F.lit("")), F.when(whole, F.concat_ws("/", field(1), field(2), year.cast("string"))))
    return F.coalesce(F.concat(day, F.lit(" "), at), said)


def trailing_time(c: Column) -> Column:
    """struct<text, time> of a text that ends with a clock after other words; the clock is null where there is none."""
    tail = F.nullif(F.regexp_extract(c, r"\s(\d{1,2}[:.,;*]\d{2})\s*(?:[✓✔vV]\s*)*$", 1), F.lit(""))
    at = clock(tail)
    return F.struct(F.when(at.isNull(), c).otherwise(F.regexp_replace(c, r"\s+\d{1,2}[:.,;*]\d{2}\s*(?:[✓✔vV]\s*)*$", "")).alias("text"), at.alias("time"))


def mail_date(c: Column, report_year: Column | None = None) -> Column:
    """The day of a mail's date line as DD/MM/YYYY: the year first, numbers with the day first (the month first only if it must be), or a month by name.

    A day and month without a year are of ``report_year``; null if the line names no day that exists.
    """
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    month = lambda p, i: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(part(p, i), 1, 3))), F.lit(0)).cast("string")
    year = lambda p, i: F.coalesce(part(p, i), report_year.cast("string") if report_year is not None else F.lit(None).cast("string"))
    made = lambda y, m, d: F.try_to_timestamp(F.concat(y, F.lit("-"), m, F.lit("-"), d), F.lit("y-M-d")).cast("date")
    first, numbers = r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/.-](\d{1,2})(?:[/.-](20\d{2}))?\b"
    day = F.coalesce(
        made(part(first, 1), part(first, 2), part(first, 3)),
        F.when(F.regexp_extract(c, first, 1) == "", F.coalesce(made(year(numbers, 3), part(numbers, 2), part(numbers, 1)), made(part(numbers, 3), part(numbers, 1), part(numbers, 2)))),
        made(year(_NAMED_DAY, 3), month(_NAMED_DAY, 2), part(_NAMED_DAY, 1)),
        made(year(_NAMED_MONTH, 3), month(_NAMED_MONTH, 1), part(_NAMED_MONTH, 2)),
    )
    return F.date_format(day, "dd/MM/yyyy")


def hour_repair(before: Column, here: Column, after: Column) -> Column:
    """A clock whose hour differs in one digit from that of both neighbours, with minutes between theirs, gets their hour."""
    hour, minute = (lambda c: F.substring(c, 1, 2)), (lambda c: F.substring(c, 4, 2))
    clocks = [c.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d$") for c in (before, here, after)]
    one = F.levenshtein(hour(here), hour(before)) == 1
    fits = minute(here).between(F.least(minute(before), minute(after)), F.greatest(minute(before), minute(after)))
    wrong = clocks[0] & clocks[1] & clocks[2] & (hour(before) == hour(after)) & (hour(here) != hour(before)) & one & fits
    return F.when(F.coalesce(wrong, F.lit(False)), F.concat(hour(before), F.lit(":"), minute(here))).otherwise(here)


def years(c: Column) -> Column:
    """The years from 2000 to 2099 that a text names, in order."""
    return F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), 1)


def report_dates(c: Column) -> Column:
    """The dates that a text names, by spelling: slashes or dashes with the day first, then the year first."""
    first = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"), 1), lambda x: F.try_to_timestamp(F.translate(x, "-", "/"), F.lit("d/M/yyyy")).cast("date"))
    second = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4}-\d{1,2}-\d{1,2})\b"), 1), lambda x: F.try_to_timestamp(x, F.lit("yyyy-M-d")).cast("date"))
    return F.filter(F.concat(first, second), lambda x: x.isNotNull())
