"""The anonymised calendar: texts ``0001-MM-DD HH:MM:SS`` and offsets in seconds.

Month lengths are not those of any Gregorian year (``0001-02-30`` is valid), so nothing here
goes through Spark timestamps. All functions are column expressions and stay in codegen.
"""

from pyspark.sql import Column, functions as F

DAY = 86400

# Days before months 1..9, and the day after the last one.
DAYS_BEFORE = [0, 31, 61, 92, 123, 152, 183, 213, 246]
LAST_DAY = 276

# First second of each month (days count from 1), and the end of the range.
MONTH_START = [(d + 1) * DAY for d in DAYS_BEFORE]
RANGE_END = (LAST_DAY + 1) * DAY


def _part(text, start, length):
    return F.substring(text, start, length).cast("int").cast("long")


def offset_within_month(text: Column) -> Column:
    """Seconds from the (zeroth day of the) month."""
    return (
        (_part(text, 9, 2) * 24 + _part(text, 12, 2)) * 60 + _part(text, 15, 2)
    ) * 60 + _part(text, 18, 5)


def offset_all_time(text: Column) -> Column:
    """Seconds from the (zeroth day of the) calendar; NULL for a month outside 1..9."""
    month = F.substring(text, 6, 2).cast("int")
    days = F.get(F.array(*[F.lit(d).cast("long") for d in DAYS_BEFORE]), month - 1)
    return days * DAY + offset_within_month(text)


def month_of(offset: Column) -> Column:
    """Month number 1..9 of an offset; NULL outside the calendar.

    A lookup by day keeps ``offset``, often a parsed text, to one occurrence."""
    lengths = [after - before for before, after in zip(DAYS_BEFORE, DAYS_BEFORE[1:] + [LAST_DAY])]
    by_day = [month for month, days in enumerate(lengths, 1) for _ in range(days)]
    return F.get(F.lit(by_day), F.floor(offset / DAY).cast("int") - 1)


def month_start(month: Column) -> Column:
    """First second of month 1..9; month 10 gives the end of the calendar."""
    return F.get(F.array(*[F.lit(s).cast("long") for s in MONTH_START + [RANGE_END]]), month - 1)


def offset_to_text(offset: Column) -> Column:
    """The text of an offset; NULL outside [86400, 23932800)."""
    month = month_of(offset)
    rest = offset - month_start(month)

    def two(value):
        return F.lpad(value.cast("long").cast("string"), 2, "0")

    return F.concat(
        F.lit("0001-"), two(month), F.lit("-"), two(F.floor(rest / DAY) + 1),
        F.lit(" "), two(F.floor(rest % DAY / 3600)),
        F.lit(":"), two(F.floor(rest % 3600 / 60)),
        F.lit(":"), two(rest % 60),
    )


def month_key(text: Column) -> Column:
    """``0001-MM``."""
    return F.substring(text, 1, 7)


def time_diff(failed: Column, error: Column) -> Column:
    """Seconds from an error text to a failure text."""
    return offset_all_time(failed) - offset_all_time(error)


def lead_class(seconds: Column) -> Column:
    """1 for a lead time of at most five minutes, else 2."""
    return F.when(seconds / 60 <= 5, 1).otherwise(2)
