"""Time expressions: the platform's day, labels and countdowns.  ``as_of`` stands for now, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of relative times (one, two, three to ten) by unit.
UNITS = {
    "minute": ("دقيقة", "دقيقتين", "دقائق"), "hour": ("ساعة", "ساعتين", "ساعات"), "day": ("يوم", "يومين", "أيام"),
    "week": ("أسبوع", "أسبوعين", "أسابيع"), "month": ("شهر", "شهرين", "أشهر"),
}
#: Month names.
MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
#: The words around relative times.
AGO, JUST_NOW = "قبل", "قبل لحظات"


def riyadh_day(ts: Column) -> Column:
    """The calendar day in Riyadh of a UTC time (session time zone UTC)."""
    return F.to_date(ts + F.expr("interval 3 hours"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds, rounded down."""
    return F.floor(F.expr("0L") + F.timestamp_diff("MICROSECOND", earlier, later) / 1_000_000).cast("long")


def counted(n: Column, unit: str) -> Column:
    """A number with the form of the noun that it asks for."""
    one, two, few = UNITS[unit]
    return F.when(n == 1, one).when(n == 2, two).when(n.between(3, 10), F.concat_ws(" ", n, F.lit(few))).otherwise(F.concat_ws(" ", n, F.lit(one)))


def relative_label(ts: Column, as_of: Column) -> Column:
    """How long ago, in words; a date from a year on; times to come count as now."""
    s = F.greatest(F.lit(0), seconds_between(ts, as_of))
    m, h, d = (F.floor(s / x).cast("long") for x in (60, 3600, 86400))
    w, mo = F.floor(d / 7).cast("long"), F.floor(d / 30).cast("long")
    ago = lambda n, unit: F.concat_ws(" ", F.lit(AGO), counted(n, unit))
    date = F.concat_ws(" ", F.dayofmonth(ts), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts)), F.year(ts))
    return (
        F.when(ts.isNull(), "").when(s < 45, JUST_NOW).when(m < 60, ago(m, "minute")).when(h < 24, ago(h, "hour"))
        .when(d < 7, ago(d, "day")).when(w < 5, ago(w, "week")).when(mo < 12, ago(mo, "month")).otherwise(date)
    )


def active_label(ts: Column, as_of: Column) -> Column:
    """How recently a session was used."""
    m = F.floor(seconds_between(ts, as_of) / 60).cast("long")
    h, d = F.floor(m / 60).cast("long"), F.floor(m / 1440).cast("long")
    return (
        F.when(ts.isNull(), "").when(m < 2, "Active now").when(m < 60, F.concat(m, F.lit("m ago"))).when(h < 24, F.concat(h, F.lit("h ago")))
        .when(d < 30, F.concat(d, F.lit("d ago"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def remaining_seconds(last: Column, cooldown_seconds: int, as_of: Column) -> Column:
    """Seconds until a cooldown that began at ``last`` ends; 0 if it has, or never began."""
    return F.coalesce(F.greatest(F.lit(0).cast("long"), F.lit(cooldown_seconds) - seconds_between(last, as_of)), F.lit(0).cast("long"))


def remaining_label(seconds: Column) -> Column:
    """Days, hours, minutes and seconds."""
    part = lambda x, unit: F.concat(x.cast("long"), F.lit(unit))
    return F.concat_ws(" ", part(F.floor(seconds / 86400), "d"), part(F.floor(seconds % 86400 / 3600), "h"), part(F.floor(seconds % 3600 / 60), "m"), part(seconds % 60, "s"))


def clock(milliseconds: Column) -> Column:
    """HH:MM:SS, rounded up to whole seconds."""
    s = F.ceil(F.greatest(milliseconds, F.lit(0)) / 1000).cast("long")

    def two(x: Column) -> Column:
        digits = x.cast("long").cast("string")
        return F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0"))

    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")
