"""Civic time: all days are days in Los Angeles, every "now" is a parameter, timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"

_MONTHS = "January February March April May June July August September October November December".split()


def _clock_words(text: Column) -> Column:
    """Lower-case words of a text, with ``6:30 p. m.`` and the like as one word ``6:30pm``."""
    plain = F.regexp_replace(F.lower(text), r"\.", "")
    joined = F.regexp_replace(F.regexp_replace(plain, r"\b([ap]) m\b", "$1m"), r"([0-9])\s+(am|pm)\b", "$1$2")
    return F.split(joined, r"[^0-9a-z:]+")


def _clock(text: Column) -> tuple[Column, Column]:
    """Hour and minute that a text names: by the first word with a.m. or p.m., else by the first ``h:mm``, else midnight."""
    words = _clock_words(text)
    with_half = F.get(F.filter(words, lambda w: w.rlike("^[0-9]{1,2}(:[0-9]{2}){0,2}[ap]m$")), 0)
    said = F.coalesce(with_half, F.get(F.filter(words, lambda w: w.rlike("^[0-9]{1,2}(:[0-9]{2}){1,2}$")), 0))
    parts = F.split(F.regexp_replace(said, "[apm]", ""), ":")
    hour, minute = F.coalesce(F.get(parts, 0).cast("int"), F.lit(0)), F.coalesce(F.get(parts, 1).cast("int"), F.lit(0))
    return F.when(with_half.endswith("pm"), hour % 12 + 12).when(with_half.endswith("am") & (hour == 12), 0).otherwise(hour), minute


def parse_civic(date_text: Column, time_text: Column | None = None) -> Column:
    """UTC timestamp of ``m/d/yy[yy]`` or ``Month d, yyyy``, with the clock time that follows it if there is one; of other texts only with a zone; else null."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", date_text, *([time_text] if time_text is not None else [])), r"\s+", " "))
    numeric = r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b"
    named = r"(?i)\b(" + "|".join(m[:3] for m in _MONTHS) + r")[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
    month_of = F.array(*[F.lit(m[:3].lower()) for m in _MONTHS])
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    year = F.coalesce(F.when(F.length(part(numeric, 3)) == 2, F.concat(F.lit("20"), part(numeric, 3))).otherwise(part(numeric, 3)), part(named, 3))
    month = F.coalesce(part(numeric, 1), F.array_position(month_of, F.lower(part(named, 1))).cast("string"))
    day = F.coalesce(part(numeric, 2), part(named, 2))
    # numbers before the date are no clock
    after = F.when(part(numeric, 1).isNotNull(), F.get(F.split(text, numeric, 2), 1)).otherwise(F.get(F.split(text, named, 2), 1))
    hour, minute = _clock(F.coalesce(after, F.lit("")))
    local = F.format_string("%s-%s-%s %02d:%02d", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"), hour, minute)
    good = year.isNotNull() & month.isNotNull() & day.isNotNull()
    zoned = F.when(~good & text.rlike(r"(?i)(?:z|gmt|utc|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce(F.to_utc_timestamp(F.try_to_timestamp(F.when(good, local), F.lit("yyyy-MM-dd HH:mm")), ZONE), zoned)


def has_clock(text: Column) -> Column:
    """Whether a text names a time of day with a.m. or p.m."""
    return F.coalesce(F.exists(_clock_words(text), lambda w: w.rlike("^[0-9]{1,2}(:[0-9]{2})?[ap]m$")), F.lit(False))


def civic_day(ts: Column) -> Column:
    """The civic date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def civic_day_bounds(ts: Column) -> tuple[Column, Column]:
    """Start of the civic day and of the next, in UTC."""
    start = lambda day: F.to_utc_timestamp(day.cast("timestamp"), ZONE)
    return start(civic_day(ts)), start(F.date_add(civic_day(ts), 1))


def in_month_window(ts: Column, now: Column, back: int = 1, ahead: int = 1) -> Column:
    """From the start of the civic month ``back`` months before now's to the end of that ``ahead`` months after, half-open."""
    month = F.trunc(civic_day(now), "month")
    start = F.to_utc_timestamp(F.add_months(month, -back).cast("timestamp"), ZONE)
    end = F.to_utc_timestamp(F.add_months(month, ahead + 1).cast("timestamp"), ZONE)
    return (ts >= start) & (ts < end)


def is_upcoming(ts: Column, clock_known: Column, now: Column) -> Column:
    """With a known clock until three hours after; else through the civic day."""
    return F.when(clock_known, ts + F.expr("INTERVAL 3 HOURS") > now).otherwise(civic_day(ts) >= civic_day(now))


def effective_status(status: Column, section: Column, ts: Column, clock_known: Column, now: Column) -> Column:
    """Upcoming and Past follow the time; other statuses stay.  A record of today without a clock is Upcoming in the open sections."""
    today = ~clock_known & (civic_day(ts) == civic_day(now))
    moved = F.when(today, F.when(section.isin("All Meetings", "Unknown"), F.lit("Upcoming")).otherwise(status)).when(ts < now, F.lit("Past")).otherwise(F.lit("Upcoming"))
    return F.when(status.isin("Upcoming", "Past") & ts.isNotNull(), moved).otherwise(status)


def is_in_progress(ts: Column, clock_known: Column, now: Column) -> Column:
    """With a known clock from its start until three hours after."""
    return clock_known & (ts <= now) & (ts + F.expr("INTERVAL 3 HOURS") > now)


def is_fresh_for_digest(ts: Column, now: Column) -> Column:
    """Whether a time is not before the Monday, in UTC, of the week before now's."""
    return ts >= week_start(now) - F.expr("INTERVAL 7 DAYS")


def month_grid(month: Column) -> Column:
    """The 42 days, from a Sunday on, of the calendar page of a day's month."""
    first = F.trunc(month, "month")
    start = F.date_sub(first, F.dayofweek(first) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(41)), lambda i: F.date_add(start, i))


def week_start(ts: Column) -> Column:
    """The UTC Monday of a timestamp's week."""
    return F.date_trunc("week", ts)


def is_due(last_sent: Column, created: Column, frequency: Column, now: Column) -> Column:
    """Weekly: not yet in this calendar week; daily: not in the last 24 hours; counted from creation if never sent."""
    since = F.coalesce(last_sent, created)
    return F.when(frequency == "weekly", since < week_start(now)).otherwise(since <= now - F.expr("INTERVAL 24 HOURS"))


def active_between(starts: Column, ends: Column, now: Column) -> Column:
    """Whether now lies in an interval whose missing ends are open."""
    return (starts.isNull() | (starts <= now)) & (ends.isNull() | (ends >= now))


def school_year(day: Column) -> Column:
    """``2024-2025`` for July 2024 to June 2025."""
    first = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))
