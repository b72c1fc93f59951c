"""Times, calendars and seasons as Column functions. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "America/Vancouver"
DAY_S, HOUR_S = 86_400, 3_600
REFERENCE_YEAR = 2001  # not a leap year: positions within a season and days of the year count on it
#: First and last month of each kind of season.
SEASONS = {"winter": (11, 4), "summer": (5, 10), "snow": (10, 6)}
SEASON_DAYS = {"winter": 181, "summer": 184, "snow": 273}


def to_utc_time(text: Column) -> Column:
    """ISO text, with or without a closing Z, as a UTC timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def iso_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_time(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.hour(local_time(ts, tz))


def local_to_utc(local: Column, tz: str = LOCAL_TZ) -> Column:
    """Wall-clock time as UTC; null where the clock skips it or shows it twice."""
    utc = F.to_utc_timestamp(local, tz)
    same = lambda hours: F.from_utc_timestamp(utc + F.make_dt_interval(hours=F.lit(hours)), tz) == local
    return F.when((F.from_utc_timestamp(utc, tz) == local) & ~same(1) & ~same(-1), utc)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def lead_day(later: Column, earlier: Column) -> Column:
    """Whole days, halves to the even day."""
    return F.rint(hours_between(later, earlier) / 24.0).cast("int")


def floor_to(ts: Column, hours: Column) -> Column:
    step = hours * F.lit(HOUR_S)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def round_to(ts: Column, hours: Column) -> Column:
    """To the nearest multiple, halves to the even one."""
    step = hours * F.lit(HOUR_S)
    return F.timestamp_seconds(F.rint(F.unix_micros(ts) / F.lit(1e6) / step).cast("long") * step)


def part_of_day(ts: Column, tz: str = LOCAL_TZ) -> Column:
    h = local_hour(ts, tz)
    return F.when(h < 6, "Night").when(h < 12, "Morning").when(h < 18, "Afternoon").when(h.isNotNull(), "Evening")


def season_of_year(ts: Column) -> Column:
    quarter = F.floor(F.pmod(F.month(ts), F.lit(12)) / 3)
    return F.when(quarter == 0, "Winter").when(quarter == 1, "Spring").when(quarter == 2, "Summer").when(quarter == 3, "Fall")


def _day_of_month(day: Column) -> Column:
    return F.when((F.month(day) == 2) & (F.dayofmonth(day) == 29), 28).otherwise(F.dayofmonth(day))


def day_of_year(day: Column) -> Column:
    """1 to 365; 29 February counts as the 28th."""
    return F.dayofyear(F.make_date(F.lit(REFERENCE_YEAR), F.month(day), _day_of_month(day)))


def in_season(day: Column, kind: str) -> Column:
    first, last = SEASONS[kind]
    m = F.month(day)
    return (m >= first) | (m <= last) if first > last else (m >= first) & (m <= last)


def season_year(day: Column, kind: str) -> Column:
    """The year in which the season of a date within it ends."""
    first, last = SEASONS[kind]
    return F.year(day) + F.when(F.month(day) >= first, 1).otherwise(0) if first > last else F.year(day)


def season_start(year: Column, kind: str) -> Column:
    first, last = SEASONS[kind]
    return F.make_date(year - 1 if first > last else year, F.lit(first), F.lit(1))


def season_months(kind: str) -> int:
    first, last = SEASONS[kind]
    return (last - first) % 12 + 1


def season_length(year: Column, kind: str) -> Column:
    """Days of a season, leap days counted."""
    if kind == "year":
        return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    start = season_start(year, kind)
    return F.datediff(F.add_months(start, season_months(kind)), start)


def season_position(day: Column, kind: str) -> Column:
    """Days since the season's first, on the reference calendar: 29 February shares the 28th's place."""
    first, last = SEASONS[kind]
    year = F.lit(REFERENCE_YEAR) + (F.when(F.month(day) < first, 1).otherwise(0) if first > last else F.lit(0))
    return F.datediff(F.make_date(year, F.month(day), _day_of_month(day)), F.make_date(F.lit(REFERENCE_YEAR), F.lit(first), F.lit(1)))


def season_label(year: Column, kind: str) -> Column:
    first, last = SEASONS[kind]
    text = year.cast("string")
    return F.concat((year - 1).cast("string"), F.lit("–"), F.substring(text, 3, 2)) if first > last else text


def latest_season(day: Column, kind: str) -> Column:
    """End year of the season under way on a day, or else of the last one that ended."""
    _, last = SEASONS[kind]
    return F.when(in_season(day, kind), season_year(day, kind)).otherwise(F.year(day) - F.when(F.month(day) > last, 0).otherwise(1))


def season_axis(kind: str) -> Column:
    """The reference calendar's dates of a season, one for each position."""
    first, _ = SEASONS[kind]
    start = F.make_date(F.lit(REFERENCE_YEAR), F.lit(first), F.lit(1))
    return F.sequence(start, F.date_add(start, SEASON_DAYS[kind] - 1))


def place_today(today: Column, kind: str) -> Column:
    """A day's position in the season under way, null outside of it."""
    return F.when(in_season(today, kind), season_position(today, kind))
