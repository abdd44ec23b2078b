"""Dates: parsing of exact and relative text against a given moment, ages and presets. Nothing reads the clock."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESETS = {"6h": 6, "12h": 12, "18h": 18, "24h": 24, "7d": 7 * 24, "14d": 14 * 24, "21d": 21 * 24, "1m": 30 * 24}
GHOST_HIGH, GHOST_MEDIUM = 45, 30


def moment(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def back(as_of: datetime | Column, hours: int) -> Column:
    return moment(as_of) - F.expr(f"interval {hours} hours")


def parse_posted(raw: Column, as_of: datetime | Column) -> Column:
    """A struct of ``ts`` and ``estimated``: ISO text is exact; "Posted 3 days ago", "yesterday" and the like are estimated; else null and false."""
    text = F.lower(F.trim(raw))
    exact = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(F.trim(raw)))
    loose = F.regexp_replace(text, r"^posted\s+(?:on\s+)?", "")
    number = F.regexp_extract(loose, r"^(?:about\s+|over\s+)?(\d+|an?)\+?\s+(?:minute|min|hour|day|week|month|year)s?\s+ago", 1)
    many = F.when(number.isin("a", "an"), 1).otherwise(number.try_cast("int"))
    unit = F.regexp_extract(loose, r"(minute|min|hour|day|week|month|year)s?\s+ago", 1)
    now = moment(as_of)
    step = F.when(unit.isin("minute", "min"), now - F.make_dt_interval(mins=many))
    step = step.when(unit == "hour", now - F.make_dt_interval(hours=many)).when(unit == "day", now - F.make_dt_interval(days=many))
    step = step.when(unit == "week", now - F.make_dt_interval(days=many * 7)).when(unit == "month", now - F.make_ym_interval(months=many)).when(unit == "year", now - F.make_ym_interval(years=many))
    loosely = F.when(loose.isin("today", "just now", "now", "just posted"), now).when(loose == "yesterday", now - F.expr("interval 1 day")).when(many.isNotNull(), step)
    return F.struct(F.coalesce(exact, loosely).alias("ts"), (exact.isNull() & loosely.isNotNull()).alias("estimated"))


def age_days(ts: Column, as_of: datetime | Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(moment(as_of)) - F.unix_micros(ts)) / 86_400_000_000)).cast("int")


def age_days_or_null(ts: Column, as_of: datetime | Column) -> Column:
    return F.when(ts.isNotNull(), age_days(ts, as_of))


def ghost_risk(ts: Column, as_of: datetime | Column) -> Column:
    age = age_days_or_null(ts, as_of)
    return F.when(age > GHOST_HIGH, "high").when(age > GHOST_MEDIUM, "medium").otherwise("low")


def freshness_kind(source: Column, estimated: Column) -> Column:
    return F.when(F.coalesce(estimated, F.lit(False)), "estimated").when(source == "greenhouse", "updated").otherwise("posted")


def range_to_dates(name: str | None, first: str | None = None, last: str | None = None) -> tuple[date | None, date | None, str | None]:
    """First day, last day and preset of a range's name; ISO days count for "custom" only, and an unknown name asks for nothing."""
    if name in PRESETS:
        return None, None, name
    if name == "custom":
        return date.fromisoformat(first) if first else None, date.fromisoformat(last) if last else None, None
    return None, None, None


def window_of(column: Column, as_of: datetime, preset: str | None, first: date | None, last: date | None) -> Column | None:
    """Strictly after a preset's start; else from the first day to the end of the last. An unknown preset counts as none."""
    if preset in PRESETS:
        return column > back(as_of, PRESETS[preset])
    out = None
    if first:
        out = column >= F.lit(first.isoformat()).cast("timestamp")
    if last:
        upto = column < F.date_add(F.lit(last.isoformat()).cast("date"), 1).cast("timestamp")
        out = upto if out is None else out & upto
    return out


def period(ts: Column, kind: str = "day") -> Column:
    return F.date_format(ts, "yyyy-MM" if kind == "month" else "yyyy-MM-dd")
