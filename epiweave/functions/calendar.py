"""ISO-week arithmetic as column expressions. Years and weeks are integer columns, days are dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_year(day) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(day)).cast("int")


def iso_week(day) -> Column:
    return F.weekofyear(_col(day)).cast("int")


def weeks_in_year(year) -> Column:
    """52 or 53: 28 December always lies in the last ISO week."""
    return F.weekofyear(F.make_date(_col(year), F.lit(12), F.lit(28)))


def is_long_year(year) -> Column:
    return weeks_in_year(year) == 53


def monday(year, week) -> Column:
    """First day of an ISO week; null for a week its year does not have."""
    first = F.date_trunc("week", F.make_date(_col(year), F.lit(1), F.lit(4))).cast("date")
    valid = (_col(week) >= 1) & (_col(week) <= weeks_in_year(year))
    return F.when(valid, F.date_add(first, (7 * (_col(week) - 1)).cast("int")))


def sunday(year, week) -> Column:
    return F.date_add(monday(year, week), 6)


def dry_season(week, end: int = 17, start: int = 45) -> Column:
    return ((_col(week) <= end) | (_col(week) >= start)).cast("int")


def season_id(year, week, end: int = 17, start: int = 45) -> Column:
    """The year in which the dry season of the week began; null outside dry seasons."""
    return F.when(_col(week) >= start, _col(year)).when(_col(week) <= end, _col(year) - 1)


def in_window(year, week, first: int, last: int) -> Column:
    """Bounds are year * 100 + week, both inclusive."""
    return (_col(year) * 100 + _col(week)).between(first, last)


def harmonics(week, period: int = 52, order: int = 2) -> dict[str, Column]:
    """s1, c1, s2, c2 ...: sine and cosine of the week's angle and its multiples; 52 weeks even in long years."""
    angle = 2 * F.pi() * (_col(week) - 1) / period
    return {f"{n}{k}": f(k * angle) for k in range(1, order + 1) for n, f in (("s", F.sin), ("c", F.cos))}


def forecast_window(week_end, weeks: int = 4) -> tuple[Column, Column]:
    return F.date_add(_col(week_end), 1), F.date_add(_col(week_end), 7 * weeks)


def lead_window(data_monday, lead: int, weeks: int = 4) -> tuple[Column, Column]:
    """Target window by days from the Monday of the data week, so year ends need no care."""
    return F.date_add(_col(data_monday), 7 * lead), F.date_add(_col(data_monday), 7 * (lead + weeks) - 1)


def target_weeks(start, weeks: int = 4) -> Column:
    """The Mondays of the weeks of a window, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_add(_col(start), (7 * i).cast("int")))


def mmwr_end(data_monday) -> Column:
    """Saturday: a week counted Sunday to Saturday ends a day before the ISO week."""
    return F.date_sub(F.next_day(_col(data_monday), "SUN"), 1)


def week_key(year, week) -> Column:
    return F.format_string("%d-W%02d", _col(year), _col(week))


def parse_week_key(key) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(_col(key), r"^(\d{4})-W(\d{2})$", i).try_cast("int") for i in (1, 2))
