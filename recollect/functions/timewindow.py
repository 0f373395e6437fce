"""Windows of time from plain English; they are worked out on the driver, since a query is one string."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column

DAY = 86400
#: Months by name and short name, and seasons (first and last month) of the northern hemisphere.
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30.44, "year": 365.25}


@dataclass(frozen=True)
class Window:
    """Epoch seconds; half is the distance from the centre at which proximity is 0."""

    since: float
    until: float
    centre: float
    half: float


def _around(centre: float, half: float) -> Window:
    return Window(centre - half, centre + half, centre, half)


def _between(first: datetime, after: datetime) -> Window:
    since, until = first.timestamp(), after.timestamp() - 1
    half = (until - since) // 2
    return Window(since, until, since + half, half)


def _date(year: int, month: int) -> datetime:
    """The first of a month; months beyond December are of the next year."""
    return datetime(year + (month - 1) // 12, (month - 1) % 12 + 1, 1, tzinfo=timezone.utc)


def _month(year: int, month: int) -> Window:
    return _between(_date(year, month), _date(year, month + 1))


def _year(year: int) -> Window | None:
    return _between(_date(year, 1), _date(year + 1, 1)) if 1900 <= year <= 2100 else None


def _day(now: datetime, back: int) -> Window:
    since = (now - timedelta(days=back)).replace(hour=0, minute=0, second=0, microsecond=0).timestamp()
    return Window(since, since + DAY - 1, since + DAY / 2, DAY / 2)


def _last(n: str, unit: str, t: float) -> Window:
    days = int(n) * UNIT_DAYS[unit]
    half = days * DAY // 2
    return _around(t - (days * DAY / 2 if unit in ("day", "week") else half), half)


def _season(name: str, year: int) -> Window:
    first, last = SEASONS[name]
    return _between(_date(year, first), _date(year + (first > last), last + 1))


def _named_month(month: int, now: datetime) -> Window:
    """The last completed one."""
    return _month(now.year - (now.month <= month), month)


def _previous_month(now: datetime) -> Window:
    return _month(now.year - (now.month == 1), (now.month - 2) % 12 + 1)


def _rules() -> list[tuple[str, Callable]]:
    """Patterns in the order in which they are tried, and what makes a window of their groups, the time and the date."""
    week = lambda back: lambda g, t, d: _around(t - back * DAY, 3.5 * DAY)
    rules = [
        (r"today", lambda g, t, d: _day(d, 0)),
        (r"yesterday", lambda g, t, d: _day(d, 1)),
        (r"recently", lambda g, t, d: _around(t - 15 * DAY, 15 * DAY)),
        *((rf"last (\d+) {unit}s?", lambda g, t, d, unit=unit: _last(g[0], unit, t)) for unit in UNIT_DAYS),
        (r"last week", week(10.5)),
        (r"last month", lambda g, t, d: _previous_month(d)),
        (r"last year", lambda g, t, d: _year(d.year - 1)),
        (r"this week", week(3.5)),
        (r"this month", lambda g, t, d: _month(d.year, d.month)),
        (r"this year", lambda g, t, d: _year(d.year)),
        (r"past week", week(3.5)),
        (r"past month", lambda g, t, d: _previous_month(d)),
        (r"past year", lambda g, t, d: _year(d.year - 1)),
        *((rf"last ({name})", lambda g, t, d: _season(g[0], d.year - 1)) for name in SEASONS),
        *((rf"(?<![a-z])in\s+({name})", lambda g, t, d, n=n: _named_month(n, d)) for n, name in enumerate(MONTHS, 1)),
        *((rf"(?<![a-z])in\s+({name})", lambda g, t, d, n=n: _named_month(n, d)) for name, n in SHORT_MONTHS.items()),
        (r"(?<![a-z])in\s+(\d{4})", lambda g, t, d: _year(int(g[0]))),
        (r"^(\d{4})$", lambda g, t, d: _year(int(g[0]))),
    ]
    return [(re.compile(p, re.ASCII), f) for p, f in rules]


RULES = _rules()


def parse(query: str | None, as_of: datetime) -> Window | None:
    """The window of the first rule that finds one; as_of is taken as UTC where it has no zone."""
    if not query:
        return None
    now = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    for pattern, make in RULES:
        if (found := pattern.search(query.lower())) and (window := make(found.groups(), now.timestamp(), now)):
            return window
    return None


def windows_of(said: Column, as_of: datetime) -> Column:
    """centre, half of the window that each text names, null without one; in Arrow batches, each distinct text once."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<centre:double,half:double>")
    def run(values):
        import pandas as pd

        found = {x: parse(x, as_of) for x in values.dropna().unique()}
        rows = [found.get(x) for x in values]
        return pd.DataFrame({"centre": [float(w.centre) if w else None for w in rows], "half": [float(w.half) if w else None for w in rows]}, dtype="float64")

    return run(said)
