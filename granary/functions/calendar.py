"""Calendar features. Moving feasts come from a parameter table, one row for each event and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 14
#: Fixed values: (year, event, first day, last day).
FEASTS = [
    (2024, "ramadan", "2024-03-11", "2024-04-09"),
    (2025, "ramadan", "2025-03-01", "2025-03-30"),
    (2024, "eid_al_fitr", "2024-04-10", "2024-04-10"),
    (2025, "eid_al_fitr", "2025-03-31", "2025-03-31"),
    (2024, "eid_al_adha", "2024-06-17", "2024-06-17"),
    (2025, "eid_al_adha", "2025-06-06", "2025-06-06"),
]
#: Public holidays of 2024 and 2025 on fixed days and by decree.
HOLIDAYS = [
    "2024-01-01", "2024-02-08", "2024-02-10", "2024-03-11", "2024-03-29", "2024-03-31", "2024-04-10", "2024-04-11", "2024-05-01",
    "2024-05-09", "2024-05-23", "2024-06-01", "2024-06-17", "2024-07-07", "2024-08-17", "2024-09-16", "2024-12-25",
    "2025-01-01", "2025-01-27", "2025-01-29", "2025-03-29", "2025-03-31", "2025-04-01", "2025-04-18", "2025-04-20", "2025-05-01",
    "2025-05-12", "2025-05-29", "2025-06-01", "2025-06-06", "2025-06-27", "2025-08-17", "2025-09-05", "2025-12-25",
]


class Calendar:
    """Feasts and holidays as column expressions; small tables, so they become literals of the plan."""

    def __init__(self, feasts=FEASTS, holidays=HOLIDAYS):
        self.feasts, self.holidays = list(feasts), list(holidays)

    def _day(self, event: str, dt: Column, end: bool = False) -> Column:
        """The event's day in the date's year, null where the year has none."""
        pairs = [v for y, e, a, b in self.feasts if e == event for v in (F.lit(y), F.lit(b if end else a).cast("date"))]
        return F.try_element_at(F.create_map(*pairs), F.year(dt)) if pairs else F.lit(None).cast("date")

    def check_years(self, df: DataFrame, dt: str = "dt") -> None:
        """Raise unless every year of `df` has every kind of feast and a holiday."""
        have = {e: {y for y, x, *_ in self.feasts if x == e} for e in {x[1] for x in self.feasts}}
        have["holiday"] = {int(h[:4]) for h in self.holidays}
        years = {r[0] for r in df.select(F.year(dt)).where(F.col(dt).isNotNull()).distinct().collect()}
        for event, known in sorted(have.items()):
            if years - known:
                raise ValueError(f"the calendar has no {event} for {sorted(years - known)}")

    def basic(self, dt: Column) -> dict[str, Column]:
        return {
            "day_of_week": F.weekday(dt),
            "day_of_month": F.day(dt),
            "month": F.month(dt),
            "is_weekend": F.weekday(dt) >= 5,
            "is_national_holiday": dt.isin([F.lit(h).cast("date") for h in self.holidays]),
        }

    def ramadan(self, dt: Column) -> dict[str, Column]:
        a, b = self._day("ramadan", dt), self._day("ramadan", dt, end=True)
        inside = F.coalesce(dt.between(a, b), F.lit(False))
        return {"is_ramadan": inside, "days_into_ramadan": F.when(inside, F.datediff(dt, a)), "days_until_ramadan": F.when(dt < a, F.datediff(a, dt))}

    def _near(self, name: str, dt: Column, day: Column, next_: Column | None = None) -> dict[str, Column]:
        since, until = F.datediff(dt, day), F.datediff(day if next_ is None else next_, dt)
        out = {f"is_{name}": F.coalesce(dt == day, F.lit(False))}
        out[f"days_since_{name}"] = F.when(since.between(0, NEAR), since)
        out[f"days_until_{name}"] = F.when(until.between(0, NEAR), until)
        return out

    def feast(self, event: str, dt: Column) -> dict[str, Column]:
        return self._near(event, dt, self._day(event, dt))

    def fixed(self, dt: Column) -> dict[str, Column]:
        new_year = F.make_date(F.year(dt), F.lit(1), F.lit(1))
        coming = F.when(dt == new_year, new_year).otherwise(F.make_date(F.year(dt) + 1, F.lit(1), F.lit(1)))
        return self._near("independence_day", dt, F.make_date(F.year(dt), F.lit(8), F.lit(17))) | self._near("new_year", dt, new_year, coming)

    def add(self, df: DataFrame, dt: str = "dt", check: bool = True) -> DataFrame:
        """All calendar columns; raises for years that the calendar does not know unless `check` is false."""
        if check:
            self.check_years(df, dt)
        d = F.col(dt)
        return df.withColumns(self.basic(d) | self.ramadan(d) | self.feast("eid_al_fitr", d) | self.feast("eid_al_adha", d) | self.fixed(d))


def lead_time(dt: Column, ship_days: Column) -> Column:
    """Days to the next shipping day, 1 to 7, strictly ahead; null without a schedule."""
    days = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda d: F.array_contains(ship_days, (F.weekday(dt) + d) % 7))
    return F.when(ship_days.isNotNull(), F.array_min(days))


def is_delivery_day(dt: Column, ship_days: Column) -> Column:
    return F.coalesce(F.array_contains(ship_days, F.weekday(dt)), F.lit(False))


def weekend_days_ahead(dt: Column, days: Column) -> Column:
    """Saturdays and Sundays among the next `days` days; null for null."""
    ahead = F.filter(F.sequence(F.lit(1), days), lambda d: (F.weekday(dt) + d) % 7 >= 5)
    return F.when(days.isNotNull(), F.size(ahead))
