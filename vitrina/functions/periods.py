"""Report periods (O47): daily, weekly (weeks start on Sunday), monthly,
annual and custom ranges, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("daily", "weekly", "monthly", "annual")


def week_start(d: Column) -> Column:
    """Sunday on or before ``d`` (``date_trunc('week')`` would give Monday)."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def period_bounds(d: Column, period: str) -> tuple[Column, Column]:
    """(first day, last day) of the full period of type ``period`` holding ``d``."""
    d = d.cast("date")
    if period == "daily":
        return d, d
    if period == "weekly":
        s = week_start(d)
        return s, F.date_add(s, 6)
    if period == "monthly":
        return F.trunc(d, "month"), F.last_day(d)
    if period == "annual":
        s = F.trunc(d, "year")
        return s, F.date_sub(F.add_months(s, 12), 1)
    raise ValueError(f"unknown period {period!r}")


def report_period(period: str, as_of: Column, date_from: Column | None = None,
                  date_to: Column | None = None) -> tuple[Column, Column]:
    """(from, to) the report screen asks for on day ``as_of``: the period start
    up to ``as_of`` itself; 'custom' takes both ends as given."""
    as_of = as_of.cast("date")
    if period == "custom":
        if date_from is None or date_to is None:
            raise ValueError("custom period needs both dates")
        return date_from.cast("date"), date_to.cast("date")
    start, _ = period_bounds(as_of, period)
    return start, as_of


def report_periods_of_sales(ctx) -> DataFrame:
    """O47 for every day with sales: the range of each report type as asked for
    on that day; the custom range is ten days before to three days after."""
    days = ctx["ventas"].select(F.to_date("fecha").alias("as_of")).distinct()
    day = F.col("as_of")
    ends = [(p, *report_period(p, day)) for p in PERIODS]
    ends.append(("custom", *report_period("custom", day, F.date_sub(day, 10), F.date_add(day, 3))))
    rows = F.array(*[F.struct(F.lit(p).alias("periodo"), a.alias("desde"), b.alias("hasta")) for p, a, b in ends])
    return days.select("as_of", F.explode(rows).alias("p")).select("as_of", "p.*")
