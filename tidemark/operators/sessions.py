"""Calendars: dates, business days and exchange sessions as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Monday-to-Friday test; Spark numbers Sunday 1 .. Saturday 7.
def is_weekday(d: Column | str) -> Column:
    return F.dayofweek(d).between(2, 6)


def span(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row (start, end) from two ISO dates."""
    return spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def span_of(df: DataFrame, column: str) -> DataFrame:
    """One row (start, end): the range a date column covers."""
    return df.agg(F.to_date(F.min(column)).alias("start"), F.to_date(F.max(column)).alias("end"))


def calendar_dates(bounds: DataFrame) -> DataFrame:
    """Every date of the closed range (start, end)."""
    return bounds.select(F.explode(F.sequence("start", "end")).alias("date"))


def business_days(bounds: DataFrame) -> DataFrame:
    """Monday to Friday, holidays included."""
    return calendar_dates(bounds).where(is_weekday("date"))


def previous_business_day(d: Column | str) -> Column:
    back = F.when(F.dayofweek(d) == 2, 3).when(F.dayofweek(d) == 1, 2).otherwise(1)
    return F.date_sub(d, back)


def next_business_day(d: Column | str) -> Column:
    ahead = F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1)
    return F.date_add(d, ahead)


def business_day_index(d: Column | str) -> Column:
    """Number of the last business day on or before d (consecutive integers)."""
    d = F.col(d) if isinstance(d, str) else d
    days = F.datediff(d, F.lit("1899-12-31").cast("date"))  # a Sunday
    week, dow = F.floor(days / 7), F.pmod(days, F.lit(7))
    return (week * 5 + F.least(dow, F.lit(5))).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the century-correction computus."""
    golden = year % 19
    century = F.floor(year / 100)
    epact = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    late = F.floor(epact / 28) * (1 - F.floor(F.lit(29) / (epact + 1)) * F.floor((21 - golden) / 11))
    moon = epact - late
    weekday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    offset = moon - weekday  # days from 28 March to the Sunday, -6 .. 28
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(28)), offset.cast("int"))


def _observed(d: Column) -> Column:
    return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def market_holidays(bounds: DataFrame) -> DataFrame:
    """Full-day exchange holidays: nine rules, ten from 2022, plus a New Year observed in December."""
    years = bounds.select(F.explode(F.sequence(F.year("start"), F.year("end"))).alias("y"))
    y = F.col("y")
    fixed = lambda m, d, yr=y: _observed(F.make_date(yr, F.lit(m), F.lit(d)))
    next_new_year = fixed(1, 1, y + 1)
    days = [
        fixed(1, 1),                                              # New Year
        _nth(y, 1, "Mon", 3),                                     # Martin Luther King Day
        _nth(y, 2, "Mon", 3),                                     # Presidents' Day
        F.date_sub(easter_sunday(y), 2),                          # Good Friday
        F.next_day(F.date_sub(F.make_date(y, F.lit(5), F.lit(31)), 7), "Mon"),  # Memorial Day
        F.when(y >= 2022, fixed(6, 19)),                          # Juneteenth
        fixed(7, 4),                                              # Independence Day
        _nth(y, 9, "Mon", 1),                                     # Labor Day
        _nth(y, 11, "Thu", 4),                                    # Thanksgiving
        fixed(12, 25),                                            # Christmas
        F.when(F.year(next_new_year) == y, next_new_year),
    ]
    return years.select(F.explode(F.array_compact(F.array(*days))).alias("date")).distinct()


def trading_sessions(bounds: DataFrame) -> DataFrame:
    """Weekdays that are not exchange holidays."""
    return business_days(bounds).join(market_holidays(bounds), "date", "left_anti")


def skipped_dates(bounds: DataFrame) -> DataFrame:
    """D3: dates of the range without a session."""
    return calendar_dates(bounds).join(trading_sessions(bounds), "date", "left_anti")


def sessions_back(dates: DataFrame, sessions: DataFrame, count: int) -> DataFrame:
    """For each date, the session `count` sessions before it (the date itself for 0).

    The session list is numbered in one window bounded by the calendar; dates meet
    it by number, never by a range join.
    """
    if count == 0:
        return dates.select("date", F.col("date").alias("session"))
    # every calendar position carries how many sessions lie strictly before it
    s = sessions.select("date", F.lit(1).alias("s"))
    marks = dates.select("date").distinct().join(s, "date", "full").select("date", F.coalesce("s", F.lit(0)).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select("date", "s", before.alias("n"))
    numbered = marks.where(F.col("s") == 1).select(F.col("n").alias("k"), F.col("date").alias("session"))
    wanted = marks.select("date", (F.col("n") - count).alias("k"))
    return dates.select("date").distinct().join(wanted, "date").join(numbered, "k", "left").select("date", "session")


def missing_boundary_ranges(bars: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """Per ticker the uncovered head and tail of the requested window."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    have = bars.where(F.col("date").between(lo, hi)).groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    head_end, tail_start = previous_business_day("first"), next_business_day("last")
    pieces = F.when(F.col("first").isNull(), F.array(F.struct(lo.alias("range_start"), hi.alias("range_end")))).otherwise(
        F.array_compact(F.array(
            F.when((F.col("first") > lo) & (head_end >= lo), F.struct(lo.alias("range_start"), head_end.alias("range_end"))),
            F.when((F.col("last") < hi) & (tail_start <= hi), F.struct(tail_start.alias("range_start"), hi.alias("range_end"))),
        )))
    return tickers.select("ticker").distinct().join(have, "ticker", "left").select("ticker", F.explode(pieces).alias("p")).select("ticker", "p.*")
