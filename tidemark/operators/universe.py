"""Index membership at any past date from the current set and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import is_weekday


def membership_intervals(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Half-open spans [valid_from, valid_to) in which a ticker was a member.

    Undoing the log backwards means: at T the earliest event after T decides
    (removed: was in; added: was not; both on one day: was in), and with no later
    event the current set does. Events are first combined per (ticker, day), so a
    ticker's window is bounded by the calendar.
    """
    days = changes.groupBy("ticker", "date").agg(F.bool_or(F.col("action") == "removed").alias("was_in"))
    w = Window.partitionBy("ticker").orderBy("date")
    spans = days.select("ticker", F.lag("date", 1).over(w).alias("valid_from"), F.col("date").alias("valid_to"), F.col("was_in").alias("member"))
    last = days.groupBy("ticker").agg(F.max("date").alias("valid_from"))
    tail = current.select("ticker").distinct().join(last, "ticker", "left").select(
        "ticker", "valid_from", F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("member"))
    return spans.where("member").unionByName(tail).select("ticker", "valid_from", "valid_to")


def members_on(current: DataFrame, changes: DataFrame, date: str) -> DataFrame:
    """The members at one date."""
    d = F.lit(date).cast("date")
    iv = membership_intervals(current, changes)
    return iv.where((F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (d < F.col("valid_to")))).select("ticker").distinct()


def members_ever(current: DataFrame, changes: DataFrame, start: str, end: str) -> DataFrame:
    """Members at the start, plus every ticker named in an event of the range."""
    inside = changes.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return members_on(current, changes, start).unionByName(inside.select("ticker")).distinct()


def members_daily(current: DataFrame, changes: DataFrame, start: str, end: str, *, weekdays_only: bool = True) -> DataFrame:
    """(date, ticker) for every business day, expanded from the spans in one job."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    iv = membership_intervals(current, changes).select(
        "ticker", F.greatest(F.coalesce("valid_from", lo), lo).alias("a"),
        F.least(F.coalesce(F.date_sub("valid_to", 1), hi), hi).alias("b")).where(F.col("a") <= F.col("b"))
    days = iv.select(F.explode(F.sequence("a", "b")).alias("date"), "ticker")
    return days.where(is_weekday("date")) if weekdays_only else days


def fetch_scope(current: DataFrame, changes: DataFrame, start: str, end: str, benchmark: str = "SPY") -> DataFrame:
    """U4: tickers ever in the index, and the benchmark."""
    ever = members_ever(current, changes, start, end)
    return ever.unionByName(ever.sparkSession.range(1).select(F.lit(benchmark).alias("ticker"))).distinct()
