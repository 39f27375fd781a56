"""Vintage macro series: as-of levels, snapshots and market-wide features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import safe_div
from tidemark.operators.asof import asof_join

# Feature name -> published series id.
SERIES_BY_FEATURE = {
    "fed_funds_rate": "FEDFUNDS",
    "treasury_3m": "DGS3MO",
    "treasury_2y": "DGS2",
    "treasury_10y": "DGS10",
    "vix_level": "VIXCLS",
    "dollar_index": "DTWEXBGS",
    "cpi_level": "CPIAUCSL",
    "high_yield_spread": "BAMLH0A0HYM2",
}

MACRO_FEATURES = [
    "fed_funds_rate", "fed_funds_rate_change_5d", "treasury_3m", "treasury_2y", "treasury_10y",
    "treasury_10y_change_5d", "yield_curve_slope_10y_2y", "yield_curve_slope_10y_3m", "vix_level",
    "vix_change_5d", "dollar_index", "dollar_index_change_5d", "cpi_level", "cpi_change_yoy", "high_yield_spread",
]

CHANGE_ROWS = 5
YEAR_ROWS = 252


def _with_series(dates: DataFrame, series: list[str]) -> DataFrame:
    """One row per (date, series); the series list is a short parameter."""
    return dates.select("date").distinct().select("date", F.explode(F.array(*[F.lit(s) for s in sorted(set(series))])).alias("series_id"))


def macro_asof(macro: DataFrame, dates: DataFrame, series: list[str]) -> DataFrame:
    """Per (date, series) the newest observation known strictly before the date.

    A row is known from the day after both its observation and its release; the
    answer is the largest (observation, release) among known rows, so a running
    maximum over visibility days replaces the two-sided range join. Rows that
    become visible on one day are combined before the shuffle.
    """
    dated = F.col("observation_date").isNotNull() & F.col("realtime_start").isNotNull()
    known = macro.where(dated & ~F.col("is_missing") & F.col("value").isNotNull() & F.col("series_id").isin(sorted(set(series)))).withColumn(
        "visible_from", F.date_add(F.greatest("observation_date", "realtime_start"), 1))
    return asof_join(
        _with_series(dates, series), known, on=["series_id"], left_time="date", right_time="visible_from",
        take=["value", "observation_date", "realtime_start"],
        running_max=["observation_date", "realtime_start", "retrieved_at", "value"],
    )


def macro_snapshots(macro: DataFrame, days: DataFrame, series: list[str]) -> DataFrame:
    """A10 (A9 for one day): per (day, series) the latest row released on or before the day."""
    known = macro.where(F.col("observation_date").isNotNull() & F.col("realtime_start").isNotNull() & F.col("series_id").isin(sorted(set(series)))).withColumn(
        "visible_from", F.greatest("observation_date", "realtime_start"))
    rows = asof_join(
        _with_series(days, series), known, on=["series_id"], left_time="date", right_time="visible_from",
        take=["observation_date", "realtime_start", "realtime_end", "retrieved_at", "value", "is_missing"],
        running_max=["observation_date", "realtime_start", "realtime_end", "retrieved_at"],
    )
    return rows.where(F.col("observation_date").isNotNull()).withColumnRenamed("date", "snapshot_date")


def available_series_by_date(macro: DataFrame, days: DataFrame, series: list[str]) -> DataFrame:
    """Sorted list of series with a released row per date (bounded by the series parameter)."""
    s = macro_snapshots(macro, days, series)
    have = s.groupBy("snapshot_date").agg(F.sort_array(F.collect_set("series_id")).alias("series"))
    return days.select("date").distinct().join(have, F.col("date") == F.col("snapshot_date"), "left").select(
        "date", F.coalesce("series", F.array().cast("array<string>")).alias("series"))


def snapshot_usability(rows: DataFrame, required: list[str]) -> DataFrame:
    """Per stored shard day, whether its rows form a usable snapshot.

    `rows` carries shard_date beside the stored columns. Only counts and the set of
    required series present are kept, never the list of all series of a shard.
    """
    sid = F.upper(F.trim("series_id"))
    sid = F.when(sid == "", None).otherwise(sid)
    good = (F.col("observation_date") <= F.col("shard_date")) & (F.col("realtime_start") <= F.col("shard_date"))
    per_series = rows.select("shard_date", sid.alias("sid"),
                             (F.col("snapshot_date").isNull() | (F.col("snapshot_date") == F.col("shard_date"))).alias("own"),
                             F.coalesce(good, F.lit(False)).alias("ok")).groupBy("shard_date", "sid").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("own").alias("own"), F.bool_and("ok").alias("ok"))
    req = sorted({r.strip().upper() for r in required})
    return per_series.groupBy("shard_date").agg(
        F.sum("n").alias("rows"),
        F.bool_and("own").alias("own_snapshot_only"),
        F.bool_and(F.col("sid").isNotNull()).alias("no_blank_series"),
        F.bool_and(F.col("n") == 1).alias("no_duplicate_series"),
        F.bool_and("ok").alias("all_available"),
        (F.count_if(F.col("sid").isin(req)) == len(req)).alias("required_covered") if req else F.lit(True).alias("required_covered"),
    ).withColumn("usable", F.col("own_snapshot_only") & F.col("no_blank_series") & F.col("no_duplicate_series") & F.col("all_available") & F.col("required_covered"))


def change(x: Column | str, n: int = CHANGE_ROWS, spec=None) -> Column:
    """Level change over n rows of the date list."""
    return F.col(x) - F.lag(x, n).over(spec)


def macro_features(macro: DataFrame, dates: DataFrame, series: dict[str, str] | None = None) -> DataFrame:
    """Levels, five-row changes, slopes and the year change, one row per date.

    The market-wide window has no key; it is bounded by the number of dates.
    """
    series = series or SERIES_BY_FEATURE
    levels = macro_asof(macro, dates, list(series.values())).groupBy("date").agg(
        *[F.max(F.when(F.col("series_id") == sid, F.col("value"))).alias(name) for name, sid in series.items()])
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    base = F.lag("cpi_level", YEAR_ROWS).over(w)
    return levels.select(
        "date", "fed_funds_rate", change("fed_funds_rate", spec=w).alias("fed_funds_rate_change_5d"),
        "treasury_3m", "treasury_2y", "treasury_10y", change("treasury_10y", spec=w).alias("treasury_10y_change_5d"),
        (F.col("treasury_10y") - F.col("treasury_2y")).alias("yield_curve_slope_10y_2y"),
        (F.col("treasury_10y") - F.col("treasury_3m")).alias("yield_curve_slope_10y_3m"),
        "vix_level", change("vix_level", spec=w).alias("vix_change_5d"),
        "dollar_index", change("dollar_index", spec=w).alias("dollar_index_change_5d"),
        "cpi_level", safe_div(F.col("cpi_level") - base, base).alias("cpi_change_yoy"), "high_yield_spread",
    )


def context_start(dates: DataFrame, start: str, lookback: int = YEAR_ROWS) -> DataFrame:
    """Dates from `lookback` rows before the first date >= start onward."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = dates.select("date").distinct().select("date", F.row_number().over(w).alias("_rn"))
    anchor = F.min(F.when(F.col("date") >= F.lit(start).cast("date"), F.col("_rn"))).over(Window.partitionBy(F.lit(0)))
    return d.withColumn("_a", anchor).where(F.col("_rn") >= F.col("_a") - lookback).select("date")
