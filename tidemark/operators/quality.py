"""Liquidity and data-quality flags of the universe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bits import WORD, bit, longest_run, low_bits
from tidemark.functions.maths import by, safe_div
from tidemark.operators.asof import Look, asof_join, asof_many
from tidemark.operators.sessions import business_day_index, is_weekday


@dataclass(frozen=True)
class QualityLimits:
    rolling_window_days: int = 20
    min_average_dollar_volume: float = 1_000_000.0
    min_close_price: float = 5.0
    min_market_cap: float = 0.0
    max_single_day_move: float = 0.40
    max_consecutive_missing_bars: int = 3


def bar_statistics(bars: DataFrame, window: int = 20) -> DataFrame:
    """Trailing mean dollar volume (partial windows count) and absolute close move."""
    w = by("ticker", order="date")
    return bars.select(
        "ticker", "date", "close", "volume",
        F.avg("dollar_volume").over(w.rowsBetween(-(window - 1), 0)).alias("avg_dollar_volume"),
        F.abs(safe_div("close", F.lag("close", 1).over(w)) - 1.0).alias("move"),
    )


def latest_bar_asof(panel: DataFrame, bars: DataFrame, window: int = 20) -> DataFrame:
    """The statistics of the latest bar at or before each day, with its previous bar's move."""
    stats = bar_statistics(bars, window).withColumn("bar_date", F.col("date"))
    return asof_join(panel, stats.withColumnRenamed("date", "_bd"), on=["ticker"], left_time="date", right_time="_bd",
                     take=["bar_date", "close", "volume", "avg_dollar_volume", "move"])


def _blocks(window: int) -> tuple[int, int]:
    """Calendar days that hold `window` business days, and the 64-day blocks that they can touch."""
    days = (window + 4) // 5 * 7 + 2
    return days, (days // 7 * 5 + 10) // WORD + 2


def _block(day: Column) -> Column:
    return F.floor(day / WORD).cast("int")


def _seen_names(window: int) -> list[str]:
    return ["_block", *[f"_seen{k}" for k in range(_blocks(window)[1])]]


def seen_days(bars: DataFrame, window: int) -> DataFrame:
    """`bars` with the business days up to each bar that had one, as bits: `_block` is the bar's 64-day block, `_seen0` its word, `_seen1` the word of the block before, ...

    The frame holds bars only, a few rows: a day without a bar reads the words of the bar before it. Blocks go round a
    ring while they are gathered, one word more than a window can touch.
    """
    days, blocks = _blocks(window)
    near = by("ticker").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    day = business_day_index("date")
    df = bars.select("*", _block(day).alias("_block"), F.when(is_weekday("date"), day).alias("_i"))
    rings = [F.bit_or(F.when(F.pmod(_block(F.col("_i")), F.lit(blocks)) == r, bit(F.pmod("_i", F.lit(WORD))))).over(near).alias(f"_ring{r}") for r in range(blocks)]
    df = df.select(*[F.col(c) for c in bars.columns], "_block", *rings)
    word = lambda k: F.coalesce(*[F.when(F.pmod(F.col("_block") - k, F.lit(blocks)) == r, F.col(f"_ring{r}")) for r in range(blocks)], F.lit(0).cast("long"))
    return df.select(*[F.col(c) for c in bars.columns], "_block", *[word(k).alias(f"_seen{k}") for k in range(blocks)])


def _streak(df: DataFrame, window: int) -> DataFrame:
    """`df` with the longest run of days without a bar, from the words of its latest bar.

    Each row reads its own blocks, oldest first; those after the bar's are empty. Days outside the window count as present.
    """
    blocks = _blocks(window)[1]
    others = [c for c in df.columns if c not in _seen_names(window)]
    df = df.withColumn("_day", business_day_index("date"))
    df = df.withColumn("_own", _block(F.col("_day"))).withColumn("_after", F.col("_own") - F.col("_block"))
    missing = []
    for back in reversed(range(blocks)):
        start = (F.col("_own") - back) * WORD
        seen = F.coalesce(*[F.when(F.col("_after") == back - k, F.col(f"_seen{k}")) for k in range(back + 1)], F.lit(0).cast("long"))
        inside = low_bits(F.col("_day") + 1 - start).bitwiseAND(F.bitwise_not(low_bits(F.col("_day") + 1 - window - start)))
        missing.append(F.bitwise_not(seen).bitwiseAND(inside).alias(f"_missing{back}"))
    return longest_run(df.select(*others, *missing), [f"_missing{back}" for back in reversed(range(blocks))], "missing_streak")


def missing_streak(panel: DataFrame, bars: DataFrame, window: int = 20, *, tasks: int | None = None) -> DataFrame:
    """Longest run of business days without a bar among the last `window`, of any length.

    The window of a weekend day ends on the Friday before. Repeated bars and bars on weekends don't matter. `tasks` as in `asof_many`.
    """
    have = seen_days(bars.select("ticker", "date").distinct(), window)
    left = panel.select("ticker", "date").distinct()
    return _streak(asof_many(left, [Look(have, "date", before={c: c for c in _seen_names(window)})], on=["ticker"], left_time="date", tasks=tasks), window)


def bar_history(universe: DataFrame, bars: DataFrame, window: int = 20, shares: DataFrame | None = None, *, tasks: int | None = None) -> DataFrame:
    """J5, J4 and W24 in one pass: each day's latest bar and share count, and its longest run of missing days.

    Bars, share counts and universe rows meet in one union that is dealt by ticker once (`tasks` as in `asof_many`); the
    latest bar brings the words of the days present up to it.
    """
    stats = seen_days(bar_statistics(bars, window), window).withColumn("bar_date", F.col("date"))
    looks = [Look(stats, "date", before={c: c for c in ("bar_date", "close", "volume", "avg_dollar_volume", "move", *_seen_names(window))})]
    if shares is not None:
        looks.append(Look(shares, "availability_date", before={"shares_outstanding": "shares_outstanding"}))
    return _streak(asof_many(universe, looks, on=["ticker"], left_time="date", tasks=tasks), window)


def quality_flags(universe: DataFrame, bars: DataFrame, limits: QualityLimits = QualityLimits(), shares: DataFrame | None = None, *, tasks: int | None = None) -> DataFrame:
    """Q1: liquid, data_quality_ok, halted and reason of every (date, ticker) row; `tasks` as in `asof_many`."""
    capped = limits.min_market_cap > 0
    df = bar_history(universe.withColumn("ticker", F.upper("ticker")), bars, limits.rolling_window_days, shares if capped else None, tasks=tasks)
    if capped and shares is None:
        df = df.withColumn("shares_outstanding", F.lit(None).cast("double"))
    has = F.col("bar_date").isNotNull()
    no_bars, thin = ~has, has & (F.col("avg_dollar_volume") < limits.min_average_dollar_volume)
    cheap = has & (F.col("close") < limits.min_close_price)
    if capped:
        cap_none = has & F.col("shares_outstanding").isNull()
        cap_low = has & F.coalesce(F.col("close") * F.col("shares_outstanding") < limits.min_market_cap, F.lit(False))
    else:
        cap_none = cap_low = F.lit(False)
    zero = has & (F.col("volume") == 0)
    jump = has & F.coalesce(F.col("move") > limits.max_single_day_move, F.lit(False))
    gappy = F.col("missing_streak") > limits.max_consecutive_missing_bars
    tokens = [
        (no_bars, "missing_ohlcv_window"), (thin, "average_dollar_volume_below_minimum"), (cheap, "close_price_below_minimum"),
        (cap_none, "market_cap_unavailable"), (cap_low, "market_cap_below_minimum"), (zero, "zero_volume"),
        (jump, "single_day_move_above_maximum"), (zero & jump, "halt_detected"), (gappy, "consecutive_missing_bars_above_maximum"),
    ]
    old = F.filter(F.transform(F.split(F.coalesce("reason", F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    new = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in tokens]))
    reasons = F.array_distinct(F.concat(old, new))
    # most rows bring no reason: theirs are the new tokens, which are distinct
    fresh = F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in tokens])
    return df.select(
        "date", "ticker", "in_universe", "tradable",
        (F.col("liquid") & ~(thin | cheap | cap_none | cap_low)).alias("liquid"),
        (F.col("halted") | (zero & jump)).alias("halted"),
        (F.col("data_quality_ok") & ~(no_bars | zero | jump | gappy)).alias("data_quality_ok"),
        F.when(F.col("reason").isNull(), F.when(fresh != "", fresh)).otherwise(F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))).alias("reason"),
    )
