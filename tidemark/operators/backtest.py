"""Walk-forward evaluation of any (date, ticker, score) table.

Fold and return tables are bounded by trading dates; the wide tables (scores,
labels) are only joined, ranked and averaged in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import TRADING_DAYS_PER_YEAR, is_finite, safe_div
from tidemark.functions.ranking import with_ranks
from tidemark.session import cut


@dataclass(frozen=True)
class WalkForward:
    train_days: int = 252
    test_days: int = 63
    top_n: int = 20
    min_train_samples: int = 50
    annual_factor: float = float(TRADING_DAYS_PER_YEAR)
    purge_days: int = 0
    rolling: bool = False


def rank_scores(scores: DataFrame, *, score: str = "score", date: str = "date", ticker: str = "ticker") -> DataFrame:
    """0-based ascending rank by (score, ticker) inside the date over max(n - 1, 1)."""
    df = scores.withColumn("_k", F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), F.col(ticker).alias("t"))))
    df = with_ranks(df, [date], "_k", bounded=True, _ord="ordinal", _cnt="count")
    return df.withColumn("rank_score", F.col("_ord") / F.greatest(F.col("_cnt") - 1, F.lit(1))).drop("_k", "_ord", "_cnt")


def fold_dates(dates: DataFrame, cfg: WalkForward) -> DataFrame:
    """B1: every date with its index and, after the first training span, its test fold."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = dates.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("idx"))
    return d.withColumn("fold", F.when(F.col("idx") >= cfg.train_days, F.floor((F.col("idx") - cfg.train_days) / cfg.test_days).cast("int")))


def fold_spans(folds: DataFrame, row_counts: DataFrame, cfg: WalkForward) -> DataFrame:
    """B1: train and test span per fold with the number of training rows; thin folds are dropped.

    `row_counts` has (date, rows): one row per date, so training sizes are a
    running sum over dates, not a range join over rows.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    base = folds.join(row_counts, "date", "left").select("date", "idx", "fold", F.coalesce("rows", F.lit(0)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1 - cfg.purge_days)), F.lit(0))
    if cfg.rolling:
        before = F.coalesce(F.sum("rows").over(w.rowsBetween(-cfg.train_days, -1 - cfg.purge_days)), F.lit(0))
    first = F.min("date").over(Window.partitionBy(F.lit(0))) if not cfg.rolling else F.lag("date", cfg.train_days).over(w)
    base = base.select("*", before.alias("train_rows"), first.alias("train_start"), F.lag("date", 1 + cfg.purge_days).over(w).alias("train_end"))
    spans = base.where(F.col("fold").isNotNull()).groupBy("fold").agg(
        F.min_by("train_start", "idx").alias("train_start"), F.min_by("train_end", "idx").alias("train_end"), F.min_by("train_rows", "idx").alias("train_rows"),
        F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    return spans.where(F.col("train_rows") >= cfg.min_train_samples)


def top_n(scores: DataFrame, n: int, *, by: str = "rank_score") -> DataFrame:
    """B2, O3: the n best rows per date, ticker on ties. The rank limit is applied map-side before the shuffle."""
    w = Window.partitionBy("date").orderBy(F.col(by).desc(), F.col("ticker"))
    return scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def picks_with_returns(scores: DataFrame, labels: DataFrame, dates: DataFrame, cfg: WalkForward, *, label: str, scored_rows: DataFrame | None = None) -> DataFrame:
    """Top-N rows of every kept fold's test dates with their realised return (null when there is none).

    The result is stored: it has at most top_n rows per date and every metric reads it.
    """
    folds = fold_dates(dates, cfg)
    counts = (scored_rows if scored_rows is not None else scores).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    kept = fold_spans(folds, counts, cfg).select("fold")
    test = folds.where(F.col("fold").isNotNull()).join(kept, "fold", "left_semi").select("date", "fold", "idx")
    best = top_n(scores.join(test, "date"), cfg.top_n)
    y = labels.select("date", "ticker", F.when(is_finite(label), F.col(label)).alias("realized"))
    return cut(best.join(y, ["date", "ticker"], "left").select("fold", "idx", "date", "ticker", "rank_score", "realized"), "picks")


def daily_returns(picks: DataFrame) -> DataFrame:
    """Equal-weight mean of the picks with a return; dates without any are left out."""
    return picks.groupBy("fold", "idx", "date").agg(F.avg("realized").alias("portfolio_return"), F.count(F.lit(1)).alias("positions")).where(F.col("portfolio_return").isNotNull())


def daily_turnover(picks: DataFrame, returns: DataFrame) -> DataFrame:
    """Share of names not held on the previous kept date; every fold starts empty."""
    w = Window.partitionBy("fold").orderBy("idx")
    d = returns.select("fold", "idx", "date", "positions", F.lag("idx", 1).over(w).alias("prev_idx"), F.lag("positions", 1).over(w).alias("prev_positions"))
    held = picks.select("fold", F.col("idx").alias("prev_idx"), "ticker")
    now = picks.select("fold", "idx", "ticker").join(d, ["fold", "idx"])
    stayed = now.join(held, ["fold", "prev_idx", "ticker"], "left_semi").groupBy("fold", "idx").agg(F.count(F.lit(1)).alias("stayed"))
    df = d.join(stayed, ["fold", "idx"], "left").withColumn("entered", F.col("positions") - F.coalesce("stayed", F.lit(0)))
    size = F.greatest("positions", F.coalesce("prev_positions", F.lit(0)))
    return df.select("fold", "idx", "date", F.coalesce(safe_div("entered", size), F.lit(0.0)).alias("turnover"))


def sharpe(r: str = "portfolio_return", annual: float = float(TRADING_DAYS_PER_YEAR)) -> Column:
    """Mean over sample deviation, annualised; zero when undefined or only rounding noise."""
    mean, sd = F.avg(r), F.stddev_samp(r)
    flat = (F.count(r) < 2) | (sd == 0) | ((F.abs(mean) > 0) & (F.coalesce(safe_div(sd, F.abs(mean)), F.lit(1.0)) < 1e-9))
    return F.when(flat, 0.0).otherwise(safe_div(mean, sd) * annual**0.5)


def annual_return(r: str = "portfolio_return", annual: float = float(TRADING_DAYS_PER_YEAR)) -> Column:
    """Compounded return scaled to a year; -1 once equity is gone, 0 without data."""
    equity = F.product(F.lit(1.0) + F.col(r))
    n = F.count(r)
    return F.when(n == 0, 0.0).when(equity <= 0, -1.0).otherwise(F.pow(equity, safe_div(F.lit(annual), n)) - 1.0)


def hit_rate(r: str = "portfolio_return") -> Column:
    """Share of positive returns."""
    return F.coalesce(F.avg(F.when(F.col(r) > 0, 1.0).when(F.col(r).isNotNull(), 0.0)), F.lit(0.0))


def max_drawdown(returns: DataFrame, keys: list[str], order: str = "idx", r: str = "portfolio_return") -> DataFrame:
    """Largest fall of compounded equity from its running peak, which starts at one.

    The running product handles equity that touches or crosses zero.
    """
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("_e", F.product(F.lit(1.0) + F.col(r)).over(w))
    e = e.withColumn("_p", F.greatest(F.max("_e").over(w), F.lit(1.0)))
    return e.groupBy(*keys).agg(F.max(F.greatest(safe_div(F.col("_p") - F.col("_e"), F.col("_p")), F.lit(0.0))).alias("max_drawdown"))


def information_coefficient(pairs: DataFrame, keys: list[str], *, score: str = "rank_score", realized: str = "realized", spearman: bool = False) -> DataFrame:
    """Covariance of midranks over the variance of the score ranks (both for `spearman`)."""
    p = pairs.where(F.col(realized).isNotNull() & F.col(score).isNotNull())
    p = cut(with_ranks(p, keys, score, _rs="midrank"), "ranked")
    p = with_ranks(p, keys, realized, _rr="midrank")
    cov, var = F.covar_pop("_rs", "_rr"), F.var_pop("_rs")
    below = F.sqrt(var * F.var_pop("_rr")) if spearman else var
    return p.groupBy(*keys).agg(F.when((F.count(F.lit(1)) < 2) | (var == 0), 0.0).otherwise(safe_div(cov, below)).alias("ic"))


def fold_summary(picks: DataFrame, spans: DataFrame) -> DataFrame:
    """Metrics per fold."""
    r = daily_returns(picks)
    m = r.groupBy("fold").agg(hit_rate().alias("hit_rate"), F.count(F.lit(1)).alias("n_test_dates"))
    t = daily_turnover(picks, r).groupBy("fold").agg(F.avg("turnover").alias("avg_turnover"))
    return m.join(t, "fold").join(information_coefficient(picks, ["fold"]), "fold").join(spans.select("fold", "train_start", "train_end", "test_start", "test_end"), "fold")


def overall_summary(picks: DataFrame, cfg: WalkForward = WalkForward()) -> DataFrame:
    """One row over all folds; returns are concatenated, IC and turnover averaged over folds."""
    r = daily_returns(picks)
    a = r.agg(sharpe(annual=cfg.annual_factor).alias("sharpe_ratio"), annual_return(annual=cfg.annual_factor).alias("annual_return"), hit_rate().alias("hit_rate"),
              F.count(F.lit(1)).alias("n_dates"), F.count_distinct("fold").alias("n_folds")).withColumn("_j", F.lit(0))
    dd = max_drawdown(r, []).withColumn("_j", F.lit(0))
    ic = information_coefficient(picks, ["fold"]).agg(F.avg("ic").alias("ic")).withColumn("_j", F.lit(0))
    t = daily_turnover(picks, r).groupBy("fold").agg(F.avg("turnover").alias("t")).agg(F.avg("t").alias("avg_turnover")).withColumn("_j", F.lit(0))
    out = a.join(dd, "_j").join(ic, "_j").join(t, "_j").drop("_j")
    return out.na.fill(0.0, ["max_drawdown", "ic", "avg_turnover"])


def chronological_split(rows: DataFrame, eval_fraction: float) -> DataFrame:
    """`split` = train or eval by date; at least one date on each side when there are two."""
    if not 0.0 <= eval_fraction < 1.0:
        raise ValueError("eval_fraction must be in [0, 1)")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    all_ = Window.partitionBy(F.lit(0))
    d = rows.select("date").distinct().select("date", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(all_).alias("total"))
    days = F.greatest(F.floor(F.col("total") * eval_fraction), F.lit(1))
    days = F.when(F.col("total") > 1, F.least(days, F.col("total") - 1)).otherwise(days) if eval_fraction > 0 else F.lit(0)
    d = d.select("date", F.when(F.col("n") > F.col("total") - days, "eval").otherwise("train").alias("split"))
    return rows.join(d, "date", "left")
