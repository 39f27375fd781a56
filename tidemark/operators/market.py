"""Price-bar features: one row per (ticker, date), known before that day's open.

All windows of the family share the order (block, date) within a ticker, so it costs
one shuffle on ticker and two sorts. A ticker's partition is bounded by the calendar because
bars hold one row per (ticker, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.maths import TRADING_DAYS_PER_YEAR, by, full, pct_change, rolling_corr, rows, safe_div

ANNUAL = float(TRADING_DAYS_PER_YEAR) ** 0.5

# Output column names, fixed by the feature contract.
MARKET_FEATURES = [
    "returns_1d", "returns_5d", "returns_21d", "returns_63d", "momentum_21",
    "realized_vol_5d", "realized_vol_21d", "vol_ratio_5_21", "atr_14",
    "price_vs_sma20", "price_vs_sma50", "golden_cross_50_200", "rsi_14", "macd_signal",
    "volume_ratio_20", "price_volume_corr_10", "overnight_gap",
    "spy_return_1d", "spy_return_5d", "stock_vs_spy_return_5d", "beta_60d",
]

# One block of rows. The weight a value keeps in a recursive average after a full block
# is (25/27)**1024, far below double precision, so one earlier block is enough; and a
# rolling frame of up to so many rows touches two blocks.
BLOCK = 1024


def w_ticker() -> WindowSpec:
    return by("ticker", order="date")


def with_blocks(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Number the rows of a key from 0 (`_n`) and their blocks (`_b`).

    Windows over (key; _b, date) and over (key, _b; date) then share one sort.
    """
    return df.withColumn("_n", F.row_number().over(by(key, order="date")) - 1).withColumn("_b", F.floor(F.col("_n") / BLOCK))


def w_blocks(key: str = "ticker") -> WindowSpec:
    return by(key, order=["_b", "date"])


def block_sums(df: DataFrame, inputs: dict[str, Column], lengths: dict[str, list[int]], key: str = "ticker") -> DataFrame:
    """`{name}_sum{n}`: sum of the last n rows (at most BLOCK) of each input, null unless all n are there and not null.

    Two levels: sums within blocks and block totals. A frame is the difference of two running sums of a block, plus the
    rest of the block before, so that it costs a constant number of additions, and what cancels is a block, not a history.
    """
    in_block = by(key, "_b", order="date")
    running, whole = in_block.rowsBetween(Window.unboundedPreceding, 0), in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select("*", *[c.alias(f"_x_{name}") for name, c in inputs.items()])
    parts = []
    for name in inputs:
        x = F.col(f"_x_{name}")
        for kind, value in (("v", F.coalesce(x, F.lit(0.0))), ("m", x.isNull().cast("int"))):
            parts += [F.sum(value).over(running).alias(f"_{kind}run_{name}"), F.sum(value).over(whole).alias(f"_{kind}all_{name}")]
    kept = [c for c in df.columns if not c.startswith("_x_")]
    df = df.select(*kept, *parts)
    pos, w = F.col("_n") - F.col("_b") * BLOCK, w_blocks(key)

    def frame(kind: str, name: str, n: int) -> Column:
        run, before = F.col(f"_{kind}run_{name}"), F.lag(f"_{kind}run_{name}", n).over(w)
        rest = F.when(pos < n, F.lag(f"_{kind}all_{name}", n).over(w)).otherwise(0)
        return F.when(F.col("_n") == n - 1, run).when(F.col("_n") >= n, run + rest - before)

    return df.select(*kept, *[F.when(frame("m", name, n) == 0, frame("v", name, n)).alias(f"{name}_sum{n}") for name, ns in lengths.items() for n in ns])


def lag_guard(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Shift the feature row one bar down, so that day T sees bars before T only."""
    spec = by(*(keys or ["ticker"]), order="date")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[F.lag(c, 1).over(spec).alias(c) for c in columns])


def ema_columns(df: DataFrame, specs: dict[str, tuple[str, int]], key: str = "ticker") -> DataFrame:
    """Recursive exponential averages (first value as seed): {output: (input, span)}.

    `df` may be numbered already (`with_blocks`). Within a block of rows the recurrence unrolls to a running sum of x_i / d**i,
    scaled back by d**t; the previous block adds its own end value. Everything
    stays in built-in window sums. Inputs must be non-null.
    """
    numbered = "_n" in df.columns
    df = df if numbered else with_blocks(df, key)
    pos = F.col("_n") - F.col("_b") * BLOCK
    in_block = Window.partitionBy(key, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    prev_block = Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1)
    for name, (source, span) in specs.items():
        a = 2.0 / (span + 1.0)
        d = 1.0 - a
        # the very first value carries weight one, every later one weight a
        w = F.when(F.col("_n") == 0, F.col(source)).otherwise(F.col(source) * a)
        df = df.withColumn(f"_s_{name}", F.sum(w / F.pow(F.lit(d), pos)).over(in_block) * F.pow(F.lit(d), pos))
    tails = [
        F.max_by(F.col(f"_s_{name}"), F.col("_n")).over(prev_block).alias(f"_t_{name}") for name in specs
    ]
    df = df.select("*", *tails)
    for name, (source, span) in specs.items():
        d = 1.0 - 2.0 / (span + 1.0)
        carried = F.coalesce(F.col(f"_t_{name}"), F.lit(0.0)) * F.pow(F.lit(d), pos + 1)
        df = df.withColumn(name, F.col(f"_s_{name}") + carried)
    return df.drop(*[] if numbered else ["_n", "_b"], *[f"_s_{n}" for n in specs], *[f"_t_{n}" for n in specs])


def macd_histogram(df: DataFrame, source: str = "adj_close", key: str = "ticker") -> DataFrame:
    """EMA12 - EMA26, minus the EMA9 of that line, as `macd_signal`."""
    df = ema_columns(df, {"_ema12": (source, 12), "_ema26": (source, 26)}, key)
    df = df.withColumn("_line", F.col("_ema12") - F.col("_ema26"))
    df = ema_columns(df, {"_sig": ("_line", 9)}, key)
    return df.withColumn("macd_signal", F.col("_line") - F.col("_sig")).drop("_ema12", "_ema26", "_line", "_sig")


def rsi(delta: Column, n: int, spec: WindowSpec | None = None) -> Column:
    """Strength index from simple means; no losses gives 100, a flat window null."""
    spec = spec or w_ticker()
    gain = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    loss = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    up, down = full(F.avg(gain), gain, spec, n), full(F.avg(loss), loss, spec, n)
    return (
        F.when((down == 0) & (up == 0), F.lit(None).cast("double"))
        .when(down == 0, F.lit(100.0))
        .otherwise(100.0 - 100.0 / (1.0 + safe_div(up, down)))
    )


def true_range(spec: WindowSpec | None = None) -> Column:
    """Largest of the day's range and the two gaps to the previous raw close."""
    prev = F.lag("close", 1).over(spec or w_ticker())
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_benchmark(bars: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """Attach the benchmark close of the same date as `bench_close` (J10, first half)."""
    if benchmark is None:
        return bars.withColumn("bench_close", F.lit(None).cast("double"))
    b = benchmark.select("date", F.col("adj_close").alias("bench_close"))
    return bars.join(b, "date", "left")


def unguarded_market_features(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """All market features before the one-bar shift, and the row numbers `_n` and `_b`.

    The moving averages over 50 and 200 rows come from block sums, shorter frames and the 60-row moments are summed row by row.
    """
    w = w_blocks()
    df = with_blocks(with_benchmark(bars, benchmark))
    df = df.select(
        "*",
        pct_change("adj_close", 1, w).alias("returns_1d"),
        pct_change("adj_close", 5, w).alias("returns_5d"),
        pct_change("adj_close", 21, w).alias("returns_21d"),
        pct_change("adj_close", 63, w).alias("returns_63d"),
        (safe_div(F.lag("adj_close", 1).over(w), F.lag("adj_close", 22).over(w)) - 1.0).alias("momentum_21"),
        (F.col("adj_close") - F.lag("adj_close", 1).over(w)).alias("_delta"),
        true_range(w).alias("_tr"),
        pct_change("volume", 1, w).alias("_vol_chg"),
        (safe_div("open", F.lag("close", 1).over(w)) - 1.0).alias("overnight_gap"),
        pct_change("bench_close", 1, w).alias("spy_return_1d"),
        pct_change("bench_close", 5, w).alias("spy_return_5d"),
        full(F.avg("adj_close"), "adj_close", w, 20).alias("_sma20"),
        full(F.avg("volume"), "volume", w, 20).alias("_vavg"),
    )
    pair = F.col("returns_1d").isNotNull() & F.col("spy_return_1d").isNotNull()
    px, py = F.when(pair, F.col("returns_1d")), F.when(pair, F.col("spy_return_1d"))
    f60 = rows(w, 60)
    df = df.select(
        "*",
        (full(F.stddev_samp("returns_1d"), "returns_1d", w, 5) * ANNUAL).alias("realized_vol_5d"),
        (full(F.stddev_samp("returns_1d"), "returns_1d", w, 21) * ANNUAL).alias("realized_vol_21d"),
        full(F.avg("_tr"), "_tr", w, 14).alias("atr_14"),
        rsi(F.col("_delta"), 14, w).alias("rsi_14"),
        rolling_corr("returns_1d", "_vol_chg", w, 10).alias("price_volume_corr_10"),
        F.when(F.count(px).over(f60) == 60, F.covar_samp(px, py).over(f60)).alias("_cov60"),
        full(F.var_samp("spy_return_1d"), "spy_return_1d", w, 60).alias("_var60"),
    )
    df = block_sums(df, {"_close": F.col("adj_close")}, {"_close": [50, 200]})
    df = macd_histogram(df.select("*", (F.col("_close_sum50") / 50).alias("_sma50"), (F.col("_close_sum200") / 200).alias("_sma200")))
    return df.select(
        "date", "ticker",
        "returns_1d", "returns_5d", "returns_21d", "returns_63d", "momentum_21",
        "realized_vol_5d", "realized_vol_21d",
        safe_div("realized_vol_5d", "realized_vol_21d").alias("vol_ratio_5_21"),
        "atr_14",
        (safe_div("adj_close", "_sma20") - 1.0).alias("price_vs_sma20"),
        (safe_div("adj_close", "_sma50") - 1.0).alias("price_vs_sma50"),
        F.coalesce(F.col("_sma50") > F.col("_sma200"), F.lit(False)).cast("int").alias("golden_cross_50_200"),
        "rsi_14", "macd_signal",
        safe_div("volume", "_vavg").alias("volume_ratio_20"),
        "price_volume_corr_10", "overnight_gap", "spy_return_1d", "spy_return_5d",
        (F.col("returns_5d") - F.col("spy_return_5d")).alias("stock_vs_spy_return_5d"),
        safe_div("_cov60", "_var60").alias("beta_60d"), "_n", "_b",
    )


def market_features(bars: DataFrame, benchmark: DataFrame | None = None, *, guard: bool = True) -> DataFrame:
    """The 21 market features of every (ticker, date)."""
    df = unguarded_market_features(bars, benchmark)
    w = w_blocks()
    return df.select("date", "ticker", *[(F.lag(c, 1).over(w) if guard else F.col(c)).alias(c) for c in MARKET_FEATURES])


def split_like_jumps(bars: DataFrame, *, threshold: float = 1.8) -> DataFrame:
    """Adjacent adjusted closes whose ratio, either way up, reaches the threshold."""
    prev = F.lag("adj_close", 1).over(w_ticker())
    prev_date = F.lag("date", 1).over(w_ticker())
    ratio = safe_div("adj_close", prev)
    df = bars.select("ticker", "date", prev_date.alias("previous_date"), prev.alias("previous_adj_close"), "adj_close",
                     F.greatest(ratio, safe_div(F.lit(1.0), ratio)).alias("jump_ratio"))
    return df.where((F.col("previous_adj_close") > 0) & (F.col("adj_close") > 0) & (F.col("jump_ratio") >= threshold))


def price_context(bars: DataFrame, start: str, end: str) -> DataFrame:
    """One-day return and drawdown from the running high, both inside the chosen window."""
    df = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    peak = F.max("adj_close").over(w_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return df.select("ticker", "date", "adj_close", pct_change("adj_close", 1, w_ticker()).alias("return_1d"),
                     (safe_div("adj_close", peak) - 1.0).alias("drawdown"))


def benchmark_regime_inputs(benchmark: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Six benchmark inputs of the regime model, shifted one bar.

    `keys` names series columns; without them the frame is one market-wide series,
    whose single window is bounded by the number of dates.
    """
    keys = keys or []
    df = benchmark if keys else benchmark.withColumn("_one", F.lit(1))
    ks = keys or ["_one"]
    w = by(*ks, order="date")
    ratio = safe_div("adj_close", F.lag("adj_close", 1).over(w))
    df = df.select(
        *ks, "date", "adj_close",
        F.when(ratio > 0, F.ln(ratio)).alias("spy_log_return_1d"),
        pct_change("adj_close", 5, w).alias("spy_return_5d"),
        pct_change("adj_close", 1, w).alias("_r"),
        full(F.max("adj_close"), "adj_close", w, 63).alias("_high"),
    )
    df = df.select(
        "*",
        (full(F.stddev_samp("_r"), "_r", w, 21) * ANNUAL).alias("spy_realized_vol_21d"),
        (full(F.stddev_samp("_r"), "_r", w, 63) * ANNUAL).alias("spy_realized_vol_63d"),
    )
    df = df.select(
        *ks, "date", "spy_log_return_1d", "spy_return_5d", "spy_realized_vol_21d", "spy_realized_vol_63d",
        safe_div("spy_realized_vol_21d", "spy_realized_vol_63d").alias("spy_vol_ratio_21_63"),
        (safe_div("adj_close", "_high") - 1.0).alias("spy_drawdown_63d"),
    )
    out = lag_guard(df, [c for c in df.columns if c.startswith("spy_")], ks)
    return out if keys else out.drop("_one")


def sweep_candidates(
    bars: DataFrame,
    *,
    windows: list[tuple[str, int, int, int]],
    horizon: int = 5,
) -> DataFrame:
    """Score (name, return window, vol window, volume window) triples against a forward return.

    Each candidate feature is lagged one bar; the score is the largest absolute
    correlation over rows where both sides exist. One pass over the bars serves
    every candidate, and only sums leave the tasks.
    """
    w = w_ticker()
    df = bars.select("ticker", "date", "adj_close", "volume",
                     pct_change("adj_close", 1, w).alias("_r"),
                     (safe_div(F.lead("adj_close", horizon).over(w), F.col("adj_close")) - 1.0).alias("_y"))
    feats, unlagged = [], []
    for name, rw, vw, qw in windows:
        unlagged += [
            pct_change("adj_close", rw, w).alias(f"{name}|return"),
            (full(F.stddev_samp("_r"), "_r", w, vw) * ANNUAL).alias(f"{name}|volatility"),
            safe_div("volume", full(F.avg("volume"), "volume", w, qw)).alias(f"{name}|volume"),
        ]
        feats += [f"{name}|return", f"{name}|volatility", f"{name}|volume"]
    df = lag_guard(df.select("ticker", "date", "_y", *unlagged), feats)
    aggs = [F.count("_y").alias("label_pairs")]
    for f in feats:
        ok = F.col(f"`{f}`").isNotNull() & F.col("_y").isNotNull()
        x, y = F.when(ok, F.col(f"`{f}`")), F.when(ok, F.col("_y"))
        aggs.append(safe_div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias(f"c|{f}"))
    per_ticker = df.groupBy("ticker").agg(*aggs)
    out = []
    for name, rw, vw, qw in windows:
        c = [F.col(f"`c|{name}|{k}`") for k in ("return", "volatility", "volume")]
        out.append(F.struct(
            F.lit(name).alias("candidate"), F.lit(rw).alias("return_window"), F.lit(vw).alias("volatility_window"),
            F.lit(qw).alias("volume_window"), c[0].alias("return_corr"), c[1].alias("volatility_corr"),
            c[2].alias("volume_corr"), F.greatest(*[F.abs(x) for x in c]).alias("score")))
    return per_ticker.select("ticker", "label_pairs", F.explode(F.array(*out)).alias("s")).select("ticker", "label_pairs", "s.*")


def best_candidate(sweep: DataFrame) -> DataFrame:
    """The candidate with the largest score per ticker, earliest listed name on a tie."""
    scored = sweep.where(F.col("score").isNotNull())
    return scored.groupBy("ticker").agg(
        F.min_by(F.struct("candidate", "score", "label_pairs"), F.struct(-F.col("score"), F.col("candidate"))).alias("b")
    ).select("ticker", "b.*")
