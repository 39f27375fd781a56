"""Price features, labels and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import by, full, pct_change, rolling_corr, rounded, rows, safe_div
from tidemark.operators import labels as L
from tidemark.operators import market as M
from tidemark.plans import testbed as T
from tidemark.registry import query, view

W = M.w_ticker

view("v_r", """
SELECT b.*, adj_close / nullif(lag(adj_close) OVER w, 0) - 1 AS r1, adj_close / nullif(lag(adj_close, 5) OVER w, 0) - 1 AS r5,
       adj_close / nullif(lag(adj_close, 21) OVER w, 0) - 1 AS r21, adj_close / nullif(lag(adj_close, 63) OVER w, 0) - 1 AS r63,
       lag(close) OVER w AS pc, lag(adj_close) OVER w AS pa, volume / nullif(lag(volume) OVER w, 0) - 1 AS vchg,
       m.adj_close AS bc, row_number() OVER w AS n
FROM v_bars b LEFT JOIN (SELECT date AS bdate, adj_close FROM v_benchmark) m ON b.date = m.bdate
WINDOW w AS (PARTITION BY ticker ORDER BY date)""".replace("b.*", "b.ticker, b.date, b.open, b.high, b.low, b.close, b.volume, b.adj_close, b.dollar_volume").replace("adj_close / nullif(lag(adj_close", "b.adj_close / nullif(lag(b.adj_close").replace("lag(adj_close) OVER w AS pa", "lag(b.adj_close) OVER w AS pa"))


@query("w1_returns", """
SELECT ticker, date, round(r1, 6) AS returns_1d, round(r5, 6) AS returns_5d, round(r21, 6) AS returns_21d, round(r63, 6) AS returns_63d FROM v_r""")
def w1(spark, sf):
    b = T.bars(spark, sf)
    return rounded(b.select("ticker", "date", *[pct_change("adj_close", n, W()).alias(f"returns_{n}d") for n in (1, 5, 21, 63)]))


@query("w2_momentum", """
SELECT ticker, date, round(lag(r21, 2) OVER (PARTITION BY ticker ORDER BY date), 6) AS momentum_21 FROM v_r""")
def w2(spark, sf):
    return rounded(M.market_features(T.bars(spark, sf)).select("ticker", "date", "momentum_21"))


@query("w3_realized_vol", """
SELECT ticker, date, round(v5, 6) AS realized_vol_5d, round(v21, 6) AS realized_vol_21d, round(v5 / nullif(v21, 0), 6) AS vol_ratio_5_21
FROM (SELECT ticker, date,
        CASE WHEN count(r1) OVER a = 5 THEN stddev_samp(r1) OVER a * sqrt(252) END AS v5,
        CASE WHEN count(r1) OVER b = 21 THEN stddev_samp(r1) OVER b * sqrt(252) END AS v21
      FROM v_r WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))""")
def w3(spark, sf):
    df = T.bars(spark, sf).select("ticker", "date", pct_change("adj_close", 1, W()).alias("r"))
    df = df.select("ticker", "date", (full(F.stddev_samp("r"), "r", W(), 5) * M.ANNUAL).alias("realized_vol_5d"),
                   (full(F.stddev_samp("r"), "r", W(), 21) * M.ANNUAL).alias("realized_vol_21d"))
    return rounded(df.withColumn("vol_ratio_5_21", safe_div("realized_vol_5d", "realized_vol_21d")))


@query("w4_atr", """
SELECT ticker, date, round(CASE WHEN n >= 14 THEN avg(greatest(abs(high - low), abs(high - pc), abs(low - pc)))
  OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) END, 6) AS atr_14 FROM v_r""")
def w4(spark, sf):
    df = T.bars(spark, sf).withColumn("tr", M.true_range())
    return rounded(df.select("ticker", "date", full(F.avg("tr"), "tr", W(), 14).alias("atr_14")))


@query("w5_price_vs_sma", """
SELECT ticker, date, round(adj_close / CASE WHEN n >= 20 THEN avg(adj_close) OVER a END - 1, 6) AS price_vs_sma20,
       round(adj_close / CASE WHEN n >= 50 THEN avg(adj_close) OVER b END - 1, 6) AS price_vs_sma50 FROM v_r
WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)""")
def w5(spark, sf):
    out = [(safe_div("adj_close", full(F.avg("adj_close"), "adj_close", W(), n)) - 1.0).alias(f"price_vs_sma{n}") for n in (20, 50)]
    return rounded(T.bars(spark, sf).select("ticker", "date", *out))


@query("w6_golden_cross", """
SELECT ticker, date, CAST(coalesce(CASE WHEN n >= 50 THEN avg(adj_close) OVER a END > CASE WHEN n >= 200 THEN avg(adj_close) OVER b END, false) AS INTEGER) AS golden_cross_50_200
FROM v_r WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)""")
def w6(spark, sf):
    a, b = (full(F.avg("adj_close"), "adj_close", W(), n) for n in (50, 200))
    return T.bars(spark, sf).select("ticker", "date", F.coalesce(a > b, F.lit(False)).cast("int").alias("golden_cross_50_200"))


@query("w7_rsi", """
SELECT ticker, date, round(CASE WHEN n < 15 THEN NULL WHEN down = 0 AND up = 0 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END, 6) AS rsi_14
FROM (SELECT ticker, date, n, avg(greatest(adj_close - pa, 0)) FILTER (pa IS NOT NULL) OVER w AS up, avg(greatest(pa - adj_close, 0)) FILTER (pa IS NOT NULL) OVER w AS down
      FROM v_r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))""")
def w7(spark, sf):
    df = T.bars(spark, sf).withColumn("d", F.col("adj_close") - F.lag("adj_close", 1).over(W()))
    return rounded(df.select("ticker", "date", M.rsi(F.col("d"), 14).alias("rsi_14")))


view("v_macd", """
SELECT ticker, date, line - sig AS macd_signal FROM (
  SELECT * FROM v_ema)""")
view("v_ema", """
SELECT ticker, n, date, e12, e26, line, sig FROM v_ema_rec""")
view("v_ema_rec", """
SELECT ticker, n, date, adj_close AS e12, adj_close AS e26, 0.0::DOUBLE AS line, 0.0::DOUBLE AS sig FROM v_r WHERE n = 1
UNION ALL
SELECT r.ticker, r.n, r.date,
       e12 + 2.0::DOUBLE / 13 * (r.adj_close - e12), e26 + 2.0::DOUBLE / 27 * (r.adj_close - e26),
       (e12 + 2.0::DOUBLE / 13 * (r.adj_close - e12)) - (e26 + 2.0::DOUBLE / 27 * (r.adj_close - e26)),
       sig + 0.2::DOUBLE * ((e12 + 2.0::DOUBLE / 13 * (r.adj_close - e12)) - (e26 + 2.0::DOUBLE / 27 * (r.adj_close - e26)) - sig)
FROM v_ema_rec e JOIN v_r r ON r.ticker = e.ticker AND r.n = e.n + 1""")


@query("w8_macd", "SELECT ticker, date, round(macd_signal, 6) AS macd_signal FROM v_macd")
def w8(spark, sf):
    return rounded(M.macd_histogram(T.bars(spark, sf)).select("ticker", "date", "macd_signal"))


@query("w9_volume_ratio", """
SELECT ticker, date, round(volume / nullif(CASE WHEN n >= 20 THEN avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) END, 0), 6) AS volume_ratio_20 FROM v_r""")
def w9(spark, sf):
    v = full(F.avg("volume"), "volume", W(), 20)
    return rounded(T.bars(spark, sf).select("ticker", "date", safe_div("volume", v).alias("volume_ratio_20")))


@query("w10_price_volume_corr", """
SELECT ticker, date, round(CASE WHEN n >= 11 THEN covar_samp(r1, vchg) OVER w / nullif(stddev_samp(r1) OVER w * stddev_samp(vchg) OVER w, 0) END, 6) AS price_volume_corr_10
FROM v_r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)""")
def w10(spark, sf):
    df = T.bars(spark, sf).select("ticker", "date", pct_change("adj_close", 1, W()).alias("r"), pct_change("volume", 1, W()).alias("v"))
    return rounded(df.select("ticker", "date", rolling_corr("r", "v", W(), 10).alias("price_volume_corr_10")))


@query("w11_overnight_gap", "SELECT ticker, date, round(open / pc - 1, 6) AS overnight_gap FROM v_r")
def w11(spark, sf):
    return rounded(T.bars(spark, sf).select("ticker", "date", (safe_div("open", F.lag("close", 1).over(W())) - 1.0).alias("overnight_gap")))


view("v_beta", """
SELECT ticker, date, b1, b5, r5 - b5 AS rel5, CASE WHEN count(pr) OVER w = 60 THEN covar_samp(pr, pb) OVER w END
       / nullif(CASE WHEN count(b1) OVER w = 60 THEN var_samp(b1) OVER w END, 0) AS beta
FROM (SELECT *, CASE WHEN b1 IS NOT NULL THEN r1 END AS pr, CASE WHEN r1 IS NOT NULL THEN b1 END AS pb
      FROM (SELECT *, bc / nullif(lag(bc) OVER o, 0) - 1 AS b1, bc / nullif(lag(bc, 5) OVER o, 0) - 1 AS b5
            FROM v_r WINDOW o AS (PARTITION BY ticker ORDER BY date)))
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""")


@query("w12_benchmark_features", """
SELECT ticker, date, round(b1, 6) AS spy_return_1d, round(b5, 6) AS spy_return_5d, round(rel5, 6) AS stock_vs_spy_return_5d, round(beta, 6) AS beta_60d FROM v_beta""")
def w12(spark, sf):
    df = M.unguarded_market_features(T.bars(spark, sf), T.benchmark(spark, sf))
    return rounded(df.select("ticker", "date", "spy_return_1d", "spy_return_5d", "stock_vs_spy_return_5d", "beta_60d"))


@query("j10_benchmark_alignment", """
SELECT ticker, date, round(bc, 6) AS bench_close, round(bc / nullif(lag(bc) OVER o, 0) - 1, 6) AS bench_return_1d FROM v_r WINDOW o AS (PARTITION BY ticker ORDER BY date)""")
def j10(spark, sf):
    df = M.with_benchmark(T.bars(spark, sf).select("ticker", "date"), T.benchmark(spark, sf))
    return rounded(df.select("ticker", "date", "bench_close", pct_change("bench_close", 1, W()).alias("bench_return_1d")))


@query("w13_lag_guard", """
SELECT ticker, date, round(lag(r1) OVER w, 6) AS returns_1d, round(lag(r5) OVER w, 6) AS returns_5d FROM v_r WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def w13(spark, sf):
    df = T.bars(spark, sf).select("ticker", "date", pct_change("adj_close", 1, W()).alias("returns_1d"), pct_change("adj_close", 5, W()).alias("returns_5d"))
    return rounded(M.lag_guard(df, ["returns_1d", "returns_5d"]))


view("v_market_raw", """
SELECT r.ticker, r.date, r1 AS returns_1d, r.r5 AS returns_5d, r21 AS returns_21d, r63 AS returns_63d, lag(r21) OVER o AS momentum_21,
       CASE WHEN count(r1) OVER w5 = 5 THEN stddev_samp(r1) OVER w5 * sqrt(252) END AS realized_vol_5d,
       CASE WHEN count(r1) OVER w21 = 21 THEN stddev_samp(r1) OVER w21 * sqrt(252) END AS realized_vol_21d,
       CASE WHEN n >= 14 THEN avg(greatest(abs(high - low), abs(high - pc), abs(low - pc))) OVER w14 END AS atr_14,
       adj_close / CASE WHEN n >= 20 THEN avg(adj_close) OVER w20 END - 1 AS price_vs_sma20,
       adj_close / CASE WHEN n >= 50 THEN avg(adj_close) OVER w50 END - 1 AS price_vs_sma50,
       CAST(coalesce(CASE WHEN n >= 50 THEN avg(adj_close) OVER w50 END > CASE WHEN n >= 200 THEN avg(adj_close) OVER w200 END, false) AS INTEGER) AS golden_cross_50_200,
       CASE WHEN n >= 15 THEN avg(greatest(adj_close - pa, 0)) FILTER (pa IS NOT NULL) OVER w14 END AS up,
       CASE WHEN n >= 15 THEN avg(greatest(pa - adj_close, 0)) FILTER (pa IS NOT NULL) OVER w14 END AS down,
       volume / nullif(CASE WHEN n >= 20 THEN avg(volume) OVER w20 END, 0) AS volume_ratio_20,
       CASE WHEN n >= 11 THEN covar_samp(r1, vchg) OVER w10 / nullif(stddev_samp(r1) OVER w10 * stddev_samp(vchg) OVER w10, 0) END AS price_volume_corr_10,
       open / pc - 1 AS overnight_gap
FROM v_r r
WINDOW o AS (PARTITION BY r.ticker ORDER BY r.date), w5 AS (o ROWS 4 PRECEDING), w10 AS (o ROWS 9 PRECEDING), w14 AS (o ROWS 13 PRECEDING),
       w20 AS (o ROWS 19 PRECEDING), w21 AS (o ROWS 20 PRECEDING), w50 AS (o ROWS 49 PRECEDING), w200 AS (o ROWS 199 PRECEDING)""")
view("v_market", """
SELECT * EXCLUDE (up, down), realized_vol_5d / nullif(realized_vol_21d, 0) AS vol_ratio_5_21,
       CASE WHEN down = 0 AND up = 0 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END AS rsi_14,
       macd_signal, b1 AS spy_return_1d, b5 AS spy_return_5d, rel5 AS stock_vs_spy_return_5d, beta AS beta_60d
FROM v_market_raw JOIN v_macd USING (ticker, date) JOIN v_beta USING (ticker, date)""".replace("* EXCLUDE (up, down)", "v_market_raw.* EXCLUDE (up, down)"))
view("v_market_guarded", "SELECT ticker, date, " + ", ".join(f"lag({c}) OVER w AS {c}" for c in M.MARKET_FEATURES)
     + " FROM v_market WINDOW w AS (PARTITION BY ticker ORDER BY date)")


def _r(c):
    return c if c == "golden_cross_50_200" else f"round({c}, 6) AS {c}"


@query("w14_market_features", "SELECT ticker, date, " + ", ".join(_r(c) for c in M.MARKET_FEATURES) + " FROM v_market_guarded")
def w14(spark, sf):
    return rounded(M.market_features(T.bars(spark, sf), T.benchmark(spark, sf)))


view("v_labels", """
SELECT ticker, date, """ + ", ".join(
    f"lead(adj_close, {h}) OVER w / adj_close - 1 AS forward_return_{h}d, ln(lead(adj_close, {h}) OVER w / adj_close) AS forward_log_return_{h}d, "
    f"CAST(lead(adj_close, {h}) OVER w IS NOT NULL AS INTEGER) AS survives_to_t{h}" for h in (1, 5, 20))
     + " FROM v_bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")


@query("w15_forward_labels", "SELECT ticker, date, " + ", ".join(
    f"round(forward_return_{h}d, 6) AS forward_return_{h}d, round(forward_log_return_{h}d, 6) AS forward_log_return_{h}d, survives_to_t{h}" for h in (1, 5, 20)) + " FROM v_labels")
def w15(spark, sf):
    return rounded(L.forward_return_labels(T.bars(spark, sf)))


@query("f17_return_class", """
SELECT ticker, date, CASE WHEN forward_return_1d IS NULL THEN NULL WHEN forward_return_1d > 0.0025 THEN 'positive' WHEN forward_return_1d < -0.0025 THEN 'negative' ELSE 'neutral' END AS label FROM v_labels""")
def f17(spark, sf):
    return L.forward_return_labels(T.bars(spark, sf)).select("ticker", "date", L.return_class("forward_return_1d").alias("label"))


view("v_bench_inputs", """
SELECT date, ln(adj_close / lag(adj_close) OVER o) AS lr, adj_close / lag(adj_close, 5) OVER o - 1 AS r5, r,
       CASE WHEN count(r) OVER w21 = 21 THEN stddev_samp(r) OVER w21 * sqrt(252) END AS v21,
       CASE WHEN count(r) OVER w63 = 63 THEN stddev_samp(r) OVER w63 * sqrt(252) END AS v63,
       adj_close / CASE WHEN count(*) OVER w63 = 63 THEN max(adj_close) OVER w63 END - 1 AS dd
FROM (SELECT *, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS r FROM v_benchmark)
WINDOW o AS (ORDER BY date), w21 AS (o ROWS 20 PRECEDING), w63 AS (o ROWS 62 PRECEDING)""")
view("v_regime_inputs", """
SELECT date, lag(lr) OVER o AS spy_log_return_1d, lag(r5) OVER o AS spy_return_5d, lag(v21) OVER o AS spy_realized_vol_21d, lag(v63) OVER o AS spy_realized_vol_63d,
       lag(v21 / nullif(v63, 0)) OVER o AS spy_vol_ratio_21_63, lag(dd) OVER o AS spy_drawdown_63d
FROM v_bench_inputs WINDOW o AS (ORDER BY date)""")
REGIME_SIX = ["spy_log_return_1d", "spy_return_5d", "spy_realized_vol_21d", "spy_realized_vol_63d", "spy_vol_ratio_21_63", "spy_drawdown_63d"]


@query("w17_regime_inputs", "SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in REGIME_SIX) + " FROM v_regime_inputs")
def w17(spark, sf):
    return rounded(M.benchmark_regime_inputs(T.benchmark(spark, sf)))


@query("w25_split_like_jumps", """
SELECT * FROM (SELECT ticker, date, lag(date) OVER w AS previous_date, lag(adj_close) OVER w AS previous_adj_close, adj_close,
       round(greatest(adj_close / lag(adj_close) OVER w, lag(adj_close) OVER w / adj_close), 6) AS jump_ratio
FROM v_bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE jump_ratio >= 1.08""")
def w25(spark, sf):
    return rounded(M.split_like_jumps(T.bars(spark, sf), threshold=1.08))


@query("w27_price_context", """
SELECT ticker, date, adj_close, round(adj_close / lag(adj_close) OVER w - 1, 6) AS return_1d, round(adj_close / max(adj_close) OVER w - 1, 6) AS drawdown
FROM v_bars WHERE date BETWEEN '1996-01-01' AND '1997-06-30' WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def w27(spark, sf):
    return rounded(M.price_context(T.bars(spark, sf), "1996-01-01", "1997-06-30"))


SWEEP = [("short_momentum", 5, 5, 10), ("baseline_momentum", 21, 21, 20), ("intermediate_momentum", 63, 21, 20)]


def _sweep_sql():
    sel, out = [], []
    for name, r, v, q in SWEEP:
        sel.append(f"lag(f_{name}_r) OVER o AS {name}_r, lag(f_{name}_v) OVER o AS {name}_v, lag(f_{name}_q) OVER o AS {name}_q")
    inner = ", ".join(
        f"adj_close / lag(adj_close, {r}) OVER o - 1 AS f_{name}_r, CASE WHEN count(r1) OVER (o ROWS {v - 1} PRECEDING) = {v} THEN stddev_samp(r1) OVER (o ROWS {v - 1} PRECEDING) END AS f_{name}_v, "
        f"volume / CASE WHEN n >= {q} THEN avg(volume) OVER (o ROWS {q - 1} PRECEDING) END AS f_{name}_q" for name, r, v, q in SWEEP)
    for name, r, v, q in SWEEP:
        c = ", ".join(f"covar_samp({name}_{k}, y) / nullif(stddev_samp(CASE WHEN y IS NOT NULL THEN {name}_{k} END) * stddev_samp(CASE WHEN {name}_{k} IS NOT NULL THEN y END), 0) AS {a}"
                      for k, a in (("r", "return_corr"), ("v", "volatility_corr"), ("q", "volume_corr")))
        out.append(f"SELECT ticker, '{name}' AS candidate, {r} AS return_window, {v} AS volatility_window, {q} AS volume_window, count(y) AS label_pairs, {c} FROM g GROUP BY ticker")
    return f"""SELECT ticker, candidate, return_window, volatility_window, volume_window, label_pairs, round(return_corr, 6) AS return_corr, round(volatility_corr, 6) AS volatility_corr,
       round(volume_corr, 6) AS volume_corr, round(greatest(abs(return_corr), abs(volatility_corr), abs(volume_corr)), 6) AS score FROM (
WITH f AS (SELECT ticker, date, lead(adj_close, 5) OVER o / adj_close - 1 AS y, {inner} FROM v_r WINDOW o AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT ticker, y, {", ".join(sel)} FROM f WINDOW o AS (PARTITION BY ticker ORDER BY date)) """ + " UNION ALL ".join(out) + ")"


view("v_sweep", _sweep_sql())


@query("a17_parameter_sweep", "SELECT * FROM v_sweep")
def a17(spark, sf):
    return rounded(M.sweep_candidates(T.bars(spark, sf), windows=SWEEP))


@query("a17_best_candidate", """
SELECT ticker, arg_min(candidate, row(-score, candidate)) AS candidate, max(score) AS score, max(label_pairs) AS label_pairs FROM v_sweep WHERE score IS NOT NULL GROUP BY ticker""")
def a17_best(spark, sf):
    return M.best_candidate(rounded(M.sweep_candidates(T.bars(spark, sf), windows=SWEEP)))
