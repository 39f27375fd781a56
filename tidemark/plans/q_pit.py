"""Calendars, as-of joins and the point-in-time feature families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.maths import rounded
from tidemark.operators import fundamentals as FU
from tidemark.operators import macro as MA
from tidemark.operators import orderbook as OB
from tidemark.operators import quality as Q
from tidemark.operators import sector as SE
from tidemark.operators import sessions as D
from tidemark.operators import universe as U
from tidemark.operators.asof import active_interval_join, asof_join
from tidemark.plans import testbed as T
from tidemark.registry import query, view

# ---- calendars ------------------------------------------------------------

view("v_span", "SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders")
view("v_cal", "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM v_span")
view("v_easter", """
SELECT y, make_date(y, CAST((h + l - 7 * m + 114) // 31 AS INTEGER), CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) AS easter
FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l
  FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM (SELECT *, (b - f + 1) // 3 AS g
    FROM (SELECT *, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f, c // 4 AS i, c % 4 AS k
      FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(generate_series(year(a), year(b) + 1)) AS y FROM v_span)))))))""")
view("v_holidays", """
SELECT DISTINCT CASE dayofweek(d) WHEN 6 THEN d - 1 WHEN 0 THEN d + 1 ELSE d END AS date FROM (
  SELECT unnest([make_date(y, 1, 1), make_date(y, 7, 4), make_date(y, 12, 25), CASE WHEN y >= 2022 THEN make_date(y, 6, 19) END]) AS d FROM (SELECT CAST(y AS INTEGER) AS y FROM v_easter)) WHERE d IS NOT NULL
UNION SELECT easter - 2 FROM v_easter
UNION SELECT date FROM (SELECT CAST(unnest(generate_series(make_date(CAST(y AS INTEGER), 1, 1), make_date(CAST(y AS INTEGER), 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM v_easter)
 WHERE (month(date) = 1 AND dayofweek(date) = 1 AND day(date) BETWEEN 15 AND 21) OR (month(date) = 2 AND dayofweek(date) = 1 AND day(date) BETWEEN 15 AND 21)
    OR (month(date) = 5 AND dayofweek(date) = 1 AND day(date) >= 25) OR (month(date) = 9 AND dayofweek(date) = 1 AND day(date) <= 7)
    OR (month(date) = 11 AND dayofweek(date) = 4 AND day(date) BETWEEN 22 AND 28)""")
view("v_sessions", "SELECT date FROM v_cal WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN (SELECT date FROM v_holidays)")


def _span(spark, sf):
    return D.span_of(T.table(spark, sf, "orders"), "o_orderdate")


@query("d1_calendar_dates", "SELECT date FROM v_cal")
def d1(spark, sf):
    return D.calendar_dates(_span(spark, sf))


@query("d2_trading_sessions", "SELECT date FROM v_sessions")
def d2(spark, sf):
    return D.trading_sessions(_span(spark, sf))


@query("d3_skipped_dates", "SELECT date FROM v_cal WHERE date NOT IN (SELECT date FROM v_sessions)")
def d3(spark, sf):
    return D.skipped_dates(_span(spark, sf))


@query("d4_sessions_back", """
SELECT d.date, (SELECT max(s.date) FROM v_sessions s WHERE s.date < d.date) AS previous_session,
       (SELECT list_extract(list(s.date ORDER BY s.date DESC), 5) FROM v_sessions s WHERE s.date < d.date) AS five_back
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d""")
def d4(spark, sf):
    dates = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    s = D.trading_sessions(_span(spark, sf))
    one = D.sessions_back(dates, s, 1).withColumnRenamed("session", "previous_session")
    return one.join(D.sessions_back(dates, s, 5).withColumnRenamed("session", "five_back"), "date")


@query("d5_business_days", """
SELECT date, date - CASE dayofweek(date) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS previous_day, date + CASE dayofweek(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day
FROM v_cal WHERE dayofweek(date) BETWEEN 1 AND 5""")
def d5(spark, sf):
    return D.business_days(_span(spark, sf)).select("date", D.previous_business_day("date").alias("previous_day"), D.next_business_day("date").alias("next_day"))


@query("d6_missing_boundaries", """
WITH h AS (SELECT ticker, min(date) AS f, max(date) AS l FROM v_bars WHERE date BETWEEN '1995-01-01' AND '2001-12-31' GROUP BY 1),
p AS (SELECT ticker, f, l, f - CASE dayofweek(f) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS he, l + CASE dayofweek(l) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS ts
      FROM v_ticker_sectors LEFT JOIN h USING (ticker))
SELECT ticker, DATE '1995-01-01' AS range_start, DATE '2001-12-31' AS range_end FROM p WHERE f IS NULL
UNION ALL SELECT ticker, DATE '1995-01-01', he FROM p WHERE f > '1995-01-01' AND he >= '1995-01-01'
UNION ALL SELECT ticker, ts, DATE '2001-12-31' FROM p WHERE l < '2001-12-31' AND ts <= '2001-12-31'""")
def d6(spark, sf):
    return D.missing_boundary_ranges(T.bars(spark, sf), T.ticker_sectors(spark, sf), "1995-01-01", "2001-12-31")


# ---- macro ------------------------------------------------------------------

SERIES = {
    "fed_funds_rate": "1-URGENT", "treasury_3m": "2-HIGH", "treasury_2y": "3-MEDIUM", "treasury_10y": "4-NOT SPECIFIED",
    "vix_level": "5-LOW", "dollar_index": "1-URGENT", "cpi_level": "2-HIGH", "high_yield_spread": "3-MEDIUM",
}
SERIES_IDS = sorted(set(SERIES.values()))


def _dates(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


view("v_dates", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
view("v_macro_asof", """
SELECT date, series_id, max(r).value AS value, max(r).observation_date AS observation_date, max(r).realtime_start AS realtime_start
FROM (SELECT d.date, s.series_id, CASE WHEN m.value IS NOT NULL THEN {'observation_date': m.observation_date, 'realtime_start': m.realtime_start, 'retrieved_at': m.retrieved_at, 'value': m.value} END AS r
      FROM v_dates d CROSS JOIN (SELECT DISTINCT series_id FROM v_macro) s
      LEFT JOIN (SELECT * FROM v_macro WHERE NOT is_missing) m ON m.series_id = s.series_id AND m.observation_date < d.date AND m.realtime_start < d.date)
GROUP BY 1, 2""")


@query("j1_macro_asof", "SELECT date, series_id, value, observation_date, realtime_start FROM v_macro_asof")
def j1(spark, sf):
    return MA.macro_asof(T.macro(spark, sf), _dates(spark, sf), SERIES_IDS)


view("v_levels", "SELECT date, " + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS {f}" for f, s in SERIES.items()) + " FROM v_macro_asof GROUP BY 1")
view("v_macro_features", """
SELECT date, fed_funds_rate, fed_funds_rate - lag(fed_funds_rate, 5) OVER w AS fed_funds_rate_change_5d, treasury_3m, treasury_2y, treasury_10y,
       treasury_10y - lag(treasury_10y, 5) OVER w AS treasury_10y_change_5d, treasury_10y - treasury_2y AS yield_curve_slope_10y_2y,
       treasury_10y - treasury_3m AS yield_curve_slope_10y_3m, vix_level, vix_level - lag(vix_level, 5) OVER w AS vix_change_5d, dollar_index,
       dollar_index - lag(dollar_index, 5) OVER w AS dollar_index_change_5d, cpi_level,
       (cpi_level - lag(cpi_level, 252) OVER w) / nullif(lag(cpi_level, 252) OVER w, 0) AS cpi_change_yoy, high_yield_spread
FROM v_levels WINDOW w AS (ORDER BY date)""")


@query("c1_macro_features", "SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in MA.MACRO_FEATURES) + " FROM v_macro_features")
def c1(spark, sf):
    return rounded(MA.macro_features(T.macro(spark, sf), _dates(spark, sf), SERIES))


@query("w16_macro_changes", "SELECT date, round(fed_funds_rate_change_5d, 6) AS fed_funds_rate_change_5d, round(cpi_change_yoy, 6) AS cpi_change_yoy FROM v_macro_features")
def w16(spark, sf):
    return c1(spark, sf).select("date", "fed_funds_rate_change_5d", "cpi_change_yoy")


@query("w28_context_start", """
SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM v_dates)
WHERE n >= (SELECT min(n) FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM v_dates) WHERE date >= '1998-01-01') - 252""")
def w28(spark, sf):
    return MA.context_start(_dates(spark, sf), "1998-01-01")


view("v_bdays", "SELECT date FROM v_cal WHERE dayofweek(date) BETWEEN 1 AND 5")
view("v_snapshots", """
SELECT snapshot_date, series_id, r.observation_date AS observation_date, r.realtime_start AS realtime_start, r.realtime_end AS realtime_end, r.retrieved_at AS retrieved_at, r.value AS value, r.is_missing AS is_missing
FROM (SELECT d.date AS snapshot_date, m.series_id, arg_max(m, row(observation_date, realtime_start, realtime_end, retrieved_at)) AS r
FROM v_bdays d JOIN v_macro m ON m.observation_date <= d.date AND m.realtime_start <= d.date GROUP BY 1, 2)""")


@query("a10_macro_snapshots", "SELECT * FROM v_snapshots")
def a10(spark, sf):
    return MA.macro_snapshots(T.macro(spark, sf), D.business_days(_span(spark, sf)), SERIES_IDS)


@query("a9_latest_macro_snapshot", "SELECT * FROM v_snapshots WHERE snapshot_date = '1998-06-30'")
def a9(spark, sf):
    day = D.business_days(_span(spark, sf)).where(F.col("date") == F.lit("1998-06-30").cast("date"))
    return MA.macro_snapshots(T.macro(spark, sf), day, SERIES_IDS)


@query("a12_available_series", """
SELECT d.date, coalesce(string_agg(series_id, ';' ORDER BY series_id), '') AS series FROM v_bdays d LEFT JOIN v_snapshots s ON s.snapshot_date = d.date GROUP BY 1""")
def a12(spark, sf):
    df = MA.available_series_by_date(T.macro(spark, sf), D.business_days(_span(spark, sf)), SERIES_IDS)
    return df.select("date", F.array_join("series", ";").alias("series"))


@query("a11_snapshot_usability", """
WITH r AS (SELECT observation_date AS shard_date, series_id AS sid, CASE WHEN retrieved_at % 97 = 0 THEN observation_date - 1 ELSE observation_date END AS snapshot_date,
           observation_date - CAST(retrieved_at % 3 AS INTEGER) AS od, realtime_start - 31 AS rs FROM v_macro),
s AS (SELECT shard_date, sid, count(*) AS n, bool_and(snapshot_date = shard_date) AS own, bool_and(od <= shard_date AND rs <= shard_date) AS ok FROM r GROUP BY 1, 2)
SELECT shard_date, sum(n)::BIGINT AS rows, bool_and(own) AS own_snapshot_only, true AS no_blank_series, bool_and(n = 1) AS no_duplicate_series, bool_and(ok) AS all_available,
       count(*) FILTER (sid IN ('1-URGENT', '5-LOW')) = 2 AS required_covered,
       bool_and(own) AND bool_and(n = 1) AND bool_and(ok) AND count(*) FILTER (sid IN ('1-URGENT', '5-LOW')) = 2 AS usable FROM s GROUP BY 1""")
def a11(spark, sf):
    m = T.macro(spark, sf)
    rows = m.select(F.col("observation_date").alias("shard_date"), "series_id",
                    F.when(F.col("retrieved_at") % 97 == 0, F.date_sub("observation_date", 1)).otherwise(F.col("observation_date")).alias("snapshot_date"),
                    F.date_sub("observation_date", (F.col("retrieved_at") % 3).cast("int")).alias("observation_date"),
                    F.date_sub("realtime_start", 31).alias("realtime_start"))
    return MA.snapshot_usability(rows, ["1-URGENT", "5-LOW"])


# ---- filings ----------------------------------------------------------------


def _panel(spark, sf):
    return T.bars(spark, sf).select("ticker", "date")


def _tasks(spark, sf):
    return T.tasks(T.table(spark, sf, "lineitem"))



@query("a4_fiscal_periods", """
SELECT ticker, fiscal_year, fiscal_period, report_date, availability_date, revenue, total_assets, eps, 8 AS value_count FROM v_filings""".replace("8 AS", "7 AS"))
def a4(spark, sf):
    p = FU.fiscal_periods(T.filings(spark, sf))
    return p.select("ticker", "fiscal_year", "fiscal_period", "report_date", "availability_date",
                    FU.number("financials", FU.FIELD_NAMES["revenue"]).alias("revenue"),
                    FU.number("financials", FU.FIELD_NAMES["total_assets"]).alias("total_assets"),
                    FU.number("financials", ["eps"]).alias("eps"), F.size("financials").alias("value_count"))


view("v_filing_asof", """
SELECT b.ticker, b.date, b.adj_close, f.* EXCLUDE (ticker) FROM v_bars b ASOF LEFT JOIN v_filings f ON b.ticker = f.ticker AND b.date > f.availability_date""")


@query("j2_filing_asof", "SELECT ticker, date, report_date, availability_date FROM v_filing_asof")
def j2(spark, sf):
    p = FU.fiscal_periods(T.filings(spark, sf)).withColumn("_a", F.col("availability_date"))
    df = asof_join(_panel(spark, sf), p, on=["ticker"], left_time="date", right_time="_a", take=["report_date", "availability_date"], strict=True)
    return df


@query("j4_shares_asof", "SELECT b.ticker, b.date, f.shares FROM v_bars b ASOF LEFT JOIN v_filings f ON b.ticker = f.ticker AND b.date >= f.availability_date".replace("f.shares", "f.shares AS shares_outstanding"))
def j4(spark, sf):
    flat = T.filings_flat(spark, sf).select("ticker", "availability_date", F.col("shares").alias("shares_outstanding"))
    return FU.shares_asof(_panel(spark, sf), flat)


@query("j6_earnings_calendar", """
SELECT b.ticker, b.date, n.earnings_date - b.date AS days_to_next_earnings, CAST(n.earnings_date - b.date <= 5 AS INTEGER) AS pre_earnings_flag, CAST(b.date - p.earnings_date <= 2 AS INTEGER) AS post_earnings_flag
FROM v_bars b ASOF LEFT JOIN v_filings n ON b.ticker = n.ticker AND b.date <= n.earnings_date ASOF LEFT JOIN v_filings p ON b.ticker = p.ticker AND b.date > p.earnings_date""")
def j6(spark, sf):
    return FU.earnings_calendar(_panel(spark, sf), T.filings(spark, sf), tasks=_tasks(spark, sf))


@query("j7_prior_year", """
SELECT f.ticker, f.report_date, round((f.revenue - p.revenue) / abs(nullif(p.revenue, 0)), 6) AS revenue_growth_yoy FROM v_filings f
LEFT JOIN v_filings p ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year - 1 AND p.fiscal_period = f.fiscal_period""")
def j7(spark, sf):
    return rounded(FU.period_ratios(FU.fiscal_periods(T.filings(spark, sf))).select("ticker", "report_date", "revenue_growth_yoy"))


view("v_fundamentals", """
SELECT a.ticker, a.date, a.adj_close / nullif(a.eps, 0) AS pe_ratio, a.adj_close / nullif((a.total_assets - a.total_liabilities) / a.shares, 0) AS pb_ratio,
       a.adj_close / nullif(a.revenue / a.shares, 0) AS ps_ratio, a.net_income / nullif(a.revenue, 0) AS net_profit_margin,
       a.net_income / nullif(a.total_assets - a.total_liabilities, 0) AS return_on_equity, a.net_income / nullif(a.total_assets, 0) AS return_on_assets,
       CAST(NULL AS DOUBLE) AS gross_margin, a.total_liabilities / nullif(a.total_assets - a.total_liabilities, 0) AS debt_to_equity, CAST(NULL AS DOUBLE) AS interest_coverage,
       (a.revenue - p.revenue) / abs(nullif(p.revenue, 0)) AS revenue_growth_yoy, CAST(NULL AS DOUBLE) AS earnings_surprise,
       n.earnings_date - a.date AS days_to_next_earnings, CAST(n.earnings_date - a.date <= 5 AS INTEGER) AS pre_earnings_flag, CAST(a.date - q.earnings_date <= 2 AS INTEGER) AS post_earnings_flag
FROM v_filing_asof a LEFT JOIN (SELECT ticker AS pt, fiscal_year AS py, fiscal_period AS pp, revenue FROM v_filings) p ON pt = a.ticker AND py = a.fiscal_year - 1 AND pp = a.fiscal_period
ASOF LEFT JOIN v_filings n ON a.ticker = n.ticker AND a.date <= n.earnings_date ASOF LEFT JOIN v_filings q ON a.ticker = q.ticker AND a.date > q.earnings_date""")
_INT = ("days_to_next_earnings", "pre_earnings_flag", "post_earnings_flag")


@query("c2_fundamental_features", "SELECT ticker, date, " + ", ".join(c if c in _INT else f"round({c}, 6) AS {c}" for c in FU.FUNDAMENTAL_FEATURES) + " FROM v_fundamentals")
def c2(spark, sf):
    return rounded(FU.fundamental_features(T.filings(spark, sf), T.bars(spark, sf), tasks=_tasks(spark, sf)))


@query("c3_context_features", "SELECT ticker, f.date, " + ", ".join([c if c in _INT else f"round(f.{c}, 6) AS {c}" for c in FU.FUNDAMENTAL_FEATURES] + [f"round(m.{c}, 6) AS {c}" for c in MA.MACRO_FEATURES])
       + " FROM v_fundamentals f LEFT JOIN v_macro_features m ON m.date = f.date")
def c3(spark, sf):
    from tidemark.operators.assembly import context_features
    return rounded(context_features(T.filings(spark, sf), T.bars(spark, sf), T.macro(spark, sf), _dates(spark, sf), SERIES, tasks=_tasks(spark, sf)))


@query("j8_broadcast_macro", "SELECT ticker, b.date, round(vix_level, 6) AS vix_level, round(cpi_change_yoy, 6) AS cpi_change_yoy FROM v_bars b LEFT JOIN v_macro_features m ON m.date = b.date")
def j8(spark, sf):
    m = MA.macro_features(T.macro(spark, sf), _dates(spark, sf), SERIES).select("date", "vix_level", "cpi_change_yoy")
    return rounded(_panel(spark, sf).join(m, "date", "left"))


@query("f13_shares_outstanding", """
SELECT ticker, availability_date, CASE WHEN k = 0 THEN shares WHEN k = 1 THEN round(net_income / eps, 6) ELSE round(revenue / 2.5::DOUBLE, 6) END AS shares_outstanding
FROM (SELECT *, month(report_date) // 3 % 3 AS k FROM v_filings) WHERE k <> 1 OR (eps <> 0 AND net_income / eps > 0)""")
def f13(spark, sf):
    flat = T.filings_flat(spark, sf)
    k = F.floor(F.month("report_date") / 3) % 3
    raw = F.to_json(F.struct(
        F.when(k == 0, F.format_number("shares", 1)).alias("sharesBasic"),
        F.when(k == 1, F.col("net_income")).alias("netIncomeAvailableToCommonShareholders"),
        F.when(k == 1, F.col("eps")).alias("epsBasic"),
        F.when(k == 2, F.col("revenue")).alias("Revenue"), F.when(k == 2, F.lit("2.5")).alias("Sales Per Share")))
    rows = flat.select("ticker", "report_date", "availability_date", "fiscal_year", "fiscal_period", F.lit(0).alias("seq"), raw.alias("raw_json"))
    return rounded(FU.shares_outstanding(rows))


# ---- sectors ----------------------------------------------------------------

REGION_FUNDS = {"africa": "AFRICA", "america": "AMERICA", "asia": "ASIA", "europe": "EUROPE"}  # the fifth region stays unmapped

view("v_sector_asof", """
SELECT ticker, date, CASE WHEN sector IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN lower(sector) END AS sector_key,
       CASE WHEN sector IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN sector END AS sector_etf FROM v_filing_asof""")


@query("j3_sector_asof", "SELECT * FROM v_sector_asof")
def j3(spark, sf):
    return SE.sector_asof(_panel(spark, sf), T.filings(spark, sf), aliases={}, funds=REGION_FUNDS)


@query("c5_sector_key", """
SELECT ticker, report_date, CASE sector WHEN 'AFRICA' THEN 'financials' WHEN 'AMERICA' THEN 'information technology' WHEN 'ASIA' THEN 'health care' WHEN 'EUROPE' THEN 'energy' END AS sector_key FROM v_filings""")
def c5(spark, sf):
    flat = T.filings_flat(spark, sf)
    s = F.col("sector")
    direct = F.when(s == "ASIA", "  Health   CARE ").when(s == "AFRICA", "unknown")
    raw = F.to_json(F.struct(F.when(s == "AFRICA", "Financial Services").alias("gics_sector"), F.when(s == "AMERICA", "Technology").alias("sectorName"),
                             F.when(s == "EUROPE", "Energy").alias("sector"), F.when(s == "EUROPE", "Materials").alias("sector_name")))
    df = flat.select("ticker", "report_date", direct.alias("sector"), raw.alias("raw_json"))
    return df.select("ticker", "report_date", SE.sector_key(df).alias("sector_key"))


view("v_fund_features", """
SELECT etf, date, lag(r) OVER w AS sector_etf_ret, lag(m) OVER w AS sector_momentum FROM (
SELECT etf, date, adj_close / lag(adj_close) OVER o - 1 AS r, adj_close / lag(adj_close, 21) OVER o - 1 AS m FROM v_sector_bars WINDOW o AS (PARTITION BY etf ORDER BY date)) WINDOW w AS (PARTITION BY etf ORDER BY date)""")
view("v_stock_returns", """
SELECT ticker, date, lag(r1) OVER w AS stock_return_1d, lag(r63) OVER w AS stock_return_63d FROM v_r WINDOW w AS (PARTITION BY ticker ORDER BY date)""")


@query("w18_sector_returns", """
SELECT etf, date, round(sector_etf_ret, 6) AS sector_etf_ret, round(sector_momentum, 6) AS sector_momentum FROM v_fund_features""")
def w18(spark, sf):
    return rounded(SE.fund_features(T.sector_bars(spark, sf)))


@query("w18_stock_returns", "SELECT ticker, date, round(stock_return_1d, 6) AS stock_return_1d, round(stock_return_63d, 6) AS stock_return_63d FROM v_stock_returns")
def w18b(spark, sf):
    return rounded(SE.stock_returns(T.bars(spark, sf)))


view("v_sector_joined", """
SELECT s.ticker, s.date, a.sector_key, a.sector_etf, stock_return_1d, stock_return_63d, sector_etf_ret, sector_momentum
FROM v_stock_returns s JOIN v_sector_asof a ON a.ticker = s.ticker AND a.date = s.date LEFT JOIN v_fund_features f ON f.etf = a.sector_etf AND f.date = s.date""")


@query("j9_fund_lookup", "SELECT ticker, date, sector_etf, round(sector_etf_ret, 6) AS sector_etf_ret, round(sector_momentum, 6) AS sector_momentum FROM v_sector_joined")
def j9(spark, sf):
    panel = SE.sector_asof(_panel(spark, sf), T.filings(spark, sf), aliases={}, funds=REGION_FUNDS)
    return rounded(SE.fund_lookup(panel, SE.fund_features(T.sector_bars(spark, sf))).select("ticker", "date", "sector_etf", "sector_etf_ret", "sector_momentum"))


view("v_strength", """
SELECT ticker, date, stock_return_1d, sector_etf_ret, sector_momentum, CASE WHEN ok AND count(CASE WHEN ok THEN 1 END) OVER g >= 2 THEN
       (rank() OVER (PARTITION BY date, sector_key, ok ORDER BY stock_return_63d) + (count(*) OVER (PARTITION BY date, sector_key, ok, stock_return_63d) - 1) / 2.0::DOUBLE) / count(CASE WHEN ok THEN 1 END) OVER g END AS strength
FROM (SELECT *, sector_key IS NOT NULL AND stock_return_63d IS NOT NULL AS ok FROM v_sector_joined) WINDOW g AS (PARTITION BY date, sector_key)""")


@query("w19_relative_strength", "SELECT ticker, date, round(strength, 6) AS sector_relative_strength FROM v_strength")
def w19(spark, sf):
    df = SE.sector_asof(SE.stock_returns(T.bars(spark, sf)), T.filings(spark, sf), aliases={}, funds=REGION_FUNDS)
    return rounded(SE.relative_strength(df).select("ticker", "date", "sector_relative_strength"))


view("v_sector_features", """
SELECT ticker, date, sector_etf_ret, stock_return_1d - sector_etf_ret AS stock_vs_sector, sector_momentum, strength AS sector_relative_strength
FROM v_strength""")


@query("c4_sector_features", "SELECT ticker, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in SE.SECTOR_FEATURES) + " FROM v_sector_features")
def c4(spark, sf):
    return rounded(SE.sector_features(T.bars(spark, sf), T.filings(spark, sf), T.sector_bars(spark, sf), aliases={}, funds=REGION_FUNDS))


# ---- order book ---------------------------------------------------------------

view("v_preopen", """
SELECT * FROM v_order_book WHERE bid_price > 0 AND ask_price > 0 AND bid_size >= 0 AND ask_size >= 0 AND ask_price >= bid_price AND bid_size + ask_size > 0
AND captured_at < CAST(date AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE""")  # January: New York is UTC-5
view("v_book_features", """
SELECT p.date, p.ticker, ask_price - bid_price AS l2_bid_ask_spread, (ask_price - bid_price) / ((ask_price + bid_price) / 2) * 10000 AS l2_quoted_spread_bps,
       (bid_size - ask_size) / (bid_size + ask_size) AS l2_book_imbalance, coalesce(n, 0) AS l2_snapshot_count
FROM (SELECT DISTINCT date, ticker FROM v_order_book) p LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY date, ticker) AS n FROM v_preopen
      QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY captured_at DESC, seq DESC) = 1) q USING (date, ticker)""")


@query("a8_order_book", "SELECT date, ticker, round(l2_bid_ask_spread, 6) AS l2_bid_ask_spread, round(l2_quoted_spread_bps, 6) AS l2_quoted_spread_bps, round(l2_book_imbalance, 6) AS l2_book_imbalance, l2_snapshot_count FROM v_book_features")
def a8(spark, sf):
    b = T.order_book(spark, sf)
    return rounded(OB.order_book_features(b, b))


@query("a8_dates_without_book", "SELECT date FROM v_bdays24 WHERE date NOT IN (SELECT date FROM v_order_book WHERE bid_price > 250)")
def a8b(spark, sf):
    b = T.order_book(spark, sf)
    return OB.dates_without_book(b.where(F.col("bid_price") > 250), D.business_days(D.span_of(b, "date")))


view("v_bdays24", "SELECT date FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS a, max(date) AS b FROM v_order_book)) WHERE dayofweek(date) BETWEEN 1 AND 5")

# ---- securities and universe ----------------------------------------------------


@query("j12_active_security", """
WITH p AS (SELECT DISTINCT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT *, row(coalesce(start_date, DATE '0001-01-01'), coalesce(end_date, DATE '9999-12-31'), security_id) AS o FROM v_securities)
SELECT p.ticker, p.date, coalesce(arg_max(security_id, o) FILTER ((start_date IS NULL OR start_date <= date) AND (end_date IS NULL OR date <= end_date)), arg_max(security_id, o)) AS security_id,
       bool_or((start_date IS NULL OR start_date <= date) AND (end_date IS NULL OR date <= end_date)) AS active
FROM p JOIN s USING (ticker) GROUP BY 1, 2""")
def j12(spark, sf):
    o = T.table(spark, sf, "orders")
    c = T.table(spark, sf, "customer")
    days = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).distinct()
    return active_interval_join(days, T.security_master(spark, sf), on="ticker", time="date", start="start_date", end="end_date", ident="security_id")


view("v_member_days", """
SELECT d.date, t.ticker, coalesce(e.was_in, m.ticker IS NOT NULL) AS member
FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date) d
CROSS JOIN (SELECT ticker FROM v_members UNION SELECT ticker FROM v_changes) t LEFT JOIN v_members m ON m.ticker = t.ticker
LEFT JOIN LATERAL (SELECT arg_min(w, date) AS was_in FROM (SELECT c.date, bool_or(action = 'removed') AS w FROM v_changes c WHERE c.ticker = t.ticker AND c.date > d.date GROUP BY 1)) e ON true""")


@query("u1_membership", "SELECT ticker FROM v_member_days WHERE member AND date = '2024-01-15'")
def u1(spark, sf):
    return U.members_on(T.current_members(spark, sf), T.index_changes(spark, sf), "2024-01-15")


@query("u2_members_ever", "SELECT ticker FROM v_member_days WHERE member AND date = '2024-01-05' UNION SELECT ticker FROM v_changes WHERE date BETWEEN '2024-01-05' AND '2024-01-06'")
def u2(spark, sf):
    return U.members_ever(T.current_members(spark, sf), T.index_changes(spark, sf), "2024-01-05", "2024-01-06")


@query("u3_members_daily", "SELECT date, ticker FROM v_member_days WHERE member AND dayofweek(date) BETWEEN 1 AND 5 AND date BETWEEN '2024-01-01' AND '2024-02-02'")
def u3(spark, sf):
    return U.members_daily(T.current_members(spark, sf), T.index_changes(spark, sf), "2024-01-01", "2024-02-02")


@query("u4_fetch_scope", "SELECT ticker FROM v_member_days WHERE member AND date = '2024-01-05' UNION SELECT ticker FROM v_changes WHERE date BETWEEN '2024-01-05' AND '2024-01-06' UNION SELECT 'SPY'")
def u4(spark, sf):
    return U.fetch_scope(T.current_members(spark, sf), T.index_changes(spark, sf), "2024-01-05", "2024-01-06")


# ---- quality -------------------------------------------------------------------

PANEL_ROWS = 100_000  # raw rows of a task; the panel has a few rows for each


def _dealt_bars(spark, sf):
    return T.spread(T.bars(spark, sf), "ticker", T.table(spark, sf, "lineitem"), PANEL_ROWS)


def _panel_tasks(spark, sf):
    return T.tasks(T.table(spark, sf, "lineitem"), PANEL_ROWS)


def quality_panel(spark, sf, bars=None):
    """Every business day between a ticker's first and last bar, with some earlier and flagged rows."""
    b = (T.bars(spark, sf) if bars is None else bars).groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    b = T.spread(b, "ticker", T.table(spark, sf, "lineitem"), PANEL_ROWS)  # a row becomes thousands
    days = b.select("ticker", F.explode(F.sequence(F.date_sub("a", 3), "b")).alias("date")).where(D.is_weekday("date"))
    return days.select("date", "ticker", F.lit(True).alias("in_universe"), F.lit(True).alias("tradable"), F.lit(True).alias("liquid"),
                       F.lit(False).alias("halted"), F.lit(True).alias("data_quality_ok"),
                       F.when(F.col("ticker") == "S7", "manual;; single_day_move_above_maximum").alias("reason"))


view("v_qpanel", """
SELECT * FROM (SELECT ticker, CAST(unnest(generate_series(min(date) - 3, max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM v_bars GROUP BY ticker) WHERE dayofweek(date) BETWEEN 1 AND 5""")
view("v_barstats", """
SELECT ticker, date AS bar_date, close, volume, avg(dollar_volume) OVER (w ROWS 19 PRECEDING) AS avg_dollar_volume, abs(close / lag(close) OVER w - 1) AS move FROM v_bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
view("v_bar_asof", "SELECT p.ticker, p.date, s.bar_date, s.close, s.volume, s.avg_dollar_volume, s.move FROM v_qpanel p ASOF LEFT JOIN v_barstats s ON p.ticker = s.ticker AND p.date >= s.bar_date")
view("v_streak", """
SELECT ticker, date, CAST(coalesce(max(run), 0) AS INTEGER) AS missing_streak FROM (
 SELECT ticker, date, grp, count(*) FILTER (NOT present) AS run FROM (
  SELECT ticker, date, day, present, sum(present::INT) OVER (PARTITION BY ticker, date ORDER BY day) AS grp FROM (
   SELECT p.ticker, p.date, d.date AS day, b.date IS NOT NULL AS present FROM v_qpanel p
   JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM v_wdays) e ON e.date = p.date
   JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM v_wdays) d ON d.k BETWEEN e.k - 19 AND e.k
   LEFT JOIN v_bars b ON b.ticker = p.ticker AND b.date = d.date)) GROUP BY ticker, date, grp) GROUP BY ticker, date""")
view("v_wdays", "SELECT date FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2003-01-01', INTERVAL 1 DAY)) AS DATE) AS date) WHERE dayofweek(date) BETWEEN 1 AND 5")


@query("w22_avg_dollar_volume", "SELECT ticker, bar_date AS date, round(avg_dollar_volume, 6) AS avg_dollar_volume FROM v_barstats")
def w22(spark, sf):
    return rounded(Q.bar_statistics(T.bars(spark, sf)).select("ticker", "date", "avg_dollar_volume"))


@query("w23_close_move", "SELECT ticker, bar_date AS date, round(move, 6) AS move FROM v_barstats")
def w23(spark, sf):
    return rounded(Q.bar_statistics(T.bars(spark, sf)).select("ticker", "date", "move"))


@query("w24_missing_streak", "SELECT ticker, date, missing_streak FROM v_streak")
def w24(spark, sf):
    return Q.missing_streak(quality_panel(spark, sf), _dealt_bars(spark, sf), tasks=_panel_tasks(spark, sf))


@query("j5_latest_bar", "SELECT ticker, date, bar_date, round(close, 6) AS close, volume, round(avg_dollar_volume, 6) AS avg_dollar_volume, round(move, 6) AS move FROM v_bar_asof")
def j5(spark, sf):
    return rounded(Q.latest_bar_asof(quality_panel(spark, sf).select("ticker", "date"), T.bars(spark, sf)))


LIMITS = Q.QualityLimits(min_average_dollar_volume=25000.0, max_single_day_move=0.10, min_close_price=815.0, min_market_cap=200000.0)

view("v_quality", """
SELECT *, bar_date IS NULL AS no_bars, coalesce(avg_dollar_volume < 25000, false) AS thin, coalesce(close < 815, false) AS cheap,
       bar_date IS NOT NULL AND shares IS NULL AS cap_none, coalesce(close * shares < 200000, false) AS cap_low,
       coalesce(volume = 0, false) AS zero, coalesce(move > 0.10::DOUBLE, false) AS jump, missing_streak > 3 AS gappy
FROM (SELECT q.*, f.shares FROM v_bar_asof q ASOF LEFT JOIN v_filings f ON q.ticker = f.ticker AND q.date >= f.availability_date) JOIN v_streak USING (ticker, date)""")
view("v_quality_rows", """
SELECT date, ticker, true AS in_universe, true AS tradable, NOT (thin OR cheap OR cap_none OR cap_low) AS liquid, zero AND jump AS halted, NOT (no_bars OR zero OR jump OR gappy) AS data_quality_ok,
       nullif(concat_ws('; ', CASE WHEN ticker = 'S7' THEN 'manual; single_day_move_above_maximum' END, CASE WHEN no_bars THEN 'missing_ohlcv_window' END, CASE WHEN thin THEN 'average_dollar_volume_below_minimum' END,
         CASE WHEN cheap THEN 'close_price_below_minimum' END, CASE WHEN cap_none THEN 'market_cap_unavailable' END, CASE WHEN cap_low THEN 'market_cap_below_minimum' END, CASE WHEN zero THEN 'zero_volume' END,
         CASE WHEN jump AND ticker <> 'S7' THEN 'single_day_move_above_maximum' END, CASE WHEN zero AND jump THEN 'halt_detected' END, CASE WHEN gappy THEN 'consecutive_missing_bars_above_maximum' END), '') AS reason
FROM v_quality""")


@query("q1_quality_flags", "SELECT * FROM v_quality_rows")
def q1(spark, sf):
    return Q.quality_flags(quality_panel(spark, sf), _dealt_bars(spark, sf), LIMITS, _shares(spark, sf), tasks=_panel_tasks(spark, sf))


def _shares(spark, sf):
    return T.filings_flat(spark, sf).select("ticker", "availability_date", F.col("shares").alias("shares_outstanding"))


@query("a28_universe_mask", "SELECT * FROM v_quality_rows WHERE date = '1997-06-16'")
def a28(spark, sf):
    day = F.lit("1997-06-16").cast("date")
    return Q.quality_flags(quality_panel(spark, sf).where(F.col("date") == day), _dealt_bars(spark, sf), LIMITS, _shares(spark, sf), tasks=_panel_tasks(spark, sf))
