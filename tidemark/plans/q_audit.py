"""Assembly, audit, coverage and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import rounded
from tidemark.operators import assembly as AS
from tidemark.operators import audit as V
from tidemark.operators import catalog as CA
from tidemark.operators import contracts as C
from tidemark.operators import coverage as CO
from tidemark.operators import fundamentals as FU
from tidemark.operators import market as M
from tidemark.operators import regime as G
from tidemark.operators import review as RV
from tidemark.operators import sessions as D
from tidemark.operators import universe as U
from tidemark.plans import testbed as T
from tidemark.plans.q_eval import _regime_rows
from tidemark.plans.q_market import SWEEP
from tidemark.plans.q_pit import _dates, quality_panel
from tidemark.registry import query, view
from tidemark.session import cut

FEATS = ["returns_1d", "returns_5d", "realized_vol_21d", "atr_14", "rsi_14", "golden_cross_50_200"]


def _market(spark, sf):
    return M.market_features(T.spread(T.bars(spark, sf), "ticker", T.table(spark, sf, "lineitem"))).select("date", "ticker", *FEATS)


def _number(c="ticker"):
    return F.substring(c, 2, 9).cast("int")


def _even(c="ticker"):
    return _number(c) % 2 == 0


# ---- assembly ------------------------------------------------------------------------


@query("j14_assembly", """
SELECT coalesce(m.date, f.date) AS date, coalesce(m.ticker, f.ticker) AS ticker, round(m.returns_1d, 6) AS returns_1d, round(coalesce(m.atr_14, f.atr_14), 6) AS atr_14, round(f.pe, 6) AS pe_ratio,
 CASE WHEN m.ticker IS NOT NULL AND f.ticker IS NOT NULL AND m.atr_14 IS DISTINCT FROM f.atr_14 THEN 'fundamentals:atr_14' ELSE '' END AS conflicts
FROM (SELECT date, ticker, returns_1d, atr_14 FROM v_market_guarded WHERE (dayofyear(date) + CAST(substring(ticker, 2) AS INTEGER)) % 5 <> 0) m
FULL JOIN (SELECT x.date, x.ticker, CASE WHEN CAST(substring(x.ticker, 2) AS INTEGER) % 2 = 0 THEN atr_14 ELSE 1.0::DOUBLE END AS atr_14, pe_ratio AS pe FROM v_market_guarded x JOIN v_fundamentals y ON x.date = y.date AND x.ticker = y.ticker WHERE (dayofyear(x.date) + CAST(substring(x.ticker, 2) AS INTEGER)) % 7 <> 0) f ON m.date = f.date AND m.ticker = f.ticker""")
def j14(spark, sf):
    """Both branches lack some (date, ticker) keys of the whole table."""
    lines = T.table(spark, sf, "lineitem")
    bars = cut(T.bars(spark, sf), "bars")
    # both branches read the market rows
    m = cut(M.market_features(T.spread(bars, "ticker", lines)).select("date", "ticker", "returns_1d", "atr_14"), "market")
    f = FU.fundamental_features(T.filings(spark, sf), bars, tasks=T.tasks(lines)).select("date", "ticker", "pe_ratio")
    other = m.select("date", "ticker", F.when(_even(), F.col("atr_14")).otherwise(1.0).alias("atr_14")).join(f, ["date", "ticker"])
    a = AS.assemble({"market": m.select("date", "ticker", "returns_1d", "atr_14").where((F.dayofyear("date") + _number()) % 5 != 0),
                     "fundamentals": other.where((F.dayofyear("date") + _number()) % 7 != 0)})
    return rounded(a.select("date", "ticker", "returns_1d", "atr_14", "pe_ratio", F.array_join("conflicts", ";").alias("conflicts")))


@query("j14_duplicate_branch_rows", "SELECT 'orders' AS branch, CAST(o_orderdate AS DATE) AS date, 'C' || (o_custkey % 50) AS ticker, count(*) AS copies FROM orders GROUP BY 2, 3 HAVING count(*) > 1")
def j14b(spark, sf):
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("ticker"))
    return AS.duplicate_branch_rows({"orders": o, "bars": T.bars(spark, sf).select("date", "ticker")})


@query("v4_availability", "SELECT event_id, ts < CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS available FROM events")
def v4(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("as_of"), F.to_date("ts").alias("date"))
    return e.select("event_id", AS.available_before_open("as_of").alias("available"))


# ---- recomputation and rules ------------------------------------------------------------


def _stored(spark, sf):
    """A stored copy of the market features: some rows lost, some values drifted, some rows extra."""
    m = _market(spark, sf)
    day = F.dayofmonth("date")
    s = m.where(day != 13).withColumn("rsi_14", F.when((day == 7), F.col("rsi_14") + 0.001).otherwise(F.col("rsi_14") * (1 + 1e-12)))
    return s.unionByName(m.where(day == 20).withColumn("ticker", F.concat("ticker", F.lit("X"))))


view("v_compare", """
SELECT date, ticker, f AS feature, CASE WHEN day(date) = 13 THEN 'missing' WHEN day(date) = 7 AND f = 'rsi_14' AND rsi_14 IS NOT NULL THEN 'mismatch' ELSE 'match' END AS status FROM v_market_guarded, (SELECT unnest([""" + ", ".join(f"'{c}'" for c in FEATS) + """]) AS f)
UNION ALL SELECT date, ticker || 'X', f, 'unexpected' FROM v_market_guarded, (SELECT unnest([""" + ", ".join(f"'{c}'" for c in FEATS) + """]) AS f) WHERE day(date) = 20""")


@query("v1_recompute_compare", "SELECT feature, status, count(*) AS n, min(date) AS first_date FROM v_compare GROUP BY 1, 2")
def v1(spark, sf):
    c = V.compare_features(_stored(spark, sf), _market(spark, sf), FEATS)
    return c.groupBy("feature", "status").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query("v1_branch_status", "SELECT ticker, status, count(*) AS days FROM (SELECT date, ticker, CASE WHEN count(*) FILTER (status <> 'match') > 0 THEN 'fail' WHEN count(*) FILTER (status IN ('match', 'mismatch')) = 0 THEN 'warn' ELSE 'pass' END AS status FROM v_compare GROUP BY 1, 2) GROUP BY 1, 2")
def v1b(spark, sf):
    c = V.compare_features(_stored(spark, sf), _market(spark, sf), FEATS)
    return V.branch_status(c, {f: "market" for f in FEATS}).groupBy("ticker", "status").agg(F.count(F.lit(1)).alias("days"))


RULES = {"returns_1d": ("market", "number", True, False, -0.05, 0.05, None), "atr_14": ("market", "number", True, True, 0.0, 60.0, None), "rsi_14": ("market", "number", True, True, 20.0, 80.0, None),
         "sector": ("sector", "string", False, True, None, None, ["ASIA", "EUROPE"]),
         # required, but no column of the table
         "macd_signal": ("market", "number", True, False, None, None, None), "vix_level": ("macro", "number", True, True, None, None, None)}


def _checked(spark, sf):
    f = _market(spark, sf).select("date", "ticker", "returns_1d", "atr_14", "rsi_14", "returns_5d").join(T.ticker_sectors(spark, sf), "ticker")
    rules = CA.rules_table(spark, RULES)
    return V.check_rules(f, rules), rules, f


view("v_checked", """
WITH m AS (SELECT * FROM v_market_guarded JOIN v_ticker_sectors USING (ticker))
SELECT date, ticker, 'returns_1d' AS feature, 'market' AS owner, returns_1d AS number, CASE WHEN returns_1d IS NULL THEN 'null value is not allowed' WHEN returns_1d < -0.05::DOUBLE THEN 'below minimum' WHEN returns_1d > 0.05::DOUBLE THEN 'above maximum' END AS message FROM m
UNION ALL SELECT date, ticker, 'atr_14', 'market', atr_14, CASE WHEN atr_14 < 0 THEN 'below minimum' WHEN atr_14 > 60 THEN 'above maximum' END FROM m
UNION ALL SELECT date, ticker, 'rsi_14', 'market', rsi_14, CASE WHEN rsi_14 < 20 THEN 'below minimum' WHEN rsi_14 > 80 THEN 'above maximum' END FROM m
UNION ALL SELECT date, ticker, 'returns_5d', NULL, returns_5d, 'unknown feature' FROM m
UNION ALL SELECT date, ticker, 'sector', 'sector', NULL, CASE WHEN sector NOT IN ('ASIA', 'EUROPE') THEN 'value not allowed' END FROM m""")


@query("f16_value_rules", "SELECT date, ticker, feature, message FROM v_checked WHERE message IS NOT NULL AND owner IS NOT NULL")
def f16(spark, sf):
    c, _, _ = _checked(spark, sf)
    return c.where(F.col("message").isNotNull() & F.col("owner").isNotNull()).select("date", "ticker", "feature", "message")


@query("v2_catalog_validation", "SELECT feature, message, count(*) AS n FROM v_checked GROUP BY 1, 2")
def v2(spark, sf):
    c, _, _ = _checked(spark, sf)
    return c.groupBy("feature", "message").agg(F.count(F.lit(1)).alias("n"))


view("v_feature_quality", """
SELECT family, sum(observations)::BIGINT AS observations, sum(nulls)::BIGINT AS nulls, sum(finite_numeric)::BIGINT AS finite_numeric, sum(required_observations)::BIGINT AS required_observations, sum(required_nulls)::BIGINT AS required_nulls, sum(failures)::BIGINT AS failures FROM (
 SELECT coalesce(owner, 'uncataloged') AS family, count(*) AS observations, count(*) FILTER (number IS NULL AND feature <> 'sector') AS nulls, count(number) AS finite_numeric, count(*) FILTER (feature IN ('returns_1d', 'atr_14', 'rsi_14')) AS required_observations,
  count(*) FILTER (feature IN ('returns_1d', 'atr_14', 'rsi_14') AND number IS NULL) AS required_nulls, count(*) FILTER (feature IN ('returns_1d', 'atr_14', 'rsi_14') AND message IS NOT NULL) AS failures FROM v_checked GROUP BY 1
 UNION ALL SELECT 'market', 0, 0, 0, count(*), count(*), count(*) FROM v_checked WHERE feature = 'atr_14'
 UNION ALL SELECT 'macro', 0, 0, 0, count(*), count(*), 0 FROM v_checked WHERE feature = 'atr_14') GROUP BY 1""")


@query("a16_feature_quality", "SELECT * FROM v_feature_quality")
def a16(spark, sf):
    c, rules, f = _checked(spark, sf)
    return CO.feature_quality(c, rules, f)


@query("a18_acceptance", """
SELECT *, has_raw_price_data AND has_min_feature_rows AND has_no_missing_date_first_shards AND required_feature_null_rate_ok AND catalog_validation_ok AND has_min_label_pairs AND best_candidate_correlation_ok AS accepted,
 CASE WHEN has_raw_price_data AND has_min_feature_rows AND has_no_missing_date_first_shards AND required_feature_null_rate_ok AND catalog_validation_ok AND has_min_label_pairs AND best_candidate_correlation_ok THEN 'proceed'
  WHEN NOT (has_raw_price_data AND has_no_missing_date_first_shards AND catalog_validation_ok) THEN 'do_not_proceed' ELSE 'needs_human_review' END AS recommendation
FROM (SELECT (SELECT count(*) FROM v_bars) > 0 AS has_raw_price_data, (SELECT count(*) FROM v_market_guarded) >= 1 AS has_min_feature_rows,
 (SELECT count(*) FROM (SELECT ticker, date FROM v_bars EXCEPT SELECT ticker, date FROM v_market_guarded)) = 0 AS has_no_missing_date_first_shards,
 (SELECT sum(required_nulls) / sum(required_observations) FROM v_feature_quality) <= 0.35::DOUBLE AS required_feature_null_rate_ok, (SELECT sum(failures) FROM v_feature_quality) = 0 AS catalog_validation_ok,
 (SELECT arg_max(label_pairs, score) FROM v_sweep) >= 3 AS has_min_label_pairs, (SELECT max(score) FROM v_sweep) >= 0.1::DOUBLE AS best_candidate_correlation_ok)""")
def a18(spark, sf):
    c, rules, f = _checked(spark, sf)
    bars = T.bars(spark, sf)
    best = M.best_candidate(M.sweep_candidates(bars, windows=SWEEP))
    m = _market(spark, sf)
    missing = bars.select("ticker", "date").join(m, ["ticker", "date"], "left_anti")
    return CO.acceptance(CO.feature_quality(c, rules, f), best, feature_rows=m, missing_keys=missing, prices=bars, min_score=0.1)


@query("v3_leakage", """
SELECT ticker, max(availability_date) FILTER (availability_date < '1998-06-30') AS latest_prior, min(availability_date) FILTER (availability_date >= '1998-06-30') AS earliest_future, count(*) FILTER (availability_date >= '1998-06-30') AS rows_on_or_after,
 count(*) AS rows_total, CASE WHEN count(*) FILTER (availability_date >= '1998-06-30') > 0 THEN 'warn' ELSE 'pass' END AS status FROM v_filings GROUP BY 1""")
def v3(spark, sf):
    return V.leakage_boundaries(T.filings_flat(spark, sf), "availability_date", "1998-06-30", ["ticker"])


@query("v3_macro_leakage", """
SELECT series_id, max(realtime_start) FILTER (realtime_start < '1998-06-30') AS latest_prior, min(realtime_start) FILTER (realtime_start >= '1998-06-30') AS earliest_future, count(*) FILTER (realtime_start >= '1998-06-30') AS rows_on_or_after,
 count(*) AS rows_total, CASE WHEN count(*) FILTER (realtime_start >= '1998-06-30') > 0 THEN 'warn' ELSE 'pass' END AS status FROM v_macro GROUP BY 1""")
def v3b(spark, sf):
    return V.leakage_boundaries(T.macro(spark, sf), "realtime_start", "1998-06-30", ["series_id"])


_SPOT = "(VALUES ('returns_1d', 2), ('returns_5d', 6), ('realized_vol_21d', 22), ('volume_ratio_20', 20), ('rsi_14', 15)) f(feature, k)"
view("v_spot", f"""
WITH b AS (SELECT ticker, date, adj_close, volume::DOUBLE AS volume, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM v_bars),
m AS (UNPIVOT (SELECT ticker, date, returns_1d, returns_5d, realized_vol_21d, volume_ratio_20, rsi_14 FROM v_market_guarded) ON returns_1d, returns_5d, realized_vol_21d, volume_ratio_20, rsi_14 INTO NAME feature VALUE expected)
SELECT b.ticker, b.date, f.feature, f.k, b.n, m.expected, CASE WHEN day(b.date) = 14 THEN NULL WHEN day(b.date) = 13 THEN m.expected + 0.001 ELSE m.expected END AS stored,
 p.date AS window_start, q.date AS window_end, CASE WHEN f.feature = 'volume_ratio_20' THEN p.volume ELSE p.adj_close END AS first_input, CASE WHEN f.feature = 'volume_ratio_20' THEN q.volume ELSE q.adj_close END AS last_input
FROM b, {_SPOT} LEFT JOIN m ON m.ticker = b.ticker AND m.date = b.date AND m.feature = f.feature LEFT JOIN b p ON p.ticker = b.ticker AND p.n = b.n - f.k AND b.n > f.k LEFT JOIN b q ON q.ticker = b.ticker AND q.n = b.n - 1 AND b.n > f.k""")


@query("v5_spot_checks", """
SELECT ticker, date, feature, CASE WHEN expected IS NULL THEN 'warn' WHEN stored IS NULL OR abs(stored - expected) > 0.0005 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN n <= k THEN 'insufficient_history' WHEN expected IS NULL THEN 'undefined' END AS reason,
 CASE WHEN n > k THEN k ELSE n - 1 END::INTEGER AS bar_count, window_start, window_end, round(first_input, 6) AS first_input, round(last_input, 6) AS last_input, round(expected, 6) AS expected, round(stored, 6) AS stored, round(abs(stored - expected), 6) AS absolute_difference FROM v_spot""")
def v5(spark, sf):
    b = T.spread(T.bars(spark, sf), "ticker", T.table(spark, sf, "lineitem"))
    day = F.dayofmonth("date")
    m = M.market_features(b).select("date", "ticker", *[F.when(day == 14, None).when(day == 13, F.col(c) + 0.001).otherwise(F.col(c)).alias(c) for c in V.SPOT_BARS])
    first, last = F.try_element_at("raw_inputs", F.lit(1))["value"], F.try_element_at("raw_inputs", F.lit(-1))["value"]
    return rounded(V.spot_checks(b, m).select("ticker", "date", "feature", "status", "reason", "bar_count", "window_start", "window_end", first.alias("first_input"), last.alias("last_input"),
                                              "expected", "stored", "absolute_difference"))


@query("v6_price_coverage", "SELECT date, ticker FROM v_qpanel EXCEPT SELECT date, ticker FROM v_bars")
def v6(spark, sf):
    return V.without_bar(quality_panel(spark, sf).where(C.eligible()), T.bars(spark, sf))


@query("v7_sampled_keys", "SELECT date, ticker FROM v_bars ORDER BY sha256('7|' || CAST(date AS VARCHAR) || '|' || ticker), date, ticker LIMIT 25")
def v7(spark, sf):
    """A report of 25 hash-chosen keys."""
    return V.deterministic_sample(T.bars(spark, sf).select("date", "ticker"), 25)


# ---- membership ----------------------------------------------------------------------------


def _member_days(spark, sf):
    return U.members_daily(T.current_members(spark, sf), T.index_changes(spark, sf), "2024-01-03", "2024-01-26")


view("v_file_days", "SELECT date, ticker FROM v_member_days WHERE member AND dayofweek(date) BETWEEN 1 AND 5 AND date BETWEEN '2024-01-03' AND '2024-01-26'")
view("v_boundary", """
SELECT e.*, e.date IN (SELECT date FROM v_file_days) AND e.prev IN (SELECT date FROM v_file_days) AS has_files, a.ticker IS NOT NULL AS on_resolved, b.ticker IS NOT NULL AS before_resolved
FROM (SELECT date, action, ticker, date - CASE dayofweek(date) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS prev, count(*) OVER (PARTITION BY date, ticker) > 1 AS self_cancelling FROM (SELECT DISTINCT date, action, ticker FROM v_changes)) e
LEFT JOIN v_file_days a ON a.date = e.date AND a.ticker = e.ticker LEFT JOIN v_file_days b ON b.date = e.prev AND b.ticker = e.ticker""")


@query("j17_boundary_join", "SELECT date, action, ticker, has_files, self_cancelling, on_resolved, before_resolved FROM v_boundary")
def j17(spark, sf):
    return V.membership_events(T.index_changes(spark, sf), _member_days(spark, sf)).select("date", "action", "ticker", "has_files", "self_cancelling", "on_resolved", "before_resolved")


view("v_findings", """
SELECT date, action, ticker, CASE WHEN NOT has_files OR self_cancelling THEN 'skipped' WHEN good THEN 'consistent' ELSE 'mismatched' END AS status, CASE WHEN NOT has_files THEN 'missing_boundary_membership_file' WHEN self_cancelling THEN 'self_canceling_event' WHEN good THEN NULL
 WHEN action = 'added' THEN CASE WHEN before_resolved AND on_resolved THEN 'addition_already_present_before_event' WHEN NOT before_resolved AND NOT on_resolved THEN 'addition_missing_on_event_date' ELSE 'addition_present_before_event_but_missing_on_event_date' END
 ELSE CASE WHEN NOT before_resolved AND on_resolved THEN 'removal_present_only_on_event_date' WHEN NOT before_resolved AND NOT on_resolved THEN 'removal_missing_before_event' ELSE 'removal_still_present_on_event_date' END END AS finding
FROM (SELECT *, CASE WHEN action = 'added' THEN NOT before_resolved AND on_resolved ELSE before_resolved AND NOT on_resolved END AS good FROM v_boundary)""")


@query("v8_membership_audit", "SELECT date, action, ticker, status, finding FROM v_findings")
def v8(spark, sf):
    e = V.membership_events(T.index_changes(spark, sf), _member_days(spark, sf))
    return V.membership_findings(e).select("date", "action", "ticker", "status", "finding")


@query("v8_membership_summary", "SELECT count(*) FILTER (status <> 'skipped') AS checked, count(*) FILTER (status = 'mismatched') AS violations, 0::BIGINT AS resolved, count(*) FILTER (status = 'skipped') AS skipped, round(count(*) FILTER (status = 'mismatched') / count(*) FILTER (status <> 'skipped'), 6) AS violation_rate FROM v_findings")
def v8b(spark, sf):
    e = V.membership_events(T.index_changes(spark, sf), _member_days(spark, sf))
    return rounded(V.membership_summary(V.membership_findings(e)))


@query("v8_membership_days", """
SELECT d.date, coalesce(members, 0) AS members, coalesce(duplicates, 0) AS duplicates, coalesce(members, 0) = 0 AS empty FROM v_bdays24 d LEFT JOIN (SELECT date, count(*) AS members, count(*) FILTER (n > 1) AS duplicates FROM (SELECT date, ticker, count(*) AS n FROM (SELECT date, ticker FROM v_file_days UNION ALL SELECT date, ticker FROM v_file_days WHERE day(date) = 9) GROUP BY 1, 2) GROUP BY 1) USING (date)""")
def v8c(spark, sf):
    m = _member_days(spark, sf)
    days = D.business_days(D.span_of(T.table(spark, sf, "events"), "ts"))
    return V.membership_day_checks(m.unionByName(m.where(F.dayofmonth("date") == 9)), days)


# ---- archive listings and runs -----------------------------------------------------------------


def _runs(spark, sf):
    """Orders as pipeline runs: stage by priority, one run per order, status by order status."""
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("run"), k % 20, F.when(k % 3 != 0, F.concat(F.lit("-v"), k % 7, F.lit("-x"))).otherwise("")).alias("run_id"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("stage"),
                    F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
                    F.when(k % 5 != 0, k * 7 % 1000).alias("finished_at"), (k % 1000).alias("started_at"), k.alias("key"))


view("v_runs", """
SELECT 'run' || (k % 20) || CASE WHEN k % 3 <> 0 THEN '-v' || (k % 7) || '-x' ELSE '' END AS run_id, substring(o_orderpriority, 1, 1) AS stage, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 CASE WHEN k % 5 <> 0 THEN k * 7 % 1000 END AS finished_at, k % 1000 AS started_at, k AS key FROM (SELECT *, o_orderkey AS k FROM orders)""")


@query("a29_latest_completed_runs", "SELECT stage, date, arg_max(run_id, row(coalesce(finished_at, started_at), run_id)) AS run_id, max(coalesce(finished_at, started_at)) AS finished_at FROM v_runs WHERE status = 'completed' GROUP BY 1, 2")
def a29(spark, sf):
    return CO.latest_completed_runs(_runs(spark, sf))


@query("v11_run_families", "SELECT key, run_id, regexp_extract(run_id, '^(.*?)(?:-v(\\d+).*)?$', 1) AS family, TRY_CAST(regexp_extract(run_id, '^(.*?)(?:-v(\\d+).*)?$', 2) AS INTEGER) AS version, status, run_id = 'run3-v3-x' AS exact, run_id <> 'run3-v3-x' AND status = 'running' AS stale FROM v_runs WHERE regexp_extract(run_id, '^(.*?)(?:-v(\\d+).*)?$', 1) = 'run3'")
def v11(spark, sf):
    r = _runs(spark, sf)
    return V.run_families(r.withColumn("finished_at", F.col("key")), "run3-v3-x").select(F.col("finished_at").alias("key"), "run_id", "family", "version", "status", "exact", "stale")


def _listing(spark, sf):
    b = T.bars(spark, sf)
    d = b.where(F.col("volume") % 9 != 0).select(F.concat(F.lit("features/"), F.col("date").cast("string"), F.lit("/"), "ticker", F.lit(".parquet")).alias("key"))
    h = b.select(F.concat(F.lit("features/history/"), "ticker", F.lit(".parquet")).alias("key")).distinct()
    o = T.ticker_sectors(spark, sf).select(F.concat(F.lit("features/tmp/"), "ticker", F.lit(".json")).alias("key"))
    return d.unionByName(h).unionByName(o)


@query("v10_layout_classes", "SELECT 'dated' AS layout, count(*) AS keys, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates FROM v_bars WHERE volume % 9 <> 0 UNION ALL SELECT 'history', count(DISTINCT ticker), count(DISTINCT ticker), 0 FROM v_bars UNION ALL SELECT 'other', count(*), 0, 0 FROM v_ticker_sectors")
def v10(spark, sf):
    return V.classify_keys(_listing(spark, sf)).groupBy("layout").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("dates"))


@query("v10_layout_inventory", "SELECT date, count(*) AS expected, count(*) FILTER (volume % 9 <> 0) AS listed, count(*) FILTER (volume % 9 = 0) AS missing FROM v_bars GROUP BY 1")
def v10b(spark, sf):
    return V.layout_inventory(V.classify_keys(_listing(spark, sf)), T.bars(spark, sf))


@query("v9_provenance", """
SELECT 'c' || c_custkey AS run_id, field, CASE WHEN c_custkey % 7 = 1 AND field = 'policy' THEN 'manifest_field_missing' WHEN c_custkey % 7 = 2 AND field = 'policy' THEN 'manifest_policy_mismatch' WHEN c_custkey % 11 = 3 AND field = 'source' THEN 'report_field_missing' WHEN c_custkey % 11 = 4 AND field = 'source' THEN 'report_manifest_mismatch' END AS error
FROM customer, (SELECT unnest(['policy', 'source']) AS field)""")
def v9(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.lit("policy"), F.lit("source"))).alias("field"))
    k, f = F.col("c_custkey"), F.col("field")
    base = c.select("c_custkey", F.concat(F.lit("c"), k).alias("run_id"), "field", F.concat("field", F.lit("-v1")).alias("value"))
    man = base.where(~((k % 7 == 1) & (f == "policy"))).withColumn("value", F.when((k % 7 == 2) & (f == "policy"), "old").otherwise(F.col("value")))
    rep = man.where(~((k % 11 == 3) & (f == "source"))).withColumn("value", F.when((k % 11 == 4) & (f == "source"), "other").otherwise(F.col("value")))
    return V.provenance_checks(base, man, rep).select("run_id", "field", "error")


@query("v12_evaluation_scope", """
SELECT (SELECT count(*) FROM v_bdays) AS requested, (SELECT count(*) FROM v_dates) AS observed, (SELECT count(*) FROM v_bdays WHERE date NOT IN (SELECT date FROM v_dates)) AS missing, (SELECT count(*) FROM v_dates WHERE date NOT IN (SELECT date FROM v_bdays)) AS unexpected,
 (SELECT string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) FROM orders) AS dropped_columns, CASE WHEN (SELECT count(*) FROM v_bdays WHERE date NOT IN (SELECT date FROM v_dates)) > 0 THEN 'missing_dates;' ELSE '' END || 'unexpected_dates;dropped_columns' AS warnings""")
def v12(spark, sf):
    o = T.table(spark, sf, "orders")
    s = V.evaluation_scope(D.business_days(D.span_of(o, "o_orderdate")), _dates(spark, sf), o.select(F.col("o_orderpriority").alias("column")))
    return s.withColumn("dropped_columns", F.array_join("dropped_columns", ";")).withColumn("warnings", F.array_join("warnings", ";"))


@query("v13_artifact_checks", """
SELECT date, ticker, sum(c)::BIGINT AS rows, count(*) AS artifacts, sum(CASE WHEN a <> date THEN c ELSE 0 END)::BIGINT AS foreign_rows, max(c) > 1 AS duplicate_in_artifact, count(*) > 1 AS duplicate_across_artifacts
FROM (SELECT CAST(o_orderdate AS DATE) AS date, 'C' || (o_custkey % 40) AS ticker, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS a, count(*) AS c FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def v13(spark, sf):
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("ticker"),
                                            F.date_add(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)).alias("artifact_date"))
    return V.artifact_checks(o)


def _diag(spark, sf):
    k = F.datediff("date", F.lit("1990-01-01").cast("date"))
    d = _dates(spark, sf)
    runs = d.where(k % 13 != 0).select("date", (k % 17 != 1).alias("valid"), F.when(k % 19 == 2, "layer1").otherwise("layer1_5_regime").alias("stage"), F.when(k % 5 == 3, "running").otherwise("completed").alias("status"),
                                       F.when(k % 23 == 4, "elsewhere").otherwise("out").alias("output_path"), F.lit("out").alias("expected_path"), (k % 29 != 5).alias("infers_date"))
    outs = d.where(k % 7 != 6).select("date", (k % 31 != 7).alias("has_columns"), F.when(k % 37 == 8, 2).otherwise(1).alias("row_count"), (k % 11 != 9).alias("populated"), (k % 3 != 0).alias("required"))
    return d, runs, outs


@query("v14_regime_diagnostic", """
SELECT date, coalesce(r, CASE WHEN k % 3 <> 0 THEN 'ready' ELSE 'legacy_missing_diagnostics' END) AS reason, CASE WHEN r IS NOT NULL THEN 'failure' WHEN k % 3 <> 0 THEN 'ready' ELSE 'warning' END AS regime_status, CASE WHEN r IS NULL OR r = 'required_regime_output_is_null' THEN k % 3 <> 0 ELSE false END AS required_for_ranker
FROM (SELECT date, k, CASE WHEN k % 13 = 0 THEN 'missing_regime_manifest' WHEN k % 17 = 1 THEN 'invalid_regime_manifest' WHEN k % 19 = 2 THEN 'regime_manifest_stage_mismatch' WHEN k % 5 = 3 THEN 'regime_manifest_not_completed' WHEN k % 23 = 4 THEN 'regime_manifest_output_mismatch'
 WHEN k % 29 = 5 THEN 'regime_manifest_missing_inference_date' WHEN k % 7 = 6 THEN 'missing_regime_output' WHEN k % 31 = 7 THEN 'regime_output_missing_columns' WHEN k % 37 = 8 THEN 'regime_output_row_count_mismatch' WHEN k % 3 <> 0 AND k % 11 = 9 THEN 'required_regime_output_is_null' END AS r FROM (SELECT date, date - DATE '1990-01-01' AS k FROM v_dates))""")
def v14(spark, sf):
    return V.regime_diagnostic(*_diag(spark, sf))


@query("v15_stored_rows", "SELECT q.ticker, q.date, count(b.c) AS rows, CASE count(b.c) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'several' END AS finding FROM v_qpanel q LEFT JOIN (SELECT ticker, date, 1 AS c FROM v_bars UNION ALL SELECT ticker, date, 1 FROM v_bars WHERE volume % 50 = 0) b USING (ticker, date) GROUP BY 1, 2")
def v15(spark, sf):
    b = T.bars(spark, sf)
    return V.stored_row_counts(quality_panel(spark, sf), b.unionByName(b.where(F.col("volume") % 50 == 0)))


# ---- coverage -----------------------------------------------------------------------------------


@query("a13_adjusted_close_counts", "SELECT ticker, count(*) AS observed_rows, count(*) FILTER (abs(close - adj_close) <= 1e-9) AS equal_rows, count(*) FILTER (abs(close - adj_close) > 1e-9) AS different_rows, true AS consistent FROM v_bars GROUP BY 1")
def a13(spark, sf):
    return CO.adjusted_close_counts(T.bars(spark, sf), ["ticker"])


view("v_stored_rows", "SELECT ticker, date FROM v_bars UNION ALL SELECT ticker, date FROM v_bars WHERE day(date) = 9 UNION ALL SELECT 'ZZ' || ticker, date FROM v_bars WHERE day(date) = 17")
view("v_coverage", """
SELECT date, ticker, coalesce(n, 0) AS row_count, CASE WHEN n IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'present' END AS status
FROM (SELECT DISTINCT date, ticker, true AS e FROM v_qpanel) FULL JOIN (SELECT date, ticker, count(*) AS n FROM v_stored_rows GROUP BY 1, 2) USING (date, ticker)""")
_COVERAGE = """count(*) FILTER (status <> 'unexpected') AS expected, count(*) FILTER (status IN ('present', 'duplicate')) AS present, count(*) FILTER (status = 'missing') AS missing,
 count(*) FILTER (status = 'unexpected') AS unexpected, count(*) FILTER (status = 'duplicate') AS duplicate, sum(row_count)::BIGINT AS row_count FROM v_coverage GROUP BY 1"""


def _stored_rows(spark, sf):
    """The bars, with some rows twice and some under foreign tickers."""
    b = T.bars(spark, sf).select("ticker", "date")
    day = F.dayofmonth("date")
    return b.unionByName(b.where(day == 9)).unionByName(b.where(day == 17).withColumn("ticker", F.concat(F.lit("ZZ"), "ticker")))


@query("a19_coverage_by_date", f"SELECT date, {_COVERAGE}")
def a19(spark, sf):
    return CO.coverage_by_date(quality_panel(spark, sf), _stored_rows(spark, sf))


@query("a19_coverage_by_ticker", f"SELECT ticker, {_COVERAGE}")
def a19b(spark, sf):
    return CO.coverage_by_ticker(quality_panel(spark, sf), _stored_rows(spark, sf))


@query("a19_coverage_rows", "SELECT date, ticker, row_count, status FROM v_coverage WHERE status <> 'present'")
def a19c(spark, sf):
    return CO.coverage_rows(quality_panel(spark, sf), _stored_rows(spark, sf)).where(F.col("status") != "present")


@query("o4_capped_samples", "SELECT ticker, array_to_string((list(d ORDER BY d))[1:3], ';') AS sample FROM (SELECT DISTINCT ticker, CAST(date AS VARCHAR) AS d FROM v_bars) GROUP BY 1")
def o4(spark, sf):
    b = T.bars(spark, sf).select("ticker", F.col("date").cast("string").alias("d"))
    return CO.first_names(b, ["ticker"], "d", 3).withColumn("sample", F.array_join("sample", ";"))


@query("o1_ordered_articles", "SELECT url, published_at, source, row_number() OVER (ORDER BY published_at, coalesce(source, ''), url) AS position FROM v_articles")
def o1(spark, sf):
    """Deterministic order with missing text first: positions from the rank helper, so no single-task sort."""
    from tidemark.functions.ranking import with_ranks
    a = T.articles(spark, sf).select("url", "published_at", "source", F.struct("published_at", F.coalesce("source", F.lit("")).alias("s"), "url").alias("k")).withColumn("g", F.lit(0))
    return with_ranks(a, ["g"], "k", position="ordinal").select("url", "published_at", "source", (F.col("position") + 1).alias("position"))


@query("o2_latest_row", "SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM (SELECT ticker, date, round(close, 6) AS close FROM v_bars) GROUP BY 1")
def o2(spark, sf):
    from tidemark.functions.maths import latest_per_key
    return rounded(latest_per_key(T.bars(spark, sf).select("ticker", "date", "close"), ["ticker"], [F.col("date")]))


@query("a20_archive_readiness", """
SELECT (SELECT count(*) FROM v_cal) AS news_expected, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) AS news_present, (SELECT count(*) FROM v_bdays) AS universe_expected, (SELECT count(*) FROM v_bdays WHERE date IN (SELECT date FROM v_dates)) AS universe_present,
 (SELECT count(*) FROM v_bdays) AS macro_expected, (SELECT count(*) FROM v_bdays WHERE date IN (SELECT observation_date FROM v_macro)) AS macro_present, (SELECT count(*) FROM v_ticker_sectors) AS tickers, (SELECT count(*) FROM (SELECT ticker FROM v_filings GROUP BY 1 HAVING count(*) < 28)) AS thin_tickers,
 (SELECT count(*) FROM v_cal WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)) = 0 AND (SELECT count(*) FROM v_bdays WHERE date NOT IN (SELECT date FROM v_dates)) = 0 AND (SELECT count(*) FROM v_bdays WHERE date NOT IN (SELECT observation_date FROM v_macro)) = 0 AND (SELECT count(*) FROM (SELECT ticker FROM v_filings GROUP BY 1 HAVING count(*) < 28)) = 0 AS ready""")
def a20(spark, sf):
    s = D.span_of(T.table(spark, sf, "orders"), "o_orderdate")
    m = T.macro(spark, sf).select(F.col("observation_date").alias("date"))
    return CO.archive_readiness(calendar=D.calendar_dates(s), weekdays=D.business_days(s), news=m, universe=_dates(spark, sf), macro=m, tickers=T.ticker_sectors(spark, sf), filings=T.filings_flat(spark, sf), min_filings=28)


@query("a21_filings_coverage", "SELECT ticker, coalesce(n, 0) AS row_count, sector = 'ASIA' AS active, CASE WHEN n IS NULL THEN 'missing_archive' ELSE 'below_min_rows' END AS reason FROM v_ticker_sectors LEFT JOIN (SELECT ticker, count(*) AS n FROM v_filings WHERE ticker NOT IN ('S5', 'S6') AND report_date > '1995-04-01' AND (ticker <> 'S8' OR report_date > '1999-01-01') GROUP BY 1) USING (ticker) WHERE coalesce(n, 0) < 20")
def a21(spark, sf):
    f = T.filings_flat(spark, sf).where(~F.col("ticker").isin("S5", "S6") & (F.col("report_date") > F.lit("1995-04-01").cast("date")) & ((F.col("ticker") != "S8") | (F.col("report_date") > F.lit("1999-01-01").cast("date"))))
    t = T.ticker_sectors(spark, sf)
    return CO.filings_coverage(t, f, t.where("sector = 'ASIA'"), min_rows=20)


@query("a22_regime_coverage", """
SELECT e.date, count(*) AS expected_rows, count(h) AS present_rows, count(*) FILTER (n = 5) AS full_rows, count(*) FILTER (h = 1 AND n = 0) AS null_rows, count(*) FILTER (n BETWEEN 1 AND 4) AS partial_rows, count(*) FILTER (label = 'bear') AS bear_rows, count(*) FILTER (label = 'sideways') AS sideways_rows, count(*) FILTER (label = 'bull') AS bull_rows,
 min(conf) AS confidence_min, max(conf) AS confidence_max, round(min(p1 + p2 + p3), 6) AS probability_sum_min, round(max(p1 + p2 + p3), 6) AS probability_sum_max, round(count(*) FILTER (n = 5) / count(*), 6) AS coverage_rate, round(count(*) FILTER (h = 1 AND n = 0) / count(*), 6) AS explicit_null_rate, round((count(*) - count(*) FILTER (n = 5) - count(*) FILTER (h = 1 AND n = 0)) / count(*), 6) AS missing_or_partial_rate
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'K' || o_orderkey AS ticker FROM orders) e LEFT JOIN (SELECT *, 'K' || o_orderkey AS ticker, 1 AS h FROM v_regime_errors WHERE o_orderkey % 6 <> 0) USING (date, ticker) GROUP BY 1""")
def a22(spark, sf):
    r = _regime_rows(spark, sf).withColumn("ticker", F.concat(F.lit("K"), F.col("o_orderkey")))
    return rounded(CO.regime_coverage(r.select("date", "ticker"), r.where(F.col("o_orderkey") % 6 != 0).drop("o_orderkey")))


def _regime_runs(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("r"), k % 12).alias("run_id"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("L"), k % 12).alias("regime_label"))
    runs = rows.select("run_id").distinct().select("run_id", F.when(F.substring("run_id", 2, 9).cast("int") % 4 == 1, "failed").otherwise("completed").alias("status"), (F.substring("run_id", 2, 9).cast("int") * 5 % 12).alias("finished_at"), F.lit("1995-06-30").cast("date").alias("train_end"))
    return rows, runs


@query("a33_regime_choice", "SELECT date, arg_max('r' || i, row(i * 5 % 12, 'r' || i)) AS run_id, arg_max('L' || i, row(i * 5 % 12, 'r' || i)) AS regime_label FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey % 12 AS i FROM orders) WHERE i % 4 <> 1 GROUP BY 1")
def a33(spark, sf):
    return CO.choose_regime_rows(*_regime_runs(spark, sf))


@query("a33_regime_row_errors", "SELECT run_id, date, concat_ws(';', CASE WHEN c > 1 THEN 'duplicate_row' END, CASE WHEN dayofweek(date) IN (0, 6) THEN 'unexpected_date' END, CASE WHEN date <= '1995-06-30' THEN 'inside_training_span' END) AS errors FROM (SELECT 'r' || (o_orderkey % 12) AS run_id, CAST(o_orderdate AS DATE) AS date, count(*) AS c FROM orders GROUP BY 1, 2) WHERE c > 1 OR dayofweek(date) IN (0, 6) OR date <= '1995-06-30'")
def a33b(spark, sf):
    rows, runs = _regime_runs(spark, sf)
    return CO.regime_row_errors(rows, runs, D.business_days(D.span_of(T.table(spark, sf, "orders"), "o_orderdate")))


# ---- reviews --------------------------------------------------------------------------------------


def _review_rows(spark, sf):
    """All scored rows, those without an article id included; some without text."""
    s = T.scored_news(spark, sf)
    n = F.length("text")
    return s.withColumn("headline", F.concat(F.lit("Head "), F.coalesce(F.substring("article_id", -1, 1), F.lit("none")))).withColumn(
        "text", F.when(n % 9 == 4, F.lit(None)).otherwise(F.col("text"))).withColumn("sentence_index", F.when(F.col("sentence_index") == 3, 2).otherwise(F.col("sentence_index")))


view("v_review", """
SELECT *, coalesce(article_id, 'article-' || substring(sha256(date || '|' || lower(headline) || '|' || published_at), 1, 16)) AS aid FROM (
 SELECT * REPLACE (CASE WHEN length(text) % 9 = 4 THEN NULL ELSE text END AS text, CASE WHEN sentence_index = 3 THEN 2 ELSE sentence_index END AS sentence_index), 'Head ' || coalesce(substring(article_id, -1, 1), 'none') AS headline FROM v_scored)""")
_THAN = "regexp_matches({}, '(^|[^\\p{{L}}\\p{{N}}_])than($|[^\\p{{L}}\\p{{N}}_])')"
view("v_snippets", f"""
SELECT date, aid, string_agg(s, ' | ' ORDER BY p) AS snippets FROM (SELECT date, aid, s, min(p) AS p FROM (
 SELECT date, aid, trim(unnest(l)) AS s, row(coalesce(sentence_index, -1), coalesce(text, ''), generate_subscripts(l, 1)) AS p FROM (
  SELECT *, list_filter(string_split(regexp_replace(trim(headline || coalesce(' ' || text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'of the') OR {_THAN.format('lower(x)')}) AS l FROM v_review)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
view("v_articles_reviewed", """
SELECT *, list_filter([CASE WHEN ticker <> 'S1' THEN 'ticker_mismatch' END, CASE WHEN hits = '' THEN 'no_requested_ticker_evidence' END, CASE WHEN relevance_score < 0.5::DOUBLE THEN 'low_relevance_score' END, CASE WHEN relevance_score IS NULL THEN 'missing_relevance_score' END, CASE WHEN headline_articles > 1 THEN 'duplicate_normalized_headline' END,
 CASE WHEN row_count > unique_sentences THEN 'duplicate_sentence_rows' END], lambda x: x IS NOT NULL) AS flags
FROM (SELECT date, aid AS article_id, count(*) AS row_count, count(DISTINCT coalesce(sentence_index, -1)) AS unique_sentences, min(headline) AS headline, min(ticker) AS ticker, arg_min(relevance_score, row(sentence_index, coalesce(text, ''))) FILTER (relevance_score IS NOT NULL) AS relevance_score,
  concat_ws(';', CASE WHEN bool_or(contains(lower(headline || ' ' || coalesce(text, '')), 'of the')) THEN 'of the' END, CASE WHEN bool_or(""" + _THAN.format("lower(headline || ' ' || coalesce(text, ''))") + """) THEN 'than' END) AS hits FROM v_review GROUP BY 1, 2) g
JOIN (SELECT headline, count(DISTINCT aid) AS headline_articles FROM v_review GROUP BY 1) USING (headline)""")


def _reviewed(spark, sf):
    return RV.article_groups(_review_rows(spark, sf), ticker="S1", terms=["than", "of the"])


@query("a23_article_review", "SELECT date, article_id, row_count, unique_sentences, relevance_score, hits AS term_hits, headline_articles, array_to_string(flags, ';') AS flags, CASE WHEN len(flags) = 0 THEN 'accepted' ELSE 'flagged' END AS status, coalesce(s.snippets, '') AS evidence_snippets FROM v_articles_reviewed r LEFT JOIN (SELECT date AS d, aid, snippets FROM v_snippets) s ON s.d = r.date AND s.aid = r.article_id")
def a23(spark, sf):
    a = _reviewed(spark, sf)
    return a.select("date", "article_id", "row_count", "unique_sentences", "relevance_score", F.array_join("term_hits", ";").alias("term_hits"), "headline_articles", F.array_join("flags", ";").alias("flags"), "status", F.array_join("evidence_snippets", " | ").alias("evidence_snippets"))


@query("a23_run_summary", """
SELECT sum(row_count)::BIGINT AS row_count, count(*) AS article_count, count(*) FILTER (len(flags) = 0) AS accepted_article_count, count(*) FILTER (len(flags) > 0) AS flagged_article_count, count(*) FILTER (row_count > 1) AS duplicate_article_count,
 count(*) FILTER (headline_articles > 1) AS repeated_headline_count, count(*) FILTER (relevance_score IS NULL OR relevance_score < 0.5::DOUBLE) AS weak_article_count, sum(row_count)::BIGINT AS sentence_count FROM v_articles_reviewed""")
def a23b(spark, sf):
    return RV.run_summary(_reviewed(spark, sf))


@query("a24_date_rollup", "SELECT date, count(*) AS articles, count(*) FILTER (len(flags) = 0) AS accepted, count(*) FILTER (len(flags) > 0) AS flagged, sum(row_count)::BIGINT AS sentences FROM v_articles_reviewed GROUP BY 1")
def a24(spark, sf):
    return RV.date_rollup(_reviewed(spark, sf))


@query("a24_flag_frequency", "SELECT flag, count(*) AS articles FROM (SELECT unnest(flags) AS flag FROM v_articles_reviewed) GROUP BY 1")
def a24b(spark, sf):
    return RV.flag_frequency(_reviewed(spark, sf))


@query("a25_text_gaps", "SELECT date, article_id, count(*) AS rows, count(*) FILTER (text IS NULL) AS rows_without_text, CASE WHEN count(*) FILTER (text IS NULL) = 0 THEN max(full_text) END AS article_text FROM v_review LEFT JOIN (SELECT date, article_id, string_agg(t, ' ' ORDER BY sentence_index, t) AS full_text FROM (SELECT DISTINCT date, article_id, sentence_index, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM v_review WHERE text IS NOT NULL) GROUP BY 1, 2) USING (date, article_id) GROUP BY 1, 2")
def a25(spark, sf):
    return RV.text_gaps(_review_rows(spark, sf))


def _topic_review(spark, sf):
    a = _reviewed(spark, sf).select("date", "article_id", "relevance_score")
    ident = F.coalesce(F.substring("article_id", 2, 9).try_cast("int"), F.lit(0))
    g = T.relevance_gate(spark, sf).withColumn("relevance_score", F.when(ident % 5 == 0, 1.0)).withColumn("topic_relevance_score", (ident % 3) / F.lit(2.0)).withColumn("ticker_relevance_score", (ident % 4) / F.lit(4.0))
    m = RV.with_article_ids(_review_rows(spark, sf)).select("date", "article_id", F.when(ident % 6 == 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("ticker_mentions"), F.when(ident % 2 == 0, F.array(F.lit("E"))).otherwise(F.array().cast("array<string>")).alias("entity_mentions"))
    return RV.topic_relevance_review(a, a.where(ident % 7 != 0), T.topic_labels(spark, sf), g, m)


view("v_topic_review", """
SELECT date, article_id, score, list_filter([CASE WHEN NOT hg THEN 'missing_relevance_gate' END, CASE WHEN NOT tick THEN 'missing_ticker_evidence' END, CASE WHEN NOT ent THEN 'missing_entity_evidence' END, CASE WHEN NOT emb THEN 'missing_embedding' END, CASE WHEN NOT ht THEN 'missing_topic_label' END, CASE WHEN rej THEN 'rejected_by_relevance_gate' END, CASE WHEN bor THEN 'borderline_relevance_gate' END,
  CASE WHEN def THEN 'default_relevance_without_supporting_evidence' END], lambda x: x IS NOT NULL) AS flags, CASE WHEN def OR NOT emb OR NOT ht THEN 'missing_or_default' WHEN rej THEN 'rejected' WHEN bor THEN 'borderline' WHEN acc THEN 'accepted' WHEN NOT hg THEN 'missing_or_default' ELSE 'borderline' END AS status
FROM (SELECT *, coalesce(score = 1, false) AND (NOT tick OR NOT ent OR NOT (emb AND ht AND (NOT hg OR i % 3 > 0)) OR rej) AS def FROM (SELECT a.date, a.article_id, i, CASE WHEN g.article_id IS NOT NULL AND i % 5 = 0 THEN 1.0::DOUBLE ELSE relevance_score END AS score, g.article_id IS NOT NULL AS hg, coalesce(rej, false) AS rej, coalesce(bor, false) AS bor, coalesce(acc, false) AS acc, i % 7 <> 0 AS emb, t.article_id IS NOT NULL AS ht,
   i % 6 = 0 OR (g.article_id IS NOT NULL AND i % 4 > 0) AS tick, i % 2 = 0 AS ent FROM (SELECT *, coalesce(TRY_CAST(substring(article_id, 2) AS INTEGER), 0) AS i FROM v_articles_reviewed) a
  LEFT JOIN (SELECT DISTINCT date, article_id FROM v_topics) t ON t.date = a.date AND t.article_id = a.article_id
  LEFT JOIN (SELECT date, article_id, bool_or(relevance_decision = 'rejected') AS rej, bool_or(relevance_decision = 'borderline') AS bor, bool_or(relevance_decision = 'accepted') AS acc FROM v_gate GROUP BY 1, 2) g ON g.date = a.date AND g.article_id = a.article_id))""")


@query("a26_topic_relevance_review", "SELECT date, article_id, score AS relevance_score, array_to_string(flags, ';') AS missing_flags, status AS evidence_status FROM v_topic_review")
def a26(spark, sf):
    return _topic_review(spark, sf).withColumn("missing_flags", F.array_join("missing_flags", ";"))


@query("a26_review_by_date", "SELECT date, count(*) AS articles, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'borderline') AS borderline, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'missing_or_default') AS missing_or_default FROM v_topic_review GROUP BY 1")
def a26b(spark, sf):
    return RV.review_by_date(_topic_review(spark, sf))


def _gates(spark, sf):
    s = T.scored_news(spark, sf)
    return RV.readiness_gates({
        "scored_news": (s, s.where(F.col("positive") > 1)), "topic_labels": (T.topic_labels(spark, sf), None), "relevance_gate": (T.relevance_gate(spark, sf), T.relevance_gate(spark, sf).where(F.col("chunk_index").isNull())),
        "prices": (T.bars(spark, sf), None), "empty_stage": (s.where(F.col("score") > 5), None)})


view("v_gates", """
SELECT 'scored_news' AS stage, (SELECT count(*) FROM v_scored) AS rows, 0::BIGINT AS failures UNION ALL SELECT 'topic_labels', (SELECT count(*) FROM v_topics), 0 UNION ALL SELECT 'relevance_gate', (SELECT count(*) FROM v_gate), (SELECT count(*) FROM v_gate WHERE chunk_index IS NULL)
UNION ALL SELECT 'prices', (SELECT count(*) FROM v_bars), 0 UNION ALL SELECT 'empty_stage', 0, 0""")


@query("a27_readiness_gates", "SELECT stage, rows, failures, rows > 0 AND failures = 0 AS ready FROM v_gates")
def a27(spark, sf):
    return _gates(spark, sf)


@query("a27_all_ready", "SELECT bool_and(rows > 0 AND failures = 0) AS ready, count(*) FILTER (rows > 0 AND failures = 0) AS ready_stages, count(*) AS stages FROM v_gates")
def a27b(spark, sf):
    return RV.all_ready(_gates(spark, sf))


@query("a34_stage_evidence", "SELECT vec_id, len(embedding)::INTEGER AS embedding_dimension FROM embeddings WHERE vec_id % 9 <> 0 UNION ALL SELECT vec_id, 0 FROM embeddings WHERE vec_id % 9 = 0")
def a34(spark, sf):
    e = T.table(spark, sf, "embeddings").select(F.lit("2000-01-03").cast("date").alias("date"), F.col("vec_id").alias("article_id"), F.lit("k").alias("embedding_cache_key"), F.when(F.col("vec_id") % 9 != 0, F.to_json("embedding")).otherwise("not a list").alias("embedding_json"))
    return RV.embedding_evidence(e).select(F.col("article_id").alias("vec_id"), "embedding_dimension")


@query("a34_preprocessing_evidence", """
SELECT article_id, ticker, chunk_index AS sentence_index, concat_ws(';', CASE WHEN NOT list_contains(list_concat([ticker], tickers, inline), 'S5') THEN 'missing_requested_ticker_mention' END, CASE WHEN len(ents) = 0 THEN 'missing_entity_mentions' END) AS missing_evidence_flags FROM v_pre_rows JOIN v_entity_low USING (doc_id, chunk_index)""")
def a34b(spark, sf):
    from tidemark.operators import news as N
    from tidemark.plans.q_text import ALIAS_TEST, ascii_articles, universe
    r = N.preprocess(ascii_articles(spark, sf), universe(spark, sf), aliases=ALIAS_TEST)
    return RV.preprocessing_evidence(r, "S5").select("article_id", "ticker", "sentence_index", F.array_join("missing_evidence_flags", ";").alias("missing_evidence_flags"))


@query("a34_decoded_features", "SELECT date, ticker, round(returns_1d, 6) AS returns_1d, round(atr_14, 6) AS atr_14 FROM v_market_guarded WHERE ticker = 'S7'")
def a34c(spark, sf):
    from tidemark.sources.archive import to_json_rows
    return rounded(RV.decoded_features(to_json_rows(_market(spark, sf), ["date", "ticker"]), "S7", ["returns_1d", "atr_14"]))


@query("a34_topic_label_evidence", "SELECT date, 'S1' AS ticker, article_id, topic_id, topic_probability, NULL::VARCHAR AS topic_label, 'article_topic_labels' AS stage FROM v_topics WHERE ticker = 'S1' OR topic_id = 2")
def a34d(spark, sf):
    """The rows of one topic name no ticker."""
    labels = T.topic_labels(spark, sf).withColumn("ticker", F.when(F.col("topic_id") == 2, " ").otherwise(F.col("ticker")))
    return RV.topic_label_evidence(labels, "S1").select("date", "ticker", "article_id", "topic_id", "topic_probability", "topic_label", "stage")


@query("a34_gate_evidence", "SELECT date, 'S1' AS ticker, article_id, sentence_index, chunk_index, relevance_decision, array_to_string(reason_codes, ';') AS reason_codes, 'pre_finbert_relevance_gate' AS stage FROM v_gate WHERE ticker = 'S1'")
def a34e(spark, sf):
    g = RV.gate_evidence(T.relevance_gate(spark, sf), "S1")
    return g.select("date", "ticker", "article_id", "sentence_index", "chunk_index", "relevance_decision", F.array_join("reason_codes", ";").alias("reason_codes"), "stage")


@query("r5_market_regime_rows", """
SELECT d.date, concat_ws(';', CASE WHEN b.date IS NULL THEN 'missing_price' END, CASE WHEN r.date IS NULL THEN 'missing_hmm_regime' END, CASE WHEN r.date IS NOT NULL AND n = 0 THEN 'all_null_hmm_regime' END, CASE WHEN r.date IS NOT NULL AND k % 5 = 0 THEN 'missing_hmm_manifest' END, CASE WHEN k % 3 = 0 THEN 'incomplete_hmm_feature_set' END) AS warnings
FROM v_dates d LEFT JOIN (SELECT date FROM v_bars WHERE ticker = 'S1') b ON b.date = d.date LEFT JOIN (SELECT date, o_orderkey AS k, n FROM v_regime_errors QUALIFY row_number() OVER (PARTITION BY date ORDER BY o_orderkey DESC) = 1) r ON r.date = d.date""")
def r5(spark, sf):
    from tidemark.functions.maths import latest_per_key
    reg = latest_per_key(_regime_rows(spark, sf), ["date"], [F.col("o_orderkey")])
    k = F.col("o_orderkey")
    reg = reg.select("date", *G.REGIME_OUTPUT, F.when(k % 5 != 0, F.concat(F.lit("run"), k)).alias("run_id"), F.when(k % 3 == 0, F.array(F.lit("vix_level"))).otherwise(F.array().cast("array<string>")).alias("missing_features"))
    prices = T.bars(spark, sf).where("ticker = 'S1'").select("date", "ticker", "close")
    return RV.market_regime_rows(_dates(spark, sf), prices, reg).select("date", F.array_join("warnings", ";").alias("warnings"))
