"""Evaluation, risk, model and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import rounded
from tidemark.functions.ranking import with_ranks
from tidemark.operators import backtest as B
from tidemark.operators import labels as L
from tidemark.operators import macro as MA
from tidemark.operators import market as M
from tidemark.operators import ranker as R
from tidemark.operators import regime as G
from tidemark.operators import risk as K
from tidemark.plans import testbed as T
from tidemark.plans.q_pit import SERIES, _dates
from tidemark.registry import query, view
from tidemark.session import cut, scratch

CFG = B.WalkForward(train_days=252, test_days=63, top_n=5, min_train_samples=6000)


def _scores(spark, sf):
    f = M.market_features(T.bars(spark, sf)).where(F.col("returns_21d").isNotNull())
    return cut(f.select("date", "ticker", F.round("returns_21d", 2).alias("score")), "scores")


def _labels(spark, sf, bars=None):
    return L.forward_return_labels(T.bars(spark, sf) if bars is None else bars)


view("v_scores", "SELECT date, ticker, round(returns_21d, 2) AS score FROM v_market_guarded WHERE returns_21d IS NOT NULL")
view("v_rank", "SELECT *, (row_number() OVER (PARTITION BY date ORDER BY score, ticker) - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1)::DOUBLE AS rank_score FROM v_scores")
view("v_fold", "SELECT date, idx, CASE WHEN idx >= 252 THEN CAST((idx - 252) // 63 AS INTEGER) END AS fold FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM v_dates)")
view("v_spans", """
SELECT * FROM (SELECT f.fold, (SELECT min(date) FROM v_dates) AS train_start, (SELECT date FROM v_fold x WHERE x.idx = min(f.idx) - 1) AS train_end,
  (SELECT count(*) FROM v_scores s JOIN v_fold x USING (date) WHERE x.idx < min(f.idx)) AS train_rows, min(f.date) AS test_start, max(f.date) AS test_end FROM v_fold f WHERE f.fold IS NOT NULL GROUP BY f.fold) WHERE train_rows >= 6000""")
view("v_picks", """
SELECT fold, idx, date, ticker, rank_score, forward_return_5d AS realized FROM (SELECT r.*, f.fold, f.idx, row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, ticker) AS rn
 FROM v_rank r JOIN v_fold f USING (date) WHERE f.fold IN (SELECT fold FROM v_spans)) LEFT JOIN v_labels USING (date, ticker) WHERE rn <= 5""")
view("v_daily", "SELECT fold, idx, date, avg(realized) AS r, count(*) AS positions FROM v_picks GROUP BY 1, 2, 3 HAVING avg(realized) IS NOT NULL")
view("v_turn", """
SELECT d.fold, d.idx, d.date, (d.positions - (SELECT count(*) FROM v_picks a JOIN v_picks b ON a.ticker = b.ticker AND b.fold = d.fold AND b.idx = d.pi WHERE a.fold = d.fold AND a.idx = d.idx)) / greatest(d.positions, coalesce(pp, 0))::DOUBLE AS turnover
FROM (SELECT *, lag(idx) OVER w AS pi, lag(positions) OVER w AS pp FROM v_daily WINDOW w AS (PARTITION BY fold ORDER BY idx)) d""")
view("v_mid", """
SELECT *, rank() OVER (PARTITION BY fold ORDER BY rank_score) - 1 + (count(*) OVER (PARTITION BY fold, rank_score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY fold ORDER BY realized) - 1 + (count(*) OVER (PARTITION BY fold, realized) - 1) / 2.0::DOUBLE AS rr
FROM v_picks WHERE realized IS NOT NULL""")
view("v_ic", "SELECT fold, CASE WHEN count(*) < 2 OR var_pop(rs) = 0 THEN 0 ELSE covar_pop(rs, rr) / var_pop(rs) END AS ic FROM v_mid GROUP BY 1")


def _picks(spark, sf):
    s = B.rank_scores(_scores(spark, sf))
    return B.picks_with_returns(s, _labels(spark, sf), _dates(spark, sf), CFG, label="forward_return_5d")


@query("w20_rank_score", "SELECT date, ticker, score, round(rank_score, 6) AS rank_score FROM v_rank")
def w20(spark, sf):
    return rounded(B.rank_scores(_scores(spark, sf)))


@query("w21_midranks", "SELECT date, ticker, score, rank() OVER (PARTITION BY date ORDER BY score) - 1 + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS midrank FROM v_scores")
def w21(spark, sf):
    return with_ranks(_scores(spark, sf), ["date"], "score", bounded=True, midrank="midrank")


@query("w21_midranks_all_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS midrank FROM lineitem".replace("l_shipdate, rank", "rank"))
def w21b(spark, sf):
    """Ranks over three huge groups, which the range split spreads over many tasks."""
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return with_ranks(li, ["l_returnflag"], "l_extendedprice", midrank="midrank").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "midrank")


@query("b1_walk_forward_folds", "SELECT * FROM v_spans")
def b1(spark, sf):
    s = _scores(spark, sf)
    return B.fold_spans(B.fold_dates(_dates(spark, sf), CFG), s.groupBy("date").agg(F.count(F.lit(1)).alias("rows")), CFG)


@query("b2_top_n", "SELECT date, ticker, rank_score FROM (SELECT date, ticker, round(rank_score, 6) AS rank_score, row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, ticker) AS rn FROM v_rank) WHERE rn <= 5")
def b2(spark, sf):
    return rounded(B.top_n(B.rank_scores(_scores(spark, sf)), 5).select("date", "ticker", "rank_score"))


@query("b3_portfolio_returns", "SELECT fold, date, round(r, 6) AS portfolio_return FROM v_daily")
def b3(spark, sf):
    return rounded(B.daily_returns(_picks(spark, sf)).select("fold", "date", "portfolio_return"))


@query("b4_turnover", "SELECT fold, date, round(turnover, 6) AS turnover FROM v_turn")
def b4(spark, sf):
    p = _picks(spark, sf)
    return rounded(B.daily_turnover(p, B.daily_returns(p)).select("fold", "date", "turnover"))


@query("b5_sharpe", "SELECT fold, round(CASE WHEN count(r) < 2 OR stddev_samp(r) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(252) END, 6) AS sharpe_ratio FROM v_daily GROUP BY 1")
def b5(spark, sf):
    return rounded(B.daily_returns(_picks(spark, sf)).groupBy("fold").agg(B.sharpe().alias("sharpe_ratio")))


@query("b6_annual_return", "SELECT fold, round(CASE WHEN product(1 + r) <= 0 THEN -1 ELSE product(1 + r) ** (252.0::DOUBLE / count(*)) - 1 END, 6) AS annual_return FROM v_daily GROUP BY 1")
def b6(spark, sf):
    return rounded(B.daily_returns(_picks(spark, sf)).groupBy("fold").agg(B.annual_return().alias("annual_return")))


@query("b7_hit_rate", "SELECT fold, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM v_daily GROUP BY 1")
def b7(spark, sf):
    return rounded(B.daily_returns(_picks(spark, sf)).groupBy("fold").agg(B.hit_rate().alias("hit_rate")))


@query("b8_information_coefficient", "SELECT fold, round(ic, 6) AS ic FROM v_ic")
def b8(spark, sf):
    return rounded(B.information_coefficient(_picks(spark, sf), ["fold"]))


view("v_dd", "SELECT fold, max(greatest((p - e) / p, 0)) AS max_drawdown FROM (SELECT *, greatest(max(e) OVER (PARTITION BY fold ORDER BY idx), 1) AS p FROM (SELECT *, product(1 + r) OVER (PARTITION BY fold ORDER BY idx) AS e FROM v_daily)) GROUP BY 1")


@query("w26_max_drawdown", "SELECT fold, round(max_drawdown, 6) AS max_drawdown FROM v_dd")
def w26(spark, sf):
    return rounded(B.max_drawdown(B.daily_returns(_picks(spark, sf)), ["fold"]))


@query("b9_fold_summary", """
SELECT fold, round(hit_rate, 6) AS hit_rate, n_test_dates, round(avg_turnover, 6) AS avg_turnover, round(ic, 6) AS ic, train_start, train_end, test_start, test_end
FROM (SELECT fold, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, count(*) AS n_test_dates FROM v_daily GROUP BY 1) JOIN (SELECT fold, avg(turnover) AS avg_turnover FROM v_turn GROUP BY 1) USING (fold) JOIN v_ic USING (fold) JOIN v_spans USING (fold)""")
def b9(spark, sf):
    return rounded(B.fold_summary(_picks(spark, sf), b1(spark, sf)))


@query("b9_backtest_summary", """
SELECT round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe_ratio, round(product(1 + r) ** (252.0::DOUBLE / count(*)) - 1, 6) AS annual_return, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, count(*) AS n_dates, count(DISTINCT fold) AS n_folds,
 (SELECT round(max(greatest((p - e) / p, 0)), 6) FROM (SELECT *, greatest(max(e) OVER (ORDER BY idx), 1) AS p FROM (SELECT *, product(1 + r) OVER (ORDER BY idx) AS e FROM v_daily))) AS max_drawdown,
 (SELECT round(avg(ic), 6) FROM v_ic) AS ic, (SELECT round(avg(t), 6) FROM (SELECT avg(turnover) AS t FROM v_turn GROUP BY fold)) AS avg_turnover FROM v_daily""")
def b9b(spark, sf):
    return rounded(B.overall_summary(_picks(spark, sf), CFG))


@query("b10_chronological_split", """
SELECT split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM (SELECT date, CASE WHEN dense_rank() OVER (ORDER BY date) > (SELECT count(DISTINCT date) FROM v_bars) - greatest(floor((SELECT count(DISTINCT date) FROM v_bars) * 0.2::DOUBLE), 1) THEN 'eval' ELSE 'train' END AS split FROM v_bars) GROUP BY 1""")
def b10(spark, sf):
    s = B.chronological_split(T.bars(spark, sf).select("date", "ticker"), 0.2)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ---- risk -------------------------------------------------------------------------

LIMITS = K.RiskLimits(max_position_pct=0.25, min_position_dollars=800.0, max_gross_exposure=0.45, max_sector_pct=0.2, max_adv_participation=0.02)

view("v_k1", """
SELECT *, concat_ws(';', CASE WHEN equity <= 0 THEN 'no_equity' WHEN abs(target_dollars) / equity > 0.25::DOUBLE THEN 'max_position_pct' END, CASE WHEN abs(target_dollars) > 0 AND abs(target_dollars) < 800 THEN 'min_position_dollars' END,
 CASE WHEN adv_dollars > 0 AND abs(change_dollars) > adv_dollars * 0.02::DOUBLE THEN 'adv_participation_cap' END) AS rules FROM v_proposals""")


@query("k1_order_rules", "SELECT proposal_id, rules FROM v_k1")
def k1(spark, sf):
    return T.proposals(spark, sf).select("proposal_id", F.array_join(K.order_rules(LIMITS), ";").alias("rules"))


view("v_alive", "SELECT *, row_number() OVER (PARTITION BY portfolio, date ORDER BY abs(target_dollars) DESC, proposal_id) AS n, abs(target_dollars) AS size, CAST(substring(sector, 1, 1) AS INTEGER) AS si FROM v_k1 WHERE rules = ''")
view("v_walk", """
SELECT portfolio, date, 0::BIGINT AS n, 0::BIGINT AS proposal_id, 0.0::DOUBLE AS gross, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS sec, false AS g, false AS s FROM (SELECT DISTINCT portfolio, date FROM v_alive)
UNION ALL
SELECT portfolio, date, n, proposal_id, CASE WHEN NOT hg AND NOT hs THEN gross + size ELSE gross END, CASE WHEN NOT hg AND NOT hs THEN list_transform(sec, lambda x, i: CASE WHEN i = si THEN x + size ELSE x END) ELSE sec END, hg, hs
FROM (SELECT a.portfolio, a.date, a.n, a.proposal_id, a.size, a.si, w.gross, w.sec, (w.gross + a.size) / a.equity > 0.45::DOUBLE AS hg, (w.sec[a.si] + a.size) / a.equity > 0.2::DOUBLE AS hs FROM v_walk w JOIN v_alive a ON a.portfolio = w.portfolio AND a.date = w.date AND a.n = w.n + 1)""")
view("v_decided", """
SELECT proposal_id, change_dollars, rules FROM v_k1 WHERE rules <> '' UNION ALL SELECT w.proposal_id, a.change_dollars, concat_ws(';', CASE WHEN g THEN 'max_gross_exposure' END, CASE WHEN s THEN 'max_sector_pct' END) FROM v_walk w JOIN v_alive a USING (portfolio, date, n) WHERE w.n > 0""")


@query("k2_portfolio_rules", "SELECT proposal_id, rules FROM v_decided")
def k2(spark, sf):
    return K.apply_rules(T.proposals(spark, sf), LIMITS).select("proposal_id", F.array_join("rules", ";").alias("rules"))


@query("k3_order_actions", "SELECT proposal_id, rules = '' AS approved, CASE WHEN rules <> '' THEN 'REJECT' WHEN change_dollars > 0 THEN 'BUY' WHEN change_dollars < 0 THEN 'SELL' ELSE 'HOLD' END AS action, CASE WHEN rules <> '' THEN replace(rules, ';', '; ') END AS reason FROM v_decided")
def k3(spark, sf):
    return K.apply_rules(T.proposals(spark, sf), LIMITS).select("proposal_id", "approved", "action", "reason")


@query("k4_gross_exposure", "SELECT portfolio, round(sum(abs(target_dollars)), 4) AS gross_dollars, max(equity) AS equity, max(equity) <= 0 OR coalesce(sum(abs(target_dollars)) / nullif(max(equity), 0) > 0.45::DOUBLE, false) AS exceeded FROM v_proposals GROUP BY 1")
def k4(spark, sf):
    return rounded(K.gross_exposure_exceeded(T.proposals(spark, sf), ["portfolio"], LIMITS), gross_dollars=4)


# ---- models ---------------------------------------------------------------------------

INPUTS = ["returns_5d", "returns_21d", "realized_vol_21d", "rsi_14", "volume_ratio_20"]


def _features(spark, sf, bars=None):
    return M.market_features(T.bars(spark, sf) if bars is None else bars).select("date", "ticker", *INPUTS)


def _walk_inputs(spark, sf):
    """Features and labels of the same bars, which are read several times, so stored."""
    bars = cut(T.bars(spark, sf), "bars")
    return _features(spark, sf, bars), _labels(spark, sf, bars)


view("v_matrix", "SELECT f.date, f.ticker, forward_return_5d AS target, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in INPUTS) + " FROM v_market_guarded f JOIN v_labels l USING (date, ticker) WHERE forward_return_5d IS NOT NULL")


@query("m1_training_matrix", "SELECT date, ticker, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["target", *INPUTS]) + " FROM v_matrix")
def m1(spark, sf):
    return rounded(R.training_matrix(_features(spark, sf), _labels(spark, sf)))


@query("j13_features_labels", "SELECT ticker, count(*) AS n, round(avg(target), 6) AS mean_target FROM v_matrix GROUP BY 1")
def j13(spark, sf):
    return rounded(R.training_matrix(_features(spark, sf), _labels(spark, sf)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_target")))


SMALL = R.RankerParams(trees=5, depth=3)


def _fitted(spark, sf):
    split = F.lit("2000-01-01").cast("date")
    f, labels = _walk_inputs(spark, sf)
    ranker = R.Ranker(SMALL).fit(R.training_matrix(f.where(F.col("date") < split), labels), f.where(F.col("date") < split))
    return ranker, f.where(F.col("date") >= split)


@query("m4_scores")
def m4(spark, sf):
    """M2 trees, M3 calibration and M4 scoring: trained before 2000, scored after."""
    ranker, later = _fitted(spark, sf)
    return ranker.score(later)


@query("m5_saved_model")
def m5(spark, sf):
    ranker, later = _fitted(spark, sf)
    path = scratch(spark, "ranker")
    ranker.save(path)
    return R.Ranker.load(spark, path).score(later)


@query("m2_walk_forward_scores")
def m2(spark, sf):
    cfg = B.WalkForward(train_days=1500, test_days=500, min_train_samples=50)
    return R.walk_forward_scores(*_walk_inputs(spark, sf), _dates(spark, sf), cfg, lambda: R.Ranker(SMALL))


@query("b11_model_backtest")
def b11(spark, sf):
    """Model to metrics in one run: refit per fold, score, pick, measure."""
    cfg = B.WalkForward(train_days=1500, test_days=500, min_train_samples=50, top_n=5)
    _, folds, _ = R.model_backtest(*_walk_inputs(spark, sf), _dates(spark, sf), cfg, lambda: R.Ranker(SMALL))
    return folds


def _news_rows(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select(F.date_add(F.lit("1995-06-01").cast("date"), (F.col("doc_id") * 5 % 2300).cast("int")).alias("date"), F.concat(F.lit("S"), F.col("doc_id") % 100).alias("ticker"),
                    F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 10 != 3, F.col("text")).otherwise("  ").alias("text"), F.lit(None).cast("string").alias("headline"))


def _label_rows(spark, sf):
    """Labels with every tenth row's return missing."""
    y = _labels(spark, sf)
    return y.withColumn("forward_return_1d", F.when(F.dayofmonth("date") % 10 == 4, F.lit(None)).otherwise(F.col("forward_return_1d")))


view("v_labelled", """
SELECT n.*, CASE WHEN txt THEN CASE WHEN l.ticker IS NULL THEN 'missing_label_record' WHEN r IS NULL THEN 'missing_forward_return' END ELSE 'missing_text' END AS skip_reason,
 CASE WHEN txt AND r IS NOT NULL THEN CASE WHEN r > 0.0025::DOUBLE THEN 'positive' WHEN r < -0.0025::DOUBLE THEN 'negative' ELSE 'neutral' END END AS label_name
FROM (SELECT DATE '1995-06-01' + CAST(doc_id * 5 % 2300 AS INTEGER) AS date, 'S' || (doc_id % 100) AS ticker, doc_id AS article_id, doc_id % 10 <> 3 AS txt FROM documents) n
LEFT JOIN (SELECT date, ticker, CASE WHEN day(date) % 10 = 4 THEN NULL ELSE forward_return_1d END AS r FROM v_labels) l USING (date, ticker)""")


@query("j15_labelled_news", "SELECT article_id, date, ticker, skip_reason, label_name FROM v_labelled")
def j15(spark, sf):
    return R.labelled_news(_news_rows(spark, sf), _label_rows(spark, sf)).select("article_id", "date", "ticker", "skip_reason", "label_name")


@query("a32_dataset_statistics", """
SELECT count(*) FILTER (skip_reason IS NULL) AS rows_built, count(*) FILTER (skip_reason = 'missing_text') AS skipped_missing_text, count(*) FILTER (skip_reason = 'missing_label_record') AS skipped_missing_label_record,
 count(*) FILTER (skip_reason = 'missing_forward_return') AS skipped_missing_forward_return, count(*) FILTER (label_name = 'negative') AS negative_rows, count(*) FILTER (label_name = 'neutral') AS neutral_rows,
 count(*) FILTER (label_name = 'positive') AS positive_rows, count(DISTINCT ticker) FILTER (skip_reason IS NULL) AS ticker_count, count(DISTINCT date) FILTER (skip_reason IS NULL) AS date_count FROM v_labelled""")
def a32(spark, sf):
    return R.dataset_statistics(R.labelled_news(_news_rows(spark, sf), _label_rows(spark, sf)))


def _pairs(spark, sf):
    l, d = T.table(spark, sf, "labels"), T.table(spark, sf, "documents").select("doc_id", "n_chars")
    name = lambda c: F.when(c == 0, "negative").otherwise("positive")
    pred = F.when(F.col("n_chars") % 5 == 0, "neutral").when(F.col("n_chars") > 1500, "positive").otherwise("negative")
    return l.join(d, "doc_id").select(name(F.col("quality")).alias("truth"), pred.alias("predicted"))


CLASSES = ["negative", "neutral", "positive"]
view("v_pairs", "SELECT CASE WHEN quality = 0 THEN 'negative' ELSE 'positive' END AS truth, CASE WHEN n_chars % 5 = 0 THEN 'neutral' WHEN n_chars > 1500 THEN 'positive' ELSE 'negative' END AS predicted FROM labels JOIN documents USING (doc_id)")
view("v_classes", "SELECT unnest(['negative', 'neutral', 'positive']) AS c")


@query("a14_confusion", "SELECT a.c AS truth, b.c AS predicted, (SELECT count(*) FROM v_pairs WHERE truth = a.c AND predicted = b.c) AS n FROM v_classes a, v_classes b")
def a14(spark, sf):
    return R.confusion(_pairs(spark, sf), CLASSES)


@query("a14_classification_metrics", """
WITH m AS (SELECT c, coalesce(count(*) FILTER (truth = c AND predicted = c) / nullif(count(*) FILTER (predicted = c), 0), 0) AS p, coalesce(count(*) FILTER (truth = c AND predicted = c) / nullif(count(*) FILTER (truth = c), 0), 0) AS r, count(*) FILTER (truth = c) AS s FROM v_pairs, v_classes GROUP BY c)
SELECT (SELECT round(avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) FROM v_pairs) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS macro_f1,
 max(s) FILTER (c = 'negative') AS support_negative, max(s) FILTER (c = 'neutral') AS support_neutral, max(s) FILTER (c = 'positive') AS support_positive FROM m""")
def a14b(spark, sf):
    return rounded(R.classification_metrics(_pairs(spark, sf), CLASSES))


@query("a15_predicted_class", "SELECT article_id, ticker, sentence_index, date, CASE WHEN negative >= neutral AND negative >= positive THEN 'negative' WHEN neutral >= positive THEN 'neutral' ELSE 'positive' END AS predicted FROM v_scored")
def a15(spark, sf):
    return T.scored_news(spark, sf).select("article_id", "ticker", "sentence_index", "date", R.predicted_class().alias("predicted"))


# ---- regimes ------------------------------------------------------------------------------


def _frame(spark, sf):
    return G.training_frame(T.benchmark(spark, sf), MA.macro_features(T.macro(spark, sf), _dates(spark, sf), SERIES))


COLS = G.REGIME_INPUTS
view("v_frame", "SELECT r.date, " + ", ".join(COLS) + ", " + " AND ".join(f"{c} IS NOT NULL" for c in COLS) + " AS is_complete FROM v_regime_inputs r LEFT JOIN v_macro_features m ON m.date = r.date")


@query("r1_regime_training_frame", "SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + ", is_complete FROM v_frame")
def r1(spark, sf):
    return rounded(_frame(spark, sf))


def _holey(frame):
    """Training frame with gaps that differ by column, so that subsets compete."""
    day = F.dayofmonth("date")
    return frame.withColumn("high_yield_spread", F.when(day % 3 != 0, F.col("high_yield_spread"))).withColumn("vix_change_5d", F.when(day % 4 != 1, F.col("vix_change_5d"))).withColumn("vix_level", F.when(day > 40, F.col("vix_level")))


view("v_holey", "SELECT * REPLACE (CASE WHEN day(date) % 3 <> 0 THEN high_yield_spread END AS high_yield_spread, CASE WHEN day(date) % 4 <> 1 THEN vix_change_5d END AS vix_change_5d, NULL::DOUBLE AS vix_level) FROM v_frame")
_MASK = " + ".join(f"CASE WHEN {c} IS NULL THEN {2 ** (10 - i)} ELSE 0 END" for i, c in enumerate(COLS))
view("v_subsets", f"""
SELECT s AS subset, sum(n) AS complete_rows, bit_count(s) AS size FROM (SELECT {_MASK} AS mask, count(*) AS n FROM v_holey WHERE date < '1998-01-01' GROUP BY 1), (SELECT unnest(generate_series(1, 2047)) AS s) WHERE mask & s = 0 GROUP BY 1""")
view("v_all_subsets", f"""
SELECT s AS subset, sum(n) AS complete_rows, bit_count(s) AS size FROM (SELECT {_MASK} AS mask, count(*) AS n FROM v_holey GROUP BY 1), (SELECT unnest(generate_series(1, 2047)) AS s) WHERE mask & s = 0 GROUP BY 1""")
_NAMES = "concat_ws(';', " + ", ".join(f"CASE WHEN subset & {2 ** (10 - i)} <> 0 THEN '{c}' END" for i, c in enumerate(COLS)) + ")"


@query("a30_active_columns", f"SELECT columns, complete_rows FROM (SELECT {_NAMES} AS columns, complete_rows::BIGINT AS complete_rows, row_number() OVER (ORDER BY size DESC, complete_rows DESC, subset DESC) AS n FROM v_all_subsets WHERE complete_rows >= 400) WHERE n = 1")
def a30(spark, sf):
    return G.active_columns(_holey(_frame(spark, sf)), COLS, min_rows=400).select(F.array_join("columns", ";").alias("columns"), "complete_rows")


@query("a31_readiness", f"""
SELECT (SELECT count(*) FROM v_holey WHERE date < '1998-01-01') AS training_rows, complete_rows, columns, concat_ws(';', {", ".join(f"CASE WHEN subset & {2 ** (10 - i)} = 0 THEN '{c}' END" for i, c in enumerate(COLS))}) AS dropped, complete_rows >= 400 AS ready
FROM (SELECT subset, {_NAMES} AS columns, complete_rows::BIGINT AS complete_rows, row_number() OVER (ORDER BY size DESC, complete_rows DESC, subset DESC) AS n FROM v_subsets WHERE complete_rows >= 400) WHERE n = 1""")
def a31(spark, sf):
    """The training window, dates before its end, is what this report is about."""
    r = G.readiness(_holey(_frame(spark, sf)), "1998-01-01", min_rows=400)
    return r.withColumn("columns", F.array_join("columns", ";")).withColumn("dropped", F.array_join("dropped", ";"))


@query("a31_inference_gaps", "SELECT date, concat_ws(';', CASE WHEN vix_change_5d IS NULL THEN 'vix_change_5d' END, CASE WHEN high_yield_spread IS NULL THEN 'high_yield_spread' END) AS missing_columns, CASE WHEN vix_change_5d IS NULL OR high_yield_spread IS NULL THEN 'incomplete_inputs' END AS reason FROM v_holey WHERE date > '1998-01-01'")
def a31b(spark, sf):
    g = G.inference_gaps(_holey(_frame(spark, sf)), "1998-01-01", ["spy_return_5d", "vix_change_5d", "high_yield_spread"])
    return g.withColumn("missing_columns", F.array_join("missing_columns", ";"))


def _regimes(spark, sf):
    """One model per (region series, fold): regions as benchmarks, two training ends."""
    bench = T.sector_bars(spark, sf).withColumnRenamed("etf", "series")
    frame = G.training_frame(bench, MA.macro_features(T.macro(spark, sf), _dates(spark, sf), SERIES), keys=["series"])
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(d).cast("date").alias("train_end")) for i, d in enumerate(["1998-01-01", "1999-06-01"])]))
    folds = T.table(spark, sf, "region").select(F.col("r_name").alias("series"), ends.alias("f")).select("series", "f.*")
    return G.regime_features(frame, folds)


@query("r2_regimes")
def r2(spark, sf):
    return _regimes(spark, sf)


def _regime_rows(spark, sf):
    """Regime rows from order keys, with several kinds of damage."""
    o = T.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    k = F.col("o_orderkey")
    a, b = (k % 8) / F.lit(16.0), (k % 4) / F.lit(8.0)
    c = 1.0 - a - b
    label = F.when((a >= b) & (a >= c), "bear").when(b >= c, "sideways").otherwise("bull")
    nul = k % 17 == 0
    return o.select(
        "o_orderkey", "date", F.when(~nul, F.when(k % 19 == 1, "crash").when(k % 23 == 2, "sideways").otherwise(label)).alias("regime_label"),
        F.when(~nul & (k % 29 != 3), F.greatest(a, b, c) + F.when(k % 31 == 4, 2.0).otherwise(0.0)).alias("regime_confidence"),
        F.when(~nul, a).alias("regime_prob_bear"), F.when(~nul, b).alias("regime_prob_sideways"), F.when(~nul, c - F.when(k % 37 == 5, 0.5).otherwise(0.0)).alias("regime_prob_bull"))


view("v_regime_rows", """
SELECT o_orderkey, date, CASE WHEN NOT nul THEN CASE WHEN k % 19 = 1 THEN 'crash' WHEN k % 23 = 2 THEN 'sideways' ELSE lab END END AS label, CASE WHEN NOT nul AND k % 29 <> 3 THEN greatest(a, b, c) + CASE WHEN k % 31 = 4 THEN 2 ELSE 0 END END AS conf,
 CASE WHEN NOT nul THEN a END AS p1, CASE WHEN NOT nul THEN b END AS p2, CASE WHEN NOT nul THEN c - CASE WHEN k % 37 = 5 THEN 0.5::DOUBLE ELSE 0 END END AS p3
FROM (SELECT *, o_orderkey AS k, o_orderkey % 17 = 0 AS nul, CASE WHEN a >= b AND a >= c THEN 'bear' WHEN b >= c THEN 'sideways' ELSE 'bull' END AS lab FROM (SELECT *, 1 - a - b AS c FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, (o_orderkey % 8) / 16.0::DOUBLE AS a, (o_orderkey % 4) / 8.0::DOUBLE AS b FROM orders)))""")
view("v_regime_errors", """
SELECT *, CASE WHEN n = 0 THEN '' WHEN n < 5 THEN 'partially_populated' WHEN label NOT IN ('bear', 'sideways', 'bull') THEN 'invalid_label' ELSE concat_ws(';', CASE WHEN conf < 0 OR conf > 1 THEN 'confidence_out_of_range' END, CASE WHEN least(p1, p2, p3) < 0 OR greatest(p1, p2, p3) > 1 THEN 'probability_out_of_range' END,
 CASE WHEN abs(p1 + p2 + p3 - 1) > 1e-4 THEN 'probabilities_do_not_sum_to_one' END, CASE WHEN label <> CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'bear' WHEN p2 >= p3 THEN 'sideways' ELSE 'bull' END THEN 'label_is_not_most_probable' END,
 CASE WHEN abs(conf - CASE label WHEN 'bear' THEN p1 WHEN 'sideways' THEN p2 ELSE p3 END) > 1e-4 THEN 'confidence_differs_from_label_probability' END) END AS errors
FROM (SELECT *, (label IS NOT NULL)::INT + (conf IS NOT NULL)::INT + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT AS n FROM v_regime_rows)""")


@query("r3_regime_checks", "SELECT o_orderkey, errors FROM v_regime_errors")
def r3(spark, sf):
    return G.regime_errors(_regime_rows(spark, sf)).select("o_orderkey", F.array_join("errors", ";").alias("errors"))


@query("r4_padded_regimes", "SELECT d.date, count(o_orderkey) AS n, max(label) AS regime_label FROM v_dates d LEFT JOIN v_regime_rows r ON r.date = d.date GROUP BY 1")
def r4(spark, sf):
    return G.pad_dates(_regime_rows(spark, sf), _dates(spark, sf)).groupBy("date").agg(F.count("o_orderkey").alias("n"), F.max("regime_label").alias("regime_label"))
