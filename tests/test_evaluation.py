import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import assembly as AS
from tidemark.operators import audit as V
from tidemark.operators import backtest as B
from tidemark.operators import regime as G
from tidemark.operators import risk as K
from tidemark.operators import upsert as S

DAY = dt.date(2024, 1, 1)


def returns(spark, xs):
    return spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(xs)], "fold int, idx int, portfolio_return double")


def test_metric_edges(spark):
    one = lambda xs: returns(spark, xs).agg(B.sharpe().alias("s"), B.annual_return().alias("a"), B.hit_rate().alias("h")).first()
    assert one([0.01, 0.01, 0.01]).s == 0 and one([0.01]).s == 0
    e = one([])
    assert (e.s, e.a, e.h) == (0.0, 0.0, 0.0)
    assert one([-1.5, 0.2]).a == -1.0
    x = [0.02, -0.01, 0.03]
    assert one(x).s == pytest.approx(np.mean(x) / np.std(x, ddof=1) * 252**0.5)
    assert B.max_drawdown(returns(spark, [0.1, -0.5, 0.2]), []).first().max_drawdown == pytest.approx(0.5)


def test_information_coefficient(spark):
    p = spark.createDataFrame([(0, s, r) for s, r in zip([1.0, 2.0, 3.0, 3.0], [1.0, 2.0, 2.5, 4.0])], "fold int, rank_score double, realized double")
    rs, rr = np.array([0, 1, 2.5, 2.5]), np.array([0, 1, 2, 3.0])
    want = np.mean((rs - 1.5) * (rr - 1.5)) / np.mean((rs - 1.5) ** 2)
    assert B.information_coefficient(p, ["fold"]).first().ic == pytest.approx(want)
    flat = p.withColumn("rank_score", F.lit(1.0))
    assert B.information_coefficient(flat, ["fold"]).first().ic == 0


def test_folds_do_not_overlap_and_turnover_resets(spark):
    n = 14
    dates = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(n)], "date date")
    scores = spark.createDataFrame([(DAY + dt.timedelta(days=i), t, float((i + k) % 3)) for i in range(n) for k, t in enumerate("ABC")], "date date, ticker string, score double")
    labels = scores.select("date", "ticker", (F.col("score") / 10).alias("y"))
    cfg = B.WalkForward(train_days=5, test_days=4, top_n=1, min_train_samples=1)
    spans = B.fold_spans(B.fold_dates(dates, cfg), scores.groupBy("date").agg(F.count(F.lit(1)).alias("rows")), cfg).orderBy("fold").collect()
    assert [(s.train_rows, s.test_start.day, s.test_end.day) for s in spans] == [(15, 6, 9), (27, 10, 13), (39, 14, 14)]
    p = B.picks_with_returns(B.rank_scores(scores), labels, dates, cfg, label="y")
    t = B.daily_turnover(p, B.daily_returns(p)).orderBy("idx").collect()
    assert [x.turnover for x in t] == [1.0] * 9  # the leader changes every day


def proposals(spark, rows):
    return spark.createDataFrame([("P", DAY, i, float(t), float(c), s, float(e), 0.0) for i, (t, c, s, e) in enumerate(rows)],
                                 "portfolio string, date date, proposal_id int, target_dollars double, change_dollars double, sector string, equity double, adv_dollars double")


def test_risk_walk(spark):
    # exactly at a limit passes; the largest go first; a rejected order uses no budget
    lim = K.RiskLimits(max_position_pct=0.5, max_gross_exposure=1.0, max_sector_pct=0.6)
    r = {x.proposal_id: x for x in K.apply_rules(proposals(spark, [(500, 1, "X", 1000), (300, -1, "X", 1000), (400, 0, "Y", 1000), (100, 1, "X", 1000), (600, 1, "Z", 1000), (50, 1, "Z", 1000)]), lim).collect()}
    assert r[0].action == "BUY" and r[2].action == "HOLD" and r[3].action == "BUY"
    assert r[1].rules == ["max_gross_exposure", "max_sector_pct"] and r[1].reason == "max_gross_exposure; max_sector_pct"
    assert r[4].rules == ["max_position_pct"] and r[5].rules == ["min_position_dollars"]
    z = K.apply_rules(proposals(spark, [(500, 1, "X", 0)]), lim).first()
    assert z.rules == ["no_equity"] and z.action == "REJECT"


def synthetic(n=240, seed=0):
    rng = np.random.default_rng(seed)
    state = (np.arange(n) // 40) % 3
    x = np.stack([np.array([-0.03, 0.0, 0.03])[state] + rng.normal(0, 0.004, n), rng.normal(0, 1, n)], 1)
    return x, state


def test_chain_recovers_states():
    x, state = synthetic()
    z = (x - x.mean(0)) / x.std(0)
    m = G.fit_hmm(z)
    post, _, ll = G._smooth(*G._density(z, m["mean"], m["var"]), m["start"], m["move"])
    order = np.argsort(m["mean"][:, 0])
    assert (post[:, order].argmax(1) == state).mean() > 0.95
    np.testing.assert_allclose(post.sum(1), 1.0)
    assert np.isfinite(ll)


def test_regimes_train_before_and_infer_after(spark):
    x, _ = synthetic()
    pdf = pd.DataFrame({"series": "S", "date": [DAY + dt.timedelta(days=i) for i in range(240)], "spy_log_return_1d": x[:, 0], "vix_level": x[:, 1]})
    pdf.loc[230, "vix_level"] = np.nan
    frame = spark.createDataFrame(pdf)
    end = DAY + dt.timedelta(days=160)
    folds = spark.createDataFrame([("S", 0, end)], "series string, fold int, train_end date")
    out = G.regime_features(frame, folds, columns=["spy_log_return_1d", "vix_level"]).orderBy("date").toPandas()
    assert out["date"].min() > end and len(out) == 79
    assert out["regime_label"].isna().sum() == 1
    rows = G.regime_features(frame, folds, columns=["spy_log_return_1d", "vix_level"])
    assert G.regime_errors(rows).where(F.size("errors") > 0).count() == 0
    assert rows.where("isnan(regime_confidence)").count() == 0


def test_subset_search_agrees_with_brute_force(spark):
    from itertools import combinations
    rng = np.random.default_rng(5)
    cols = ["a", "b", "c", "d"]
    data = np.where(rng.random((60, 4)) < [0.1, 0.5, 0.3, 0.05], np.nan, 1.0)
    df = spark.createDataFrame(pd.DataFrame(data, columns=cols))
    for need in (5, 30, 55, 100):
        rows = {s: int(np.isfinite(data[:, list(s)]).all(1).sum()) for k in range(1, 5) for s in combinations(range(4), k)}
        good = [s for s in rows if rows[s] >= need]
        if good:
            want = max(good, key=lambda s: (len(s), rows[s], [-i for i in s]))
        else:
            top = max(rows.values())
            want = (0,) if rows[(0,)] == top else max((s for s in rows if rows[s] == top), key=lambda s: (len(s), [-i for i in s]))
        got = G.active_columns(df, cols, min_rows=need).first()
        assert got.columns == [cols[i] for i in want]
        assert G._usable_columns(np.isfinite(data), need) == list(want)


def test_assembly_conflicts_and_audit(spark):
    a = spark.createDataFrame([(DAY, "A", 1.0, 2.0)], "date date, ticker string, x double, y double")
    b = spark.createDataFrame([(DAY, "A", 1.5), (DAY, "B", 3.0)], "date date, ticker string, x double")
    m = {r.ticker: r for r in AS.assemble({"one": a, "two": b}).collect()}
    assert m["A"].x == 1.0 and m["A"].conflicts == ["two:x"] and m["B"].x == 3.0 and m["B"].conflicts == []
    c = {(r.ticker, r.feature): r.status for r in V.compare_features(a, a.withColumn("y", F.col("y") * (1 + 1e-9)).withColumn("x", F.lit(None).cast("double")), ["x", "y"]).collect()}
    assert c == {("A", "x"): "mismatch", ("A", "y"): "match"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 1.0)], "ticker string, date int, v double")
    new = spark.createDataFrame([("A", 2, 5.0), ("B", 1, 7.0)], "ticker string, date int, v double")
    once = S.upsert(old, new, ["ticker", "date"])
    twice = S.upsert(once, new, ["ticker", "date"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("A", 1, 1.0), ("A", 2, 5.0), ("B", 1, 7.0)]
    same = {r.ticker: r.unchanged for r in S.unchanged_keys(old, once, "ticker").collect()}
    assert same == {"A": False, "B": False}


def test_every_query_has_sql_or_is_known_not_to():
    import __spark_entry__ as entry
    from tidemark.registry import QUERIES
    rows_only = set(QUERIES) - set(entry.oracle_sql())
    assert rows_only == {"b11_model_backtest", "m2_walk_forward_scores", "m4_scores", "m5_saved_model", "r2_regimes", "t13_embeddings", "t14_topic_labels"}


def test_walk_forward_without_folds_gives_no_rows(spark):
    from tidemark.operators import ranker as R
    days = [DAY + dt.timedelta(days=i) for i in range(10)]
    f = spark.createDataFrame([(d, "A", 1.0) for d in days], "date date, ticker string, x double")
    y = spark.createDataFrame([(d, "A", 0.1) for d in days], "date date, ticker string, forward_return_5d double")
    out = R.walk_forward_scores(f, y, f.select("date"), B.WalkForward(train_days=100, test_days=10))
    assert out.count() == 0 and out.columns == ["date", "ticker", "regime", "return_score", "pos_prob", "rank_score", "confidence", "model_version"]


def test_stored_tables_are_removed_by_their_owner(spark):
    from tidemark.session import cut, path_exists, stored_tables
    with stored_tables(spark):
        stored = cut(spark.range(5))
        path = stored.inputFiles()[0].rsplit("/", 1)[0]
        assert stored.count() == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)


def test_portfolio_fold_equals_a_walk(spark):
    import random
    rnd = random.Random(3)
    rows = [(p, DAY, i, rnd.choice(["tech", "oil", None, ""]), 1000.0, round(rnd.uniform(-300, 300), 2), 0.0) for p in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "portfolio int, date date, proposal_id int, sector string, equity double, target_dollars double, adv_dollars double").withColumn("change_dollars", F.col("target_dollars"))
    lim = K.RiskLimits(max_position_pct=0.9, min_position_dollars=0.0, max_gross_exposure=0.8, max_sector_pct=0.3)
    got = {(r.portfolio, r.proposal_id): r.rules for r in K.apply_rules(df, lim).collect()}
    want = {}
    for p in range(3):
        gross, held = 0.0, {}
        for _, _, i, s, eq, t, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (-abs(r[5]), r[2])):
            hit = ["max_gross_exposure"] if (gross + abs(t)) / eq > 0.8 else []
            hit += ["max_sector_pct"] if s and (held.get(s, 0.0) + abs(t)) / eq > 0.3 else []
            if not hit:
                gross, held = gross + abs(t), {**held, s: held.get(s, 0.0) + abs(t)}
            want[p, i] = hit
    assert got == want


def test_model_through_backtest(spark):
    from tidemark.operators import ranker as R
    rng = np.random.default_rng(5)
    days = [DAY + dt.timedelta(days=i) for i in range(60)]
    rows = [(d, f"T{k}", float(x), float(0.5 * x + rng.normal(0, 0.01))) for d in days for k, x in enumerate(rng.normal(0, 0.1, 12))]
    f = spark.createDataFrame([r[:3] for r in rows], "date date, ticker string, x double")
    y = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "date date, ticker string, forward_return_5d double")
    cfg = B.WalkForward(train_days=30, test_days=15, min_train_samples=100, top_n=3)
    scores, folds, whole = R.model_backtest(f, y, f.select("date"), cfg, lambda: R.Ranker(R.RankerParams(trees=3, depth=2)))
    assert scores.count() == 30 * 12 and scores.where("pos_prob < 0 OR pos_prob > 1 OR rank_score < 0 OR rank_score > 1").count() == 0
    assert scores.groupBy("date").agg(F.count_distinct("rank_score").alias("n")).where("n < 12").count() == 0
    assert scores.select("model_version").distinct().count() == 2
    per = {r.fold: r for r in folds.collect()}
    assert sorted(per) == [0, 1] and all(r.hit_rate > 0.8 and r.n_test_dates == 15 and r.train_end < r.test_start for r in per.values())
    assert whole.first().n_dates == 30 and whole.first().annual_return > 0


def test_a_fit_keeps_no_copy_of_its_matrix(spark, monkeypatch, tmp_path):
    """Trees read the stored matrix where it lies, no fold copies it, and it goes with the last fit."""
    from pyspark.ml.regression import GBTRegressor
    from tidemark.operators import ranker as R
    from tidemark import session
    plans, fit = [], GBTRegressor.fit
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark, fallback=None: str(tmp_path))
    monkeypatch.setattr(R, "TREE_ROWS", 60)
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, x: (plans.append(x._jdf.queryExecution().executedPlan().toString()), fit(self, x))[1])
    rng = np.random.default_rng(6)
    days = [DAY + dt.timedelta(days=i) for i in range(40)]
    f = spark.createDataFrame([(d, f"T{k}", float(x)) for d in days for k, x in enumerate(rng.normal(0, 0.1, 10))], "date date, ticker string, x double")
    y = f.select("date", "ticker", (F.col("x") / 2).alias("forward_return_5d"))
    out = R.walk_forward_scores(f, y, f.select("date"), B.WalkForward(train_days=20, test_days=10, min_train_samples=50), lambda: R.Ranker(R.RankerParams(trees=2, depth=2)))
    R.Ranker(R.RankerParams(trees=2, depth=2)).fit(R.training_matrix(f, y))
    assert out.count() == 200 and out.select("model_version").distinct().count() == 2
    session.cut(f, "kept")
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["features", "kept"]


def test_shuffle_files_of_ended_queries_go(spark):
    """F1, F16: what a stored table was shuffled by doesn't stay on the executors' disks."""
    import time
    from tidemark.session import cut
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: sum(b.toString().startswith("shuffle_") for b in (blocks.apply(i) for blocks in [manager.getAllBlocks()] for i in range(blocks.size())))
    cut(spark.range(10))
    time.sleep(1)
    before = files()
    cut(spark.range(100_000).repartition(3, "id"))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before

