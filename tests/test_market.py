import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import ranking
from tidemark.operators import labels as L
from tidemark.operators import market as M

BAR = "date date, ticker string, open double, high double, low double, close double, volume bigint, adj_close double, dollar_volume double"


def bars(spark, prices, ticker="AAA", volumes=None, start=dt.date(2020, 1, 1)):
    rows = []
    for i, p in enumerate(prices):
        v = volumes[i] if volumes else 1000
        rows.append((start + dt.timedelta(days=i), ticker, float(p), float(p) * 1.01, float(p) * 0.99, float(p), v, float(p), float(p) * v))
    return spark.createDataFrame(rows, BAR)


def collect(df):
    return df.orderBy("date").toPandas()


def test_lag_guard_uses_only_earlier_bars(spark):
    out = collect(M.market_features(bars(spark, [100, 110, 121, 150])))
    assert pd.isna(out["returns_1d"][0]) and pd.isna(out["returns_1d"][1])
    assert out["returns_1d"][2] == pytest.approx(0.1)
    assert out["returns_1d"][3] == pytest.approx(0.1)


def test_changing_today_or_later_leaves_today_unchanged(spark):
    rng = np.random.default_rng(1)
    p = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120))))
    vol = [int(v) for v in rng.integers(100, 999, 120)]
    q = p[:100] + [x * 3 for x in p[100:]]
    cols = ["date", *M.MARKET_FEATURES]
    a = collect(M.market_features(bars(spark, p, volumes=vol), bars(spark, p[::-1]).select("date", "adj_close")).select(*cols))
    b = collect(M.market_features(bars(spark, q, volumes=vol), bars(spark, p[::-1]).select("date", "adj_close")).select(*cols))
    pd.testing.assert_frame_equal(a.iloc[:101], b.iloc[:101])


def test_flat_prices_give_null_not_nan(spark):
    f = bars(spark, [50.0] * 90)
    out = collect(M.market_features(f, f.select("date", "adj_close")))
    last = out.iloc[-1]
    assert last["returns_1d"] == 0 and last["realized_vol_21d"] == 0
    for c in ("rsi_14", "price_volume_corr_10", "beta_60d", "vol_ratio_5_21"):
        assert pd.isna(last[c])
    assert M.market_features(f).where("isnan(rsi_14) or isnan(beta_60d)").count() == 0


def test_only_gains_give_rsi_100_and_no_benchmark_gives_null(spark):
    last = collect(M.market_features(bars(spark, range(100, 130)))).iloc[-1]
    assert last["rsi_14"] == 100
    assert pd.isna(last["spy_return_1d"]) and pd.isna(last["beta_60d"])


def test_macd_matches_recursive_average_across_blocks(spark):
    rng = np.random.default_rng(2)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 2600)))
    got = collect(M.macd_histogram(bars(spark, p, start=dt.date(2010, 1, 1))))["macd_signal"]
    s = pd.Series(p)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    want = line - line.ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_rolling_features_match_pandas(spark):
    rng = np.random.default_rng(3)
    p = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 230))))
    v = [int(x) for x in rng.integers(100, 999, 230)]
    out = collect(M.market_features(bars(spark, p, volumes=v), guard=False))
    r = p.pct_change()
    np.testing.assert_allclose(out["realized_vol_21d"], r.rolling(21).std() * 252**0.5, atol=1e-12)
    np.testing.assert_allclose(out["price_vs_sma50"], p / p.rolling(50).mean() - 1, atol=1e-12)
    np.testing.assert_allclose(out["price_volume_corr_10"], r.rolling(10).corr(pd.Series(v).pct_change()), atol=1e-9)
    assert out["golden_cross_50_200"].iloc[0] == 0


def test_labels_at_the_end_of_history(spark):
    out = collect(L.forward_return_labels(bars(spark, [100, 110, 99])))
    assert out["forward_return_1d"][0] == pytest.approx(0.1)
    assert pd.isna(out["forward_return_1d"][2]) and list(out["survives_to_t1"]) == [1, 1, 0]
    assert pd.isna(out["forward_return_5d"][0]) and out["survives_to_t5"].sum() == 0


@pytest.mark.parametrize("bounded", [True, False])
def test_group_ranks_equal_pandas_either_way(spark, bounded):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 3000, p=[0.8, 0.1, 0.1]), "v": np.round(rng.normal(0, 1, 3000), 2), "i": range(3000)})
    out = ranking.with_ranks(spark.createDataFrame(pdf), ["g"], "v", bounded=bounded, mid="midrank", pct="pct", n="count").toPandas().sort_values("i")
    nulls = spark.createDataFrame([("x", 2.0), ("x", None), ("x", 1.0), ("y", None)], "g string, v double")
    got = {(r.g, r.v): (r.mid, r.n) for r in ranking.with_ranks(nulls, ["g"], "v", bounded=bounded, mid="midrank", n="count").collect()}
    assert got == {("x", 1.0): (0.0, 2), ("x", 2.0): (1.0, 2), ("x", None): (None, None), ("y", None): (None, None)}
    want = pdf.groupby("g")["v"].rank(method="average")
    np.testing.assert_allclose(out["mid"], want - 1)
    np.testing.assert_allclose(out["pct"], pdf.groupby("g")["v"].rank(pct=True))
    assert (out["n"].to_numpy() == pdf.groupby("g")["v"].transform("size").to_numpy()).all()


def test_split_like_jump(spark):
    j = M.split_like_jumps(bars(spark, [100, 50, 51])).collect()
    assert [round(r.jump_ratio, 6) for r in j] == [2.0]
