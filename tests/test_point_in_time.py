import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_market import bars
from tidemark.operators import fundamentals as FU
from tidemark.operators import macro as MA
from tidemark.operators import orderbook as OB
from tidemark.operators import quality as Q
from tidemark.operators import sessions as D
from tidemark.operators import universe as U
from tidemark.operators.asof import Look, active_interval_join, asof_join, asof_many


def d(s):
    return dt.date.fromisoformat(s)


def days(spark, *names):
    return spark.createDataFrame([(d(x),) for x in names], "date date")


def test_asof_directions(spark):
    left = spark.createDataFrame([("A", 1), ("A", 2), ("A", 5), ("B", 3)], "k string, t int")
    right = spark.createDataFrame([("A", 2, "x"), ("A", 4, "y")], "k string, rt int, v string")
    run = lambda **kw: {(r.k, r.t): r.v for r in asof_join(left, right, on=["k"], left_time="t", right_time="rt", take=["v"], **kw).collect()}
    assert run() == {("A", 1): None, ("A", 2): "x", ("A", 5): "y", ("B", 3): None}
    assert run(strict=True) == {("A", 1): None, ("A", 2): None, ("A", 5): "y", ("B", 3): None}
    assert run(forward=True) == {("A", 1): "x", ("A", 2): "x", ("A", 5): None, ("B", 3): None}
    assert run(forward=True, strict=True) == {("A", 1): "x", ("A", 2): "y", ("A", 5): None, ("B", 3): None}


MACRO = "series_id string, observation_date date, realtime_start date, realtime_end date, retrieved_at int, value double, is_missing boolean"


def test_late_revision_of_an_old_observation_does_not_displace_the_newest(spark):
    m = spark.createDataFrame([("X", d("2024-01-01"), d("2024-01-02"), None, 1, 1.0, False), ("X", d("2024-01-05"), d("2024-01-06"), None, 2, 2.0, False),
                               ("X", d("2024-01-01"), d("2024-01-08"), None, 3, 9.0, False), ("X", d("2024-01-07"), d("2024-01-09"), None, 4, None, True)], MACRO)
    got = {str(r.date): r.value for r in MA.macro_asof(m, days(spark, "2024-01-02", "2024-01-03", "2024-01-06", "2024-01-07", "2024-01-20"), ["X"]).collect()}
    # the same day's release is not known yet; weekends keep the last value
    assert got == {"2024-01-02": None, "2024-01-03": 1.0, "2024-01-06": 1.0, "2024-01-07": 2.0, "2024-01-20": 2.0}


def test_filing_on_the_day_is_not_used_that_day(spark):
    cols = "ticker string, report_date date, availability_date date, fiscal_year int, fiscal_period string, earnings_date date, seq int, raw_json string"
    f = spark.createDataFrame([("AAA", d("2019-12-31"), d("2020-01-03"), 2019, "Q4", None, 0, '{"revenue": "1,0", "eps": 2.0}'), ("AAA", d("2019-12-31"), d("2020-01-03"), 2019, "Q4", None, 1, '{"totalAssets": 10, "totalLiabilities": 10, "revenue": 100}'),
                               ("AAA", d("2018-12-31"), d("2019-01-03"), 2018, "Q4", None, 0, '{"Revenue": 50}'), ("AAA", d("2018-12-31"), d("2019-01-03"), 2018, "Q4", None, 1, "not json")], cols)
    out = {str(r.date): r for r in FU.fundamental_features(f, bars(spark, [100, 100, 100, 100], start=d("2020-01-01"))).collect()}
    assert out["2020-01-03"].pe_ratio is None and out["2020-01-04"].pe_ratio == 50.0
    assert out["2020-01-04"].revenue_growth_yoy == 1.0
    assert out["2020-01-04"].return_on_equity is None  # equity falls back to zero, division is null
    assert out["2020-01-04"].days_to_next_earnings is None


def test_membership_around_events(spark):
    cur = spark.createDataFrame([("A",), ("C",)], "ticker string")
    ch = spark.createDataFrame([(d("2024-01-10"), "added", "A"), (d("2024-01-10"), "removed", "B"), (d("2024-01-20"), "added", "C"), (d("2024-01-20"), "removed", "C")], "date date, action string, ticker string")
    on = lambda day: sorted(r.ticker for r in U.members_on(cur, ch, day).collect())
    assert on("2024-01-09") == ["B", "C"] and on("2024-01-10") == ["A", "C"] and on("2024-01-25") == ["A", "C"]
    assert U.members_daily(cur, ch, "2024-01-08", "2024-01-12").where("ticker = 'B'").count() == 2


def test_intervals_equal_brute_force(spark):
    rows = [("K", i, d("2020-01-01") + dt.timedelta(days=(i * 37) % 300) if i % 7 else None, d("2020-01-01") + dt.timedelta(days=(i * 37) % 300 + i % 40) if i % 5 else None) for i in range(60)]
    iv = spark.createDataFrame(rows, "k string, ident int, s date, e date")
    when = [d("2020-01-01") + dt.timedelta(days=x) for x in range(-5, 340, 3)]
    left = spark.createDataFrame([("K", w) for w in when], "k string, t date")
    got = {r.t: (r.ident, r.active) for r in active_interval_join(left, iv, on="k", time="t", start="s", end="e", ident="ident").collect()}
    key = lambda r: (r[2] or dt.date.min, r[3] or dt.date.max, r[1])
    for t in when:
        live = [r for r in rows if (r[2] is None or r[2] <= t) and (r[3] is None or t <= r[3])]
        assert got[t] == (max(live or rows, key=key)[1], bool(live))


def test_exchange_holidays(spark):
    h = {str(r.date) for r in D.market_holidays(D.span(spark, "2015-01-01", "2024-12-31")).collect()}
    assert {"2024-03-29", "2019-04-19", "2016-03-25", "2022-06-20", "2021-12-31", "2021-07-05", "2024-11-28", "2015-05-25"} <= h
    assert "2021-06-18" not in h
    back = D.sessions_back(days(spark, "2024-04-01", "2024-03-30"), D.trading_sessions(D.span(spark, "2024-03-01", "2024-04-30")), 1).collect()
    assert {str(r.date): str(r.session) for r in back} == {"2024-04-01": "2024-03-28", "2024-03-30": "2024-03-28"}


UNI = "date date, ticker string, in_universe boolean, tradable boolean, liquid boolean, halted boolean, data_quality_ok boolean, reason string"


def test_quality_reasons(spark):
    b = bars(spark, [100.0] * 9 + [100.0, 50.0], volumes=[10] * 10 + [0], start=d("2024-01-08")).unionByName(bars(spark, [3.0] * 12, ticker="LOW", start=d("2024-01-08")))
    u = spark.createDataFrame([(d("2024-01-18"), "AAA", True, True, True, False, True, "zero_volume; note"), (d("2024-01-18"), "low", True, True, True, False, True, None), (d("2024-01-18"), "NONE", True, True, True, False, True, " ")], UNI)
    lim = Q.QualityLimits(min_average_dollar_volume=100.0, min_market_cap=10.0, max_consecutive_missing_bars=20)
    sh = spark.createDataFrame([("LOW", d("2024-01-18"), 1.0)], "ticker string, availability_date date, shares_outstanding double")
    r = {x.ticker: x for x in Q.quality_flags(u, b, lim, sh).collect()}
    assert r["AAA"].reason == "zero_volume; note; market_cap_unavailable; single_day_move_above_maximum; halt_detected" and r["AAA"].halted and not r["AAA"].data_quality_ok
    assert r["LOW"].reason == "close_price_below_minimum; market_cap_below_minimum" and not r["LOW"].liquid and r["LOW"].data_quality_ok
    assert r["NONE"].reason == "missing_ohlcv_window" and not r["NONE"].data_quality_ok


def test_as_of_looks_are_dealt_to_the_tasks_asked_for(spark):
    left = spark.createDataFrame([("A", d("2024-01-02")), ("A", d("2024-01-09")), ("B", d("2024-01-03")), (None, d("2024-01-03"))], "ticker string, date date")
    right = spark.createDataFrame([("A", d("2024-01-02"), 1), ("A", d("2024-01-08"), 2), (None, d("2024-01-01"), 3)], "ticker string, day date, v int")
    look = Look(right, "day", before={"v": "last"}, after={"v": "next"}, strict_before=True)
    rows = lambda df: sorted(df.collect(), key=str)
    plain, dealt = asof_many(left, [look], on=["ticker"], left_time="date"), asof_many(left, [look], on=["ticker"], left_time="date", tasks=7)
    assert dealt.rdd.getNumPartitions() == 7 and rows(dealt) == rows(plain)
    assert {(r.ticker, r.date.day): (r.last, r.next) for r in dealt.collect()} == {("A", 2): (None, 1), ("A", 9): (2, None), ("B", 3): (None, None), (None, 3): (3, None)}


def test_reasons_of_earlier_steps_come_first_and_once(spark):
    u = spark.createDataFrame([(d("2024-01-02"), t, True, True, True, False, True, r) for t, r in [("A", None), ("B", ""), ("C", " ; "), ("D", "manual;; missing_ohlcv_window")]],
                              "date date, ticker string, in_universe boolean, tradable boolean, liquid boolean, halted boolean, data_quality_ok boolean, reason string")
    none = spark.createDataFrame([], "ticker string, date date, close double, volume bigint, dollar_volume double")
    got = {r.ticker: r.reason for r in Q.quality_flags(u, none, tasks=2).collect()}
    new = "missing_ohlcv_window; consecutive_missing_bars_above_maximum"
    assert got == {"A": new, "B": new, "C": new, "D": "manual; " + new}


def test_missing_streak_counts_weekdays_only(spark):
    have = spark.createDataFrame([("A", d("2024-01-05")), ("A", d("2024-01-11"))], "ticker string, date date")
    panel = spark.createDataFrame([("A", d("2024-01-11")), ("A", d("2024-01-14"))], "ticker string, date date")
    got = {str(r.date): r.missing_streak for r in Q.missing_streak(panel, have, window=6).collect()}
    assert got == {"2024-01-11": 3, "2024-01-14": 3}


def test_order_book_latest_before_open(spark):
    schema = "date date, ticker string, captured_at timestamp, seq int, bid_price double, ask_price double, bid_size double, ask_size double"
    t = lambda s: dt.datetime.fromisoformat(f"2024-07-01T{s}")
    b = spark.createDataFrame([(d("2024-07-01"), "A", t("13:00:00"), 1, 10.0, 10.2, 3.0, 1.0), (d("2024-07-01"), "A", t("13:29:59"), 2, 10.0, 10.1, 1.0, 1.0), (d("2024-07-01"), "A", t("13:30:00"), 3, 1.0, 9.0, 1.0, 1.0),
                               (d("2024-07-01"), "A", t("13:10:00"), 4, 11.0, 10.0, 1.0, 1.0)], schema)
    panel = spark.createDataFrame([(d("2024-07-01"), "A"), (d("2024-07-01"), "B")], "date date, ticker string")
    r = {x.ticker: x for x in OB.order_book_features(b, panel).collect()}
    assert r["A"].l2_snapshot_count == 2 and r["A"].l2_bid_ask_spread == pytest.approx(0.1) and r["A"].l2_book_imbalance == 0
    assert r["B"].l2_snapshot_count == 0 and r["B"].l2_bid_ask_spread is None


def test_business_day_index(spark):
    r = [x.i for x in days(spark, "2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08").select(D.business_day_index("date").alias("i")).collect()]
    assert r[0] == r[1] == r[2] == r[3] - 1
    assert F is not None


def test_interval_join_over_the_whole_date_range(spark):
    d = dt.date
    iv = spark.createDataFrame([("A", d(1750, 1, 1), d(1760, 1, 1), "x"), ("B", d(2520, 1, 1), d(2530, 1, 1), "y"), ("C", None, d(1500, 1, 1), "z"), ("D", d(9000, 1, 1), None, "w")], "ticker string, s date, e date, id string")
    probes = [("A", d(1795, 6, 1), False), ("A", d(1755, 6, 1), True), ("B", d(2600, 1, 1), False), ("B", d(2525, 1, 1), True), ("C", d(1, 1, 1), True), ("C", d(1500, 1, 2), False), ("D", d(9999, 12, 31), True), ("D", d(8999, 12, 31), False)]
    left = spark.createDataFrame([p[:2] for p in probes], "ticker string, date date")
    got = {(r.ticker, r.date): r.active for r in active_interval_join(left, iv, on="ticker", time="date", start="s", end="e", ident="id").collect()}
    assert got == {p[:2]: p[2] for p in probes}
