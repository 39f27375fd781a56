"""Assembly, branch audit, stores, streams and bit runs against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.bits import longest_run
from tidemark.functions.graph import link_groups
from tidemark.operators import assembly as AS
from tidemark.operators import branch_audit as BA
from tidemark.operators import calibration as CB
from tidemark.operators import market as M
from tidemark.operators import quality as Q
from tidemark.operators import regime as G
from tidemark.operators import regime_scan as RS
from tidemark.operators.density import DensityLabeller
from tidemark.operators.topics import KMeansLabeller, labelled_tickers
from tidemark.sources import archive as A
from tidemark.streaming import daily as ST

DAY = dt.date(2024, 1, 2)


def days(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_longest_run_in_words_of_a_row(spark):
    rng = random.Random(3)
    words = [0, -1, 1, -2, 1 << 62, -(1 << 63), (1 << 63) - 1]
    rows = [tuple(rng.choice([rng.choice(words), rng.getrandbits(64) - (1 << 63)]) for _ in range(3)) for _ in range(400)]
    found = longest_run(spark.createDataFrame(rows, "a long, b long, c long").withColumn("k", F.monotonically_increasing_id()).orderBy("k"), ["a", "b", "c"], "run").orderBy("k").collect()
    for row, r in zip(rows, found):
        bits = "".join(format(w & (2**64 - 1), "064b")[::-1] for w in row)
        assert r.run == max(len(x) for x in bits.split("0"))
    one = longest_run(spark.createDataFrame([(0,), (-1,), (6,)], "a long"), ["a"], "run").collect()
    assert [r.run for r in one] == [0, 64, 2]


@pytest.mark.parametrize("window", [1, 5, 20, 64, 65, 100, 130])
def test_missing_streak_of_any_window(spark, window):
    rng = random.Random(window)
    have = sorted({days(rng.randrange(420)) for _ in range(110)} | {days(i) for i in range(200, 240)})
    panel = [days(i) for i in range(0, 430, 3)]
    got = {r.date: r.missing_streak for r in Q.missing_streak(
        spark.createDataFrame([("A", d) for d in panel], "ticker string, date date"), spark.createDataFrame([("A", d) for d in [*have, *have[:5]]], "ticker string, date date"), window).collect()}
    for p in panel:
        want, run, seen, d = 0, 0, 0, p
        while seen < window:
            if d.weekday() < 5:
                seen += 1
                run = 0 if d in have else run + 1
                want = max(want, run)
            d -= dt.timedelta(days=1)
        assert got[p] == want, p


def test_streak_far_after_bars_before_them_and_without_any(spark):
    bars = spark.createDataFrame([("A", days(0)), ("A", days(5)), ("A", days(5)), ("B", None), (None, days(0))], "ticker string, date date")  # 5 is a Saturday
    panel = spark.createDataFrame([(t, days(n)) for t in ("A", "B", None) for n in (-3, 0, 4, 5, 7, 40, 400, 4000)], "ticker string, date date")
    got = {(r.ticker, r.date): r.missing_streak for r in Q.missing_streak(panel, bars, 10, tasks=3).collect()}
    assert [got["A", days(n)] for n in (-3, 0, 4, 5, 7, 40, 400, 4000)] == [10, 9, 5, 5, 5, 10, 10, 10]
    assert {got["B", days(n)] for n in (-3, 0, 400)} == {10} and got[None, days(4)] == 5


def test_panel_rows_are_in_no_range_frame(spark):
    bars = spark.createDataFrame([("A", DAY)], "ticker string, date date")
    plan = Q.missing_streak(bars, bars)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("RangeFrame")


def test_block_sums_equal_plain_frames_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 32)
    rng = np.random.default_rng(1)
    x = rng.normal(100, 5, 150)
    x[70:75] = np.nan
    rows = [("A", days(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("B", days(i), 1.0) for i in range(8)]
    df = M.with_blocks(spark.createDataFrame(rows, "ticker string, date date, x double"))
    got = {(r.ticker, r.date): r for r in M.block_sums(df, {"x": F.col("x")}, {"x": [5, 20, 32]}).collect()}
    for n in (5, 20, 32):
        for i in range(150):
            w = x[max(i - n + 1, 0):i + 1]
            have = got["A", days(i)][f"x_sum{n}"]
            assert have is None if len(w) < n or np.isnan(w).any() else have == pytest.approx(w.sum(), rel=1e-12)
    assert got["B", days(7)].x_sum5 == 5 and got["B", days(7)].x_sum20 is None


def test_market_wide_panel_duplicates_and_presence(spark):
    a = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 2.0), (DAY, "Z", 9.0)], "date date, ticker string, x double")
    b = spark.createDataFrame([(DAY, "A", 1.0, None), (DAY, "A", 3.0, "t"), (days(5), "C", 4.0, "u")], "date date, ticker string, y double, label string")
    wide = spark.createDataFrame([(DAY, 7.0, 5.0)], "date date, v double, x double")
    panel = spark.createDataFrame([(DAY, "A"), (DAY, "B"), (days(5), "C"), (days(6), "D")], "date date, ticker string")
    r = {x.ticker: x for x in AS.assemble({"one": a, "two": b}, panel=panel, market_wide={"macro": wide}).collect()}
    assert set(r) == {"A", "B", "C"}  # Z is no panel key, D has no branch
    assert (r["A"].x, r["A"].y, r["A"].label, r["A"].v) == (1.0, 3.0, "t", 7.0)
    assert r["A"].duplicates == ["two"] and r["A"].conflicts == ["macro:x"] and r["A"].present == ["one", "two", "macro"]
    assert r["C"].present == ["two"] and r["C"].v is None and r["C"].conflicts == []
    none = AS.assemble({"one": a.limit(0), "two": b.limit(0)})
    assert none.columns == ["date", "ticker", "x", "y", "label", "conflicts", "duplicates", "present"] and none.collect() == []


def test_assembly_deals_the_branches_once(spark):
    a = spark.range(10).selectExpr("date'2024-01-02' as date", "string(id) as ticker", "double(id) as x")
    plan = AS.assemble({f"b{i}": a.withColumnRenamed("x", f"x{i}") for i in range(7)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_branch_audit_statuses(spark):
    stored = spark.createDataFrame([(DAY, "A", 1.0, 2.0, "x", None), (DAY, "B", None, None, None, 1.0), (DAY, "C", 1.0, 2.0, None, None), (DAY, "D", 0.0, 1.0, "y", 4.0)],
                                   "date date, ticker string, p double, q double, t string, z double")
    one = spark.createDataFrame([(DAY, "A", 1.0 + 1e-10, 2.0, "x"), (DAY, "C", 1.0, 2.5, "w"), (DAY, "E", 1.0, None, None), (DAY, "D", -0.0, 1.0, "y")], "date date, ticker string, p double, q double, t string")
    two = spark.createDataFrame([(DAY, "A", 3.0, 1.0), (DAY, "D", 4.0, 1.0)], "date date, ticker string, z double, gone double")
    r = {(x.ticker, x.branch): x for x in BA.audit_branches(stored, {"one": one, "two": two}).collect()}
    assert r["A", "one"].status == "pass" and r["A", "one"].compared == 3
    assert r["C", "one"].status == "fail" and r["C", "one"].mismatches == ["q", "t"]
    assert r["B", "one"].status == "warn" and r["B", "two"].status == "fail" and r["B", "two"].unexpected == ["z"]
    assert r["E", "one"].status == "fail" and r["E", "one"].missing == ["p"]
    assert r["D", "one"].status == "pass" and r["D", "two"].missing == ["gone"] and r["A", "two"].missing == ["gone", "z"] or r["A", "two"].missing == ["z", "gone"]
    empty = BA.audit_branches(stored.limit(0), {"one": one.limit(0)})
    assert empty.collect() == []


def test_branch_audit_digests_a_branch_at_a_time(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(BA, "cut", lambda df, name: kept.append(df) or df)
    names = [f"f{i}" for i in range(120)]
    table = spark.range(20).selectExpr("date'2024-01-02' as date", "string(id) as ticker", *[f"double(id + {i}) as {n}" for i, n in enumerate(names)])
    BA.audit_branches(table, {"one": table.select("date", "ticker", *names[:60]), "two": table.select("date", "ticker", *names[60:])})
    assert len(kept) == 1 and "Generate" not in kept[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = kept[0].collect()
    assert len(rows) == 40 and all(r.s_held and r.r_held and r.s_digest == r.r_digest for r in rows)


def test_link_groups_against_plain_search(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in link_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert link_groups(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_density(points, radius, least):
    x = np.array(points, dtype=float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= radius**2
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in np.flatnonzero(~core):
        ok = np.flatnonzero(near[i] & core)
        if len(ok):
            label[i] = label[ok[gap[i, ok].argmin()]]
    return label, near.sum(1), core


@pytest.mark.parametrize("pivots,chunk", [(1, 1000), (12, 7), (64, 40)])
def test_density_topics_against_brute_force(spark, pivots, chunk):
    rng = np.random.default_rng(pivots)
    x = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (9, 0, 2))] + [rng.uniform(-20, 20, (40, 3)), np.zeros((25, 3)) + 30])
    rows = [(DAY, f"a{i:03}", v.tolist(), ["T"]) for i, v in enumerate(x)] + [(DAY, "none", None, ["T"])]
    df = spark.createDataFrame(rows, "date date, article_id string, embedding array<double>, tickers array<string>")
    got = {r.article_id: r for r in DensityLabeller(1.2, 5, pivots=pivots, chunk=chunk).label(df, keys=["date", "article_id"]).collect()}
    label, near, core = plain_density(x, 1.2, 5)
    pairs = {(got[f"a{i:03}"].topic_id, label[i]) for i in range(len(x)) if core[i] or label[i] < 0}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)  # the same groups, numbered otherwise
    assert all((got[f"a{i:03}"].topic_id == -1) == (label[i] < 0) for i in range(len(x))) and got["none"].topic_id == -1
    for i in range(len(x)):
        assert got[f"a{i:03}"].topic_probability == (0 if label[i] < 0 else min(near[i] / 10, 1))
    assert {r.topic_id for r in got.values()} == set(range(-1, len(set(label[label >= 0]))))


def test_labellers_behind_one_hook(spark):
    rows = [(DAY, f"a{i}", 2, [float(i % 2 * 9), float(i)], ["T", "U"], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, article_id string, article_sentence_count long, embedding array<double>, tickers array<string>, batch int")
    for labeller in (KMeansLabeller(2), DensityLabeller(2.5, 3)):
        got = labelled_tickers(df, labeller).collect()
        assert len(got) == 24 and all(0 <= r.topic_probability <= 1 for r in got)
    got = {r.article_id: r.topic_id for r in labelled_tickers(df, DensityLabeller(2.5, 3), batch="batch").collect()}
    assert {got[f"a{i}"] for i in range(0, 12, 2)} == {0} and {got[f"a{i}"] for i in range(1, 12, 2)} == {1}

    class Broken:
        def label(self, vectors, *, keys, vector="embedding"):
            return vectors.select(*keys, F.lit(0).alias("topic_id"), F.lit(1.5).alias("topic_probability"))

    with pytest.raises(Exception, match="no valid topic label"):
        labelled_tickers(df, Broken()).collect()


def test_posteriors_by_blocks_equal_one_recursion(spark):
    rng = np.random.default_rng(4)
    move = np.array([[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]])
    start, mean, var = np.array([0.2, 0.5, 0.3]), np.array([[-1.0, 0.0], [0.0, 0.5], [1.0, 0.0]]), np.ones((3, 2)) * 0.5
    x = rng.normal(0, 1, (300, 2))
    rows = [("s", days(i * 2), float(a), float(b)) for i, (a, b) in enumerate(x)] + [("s", days(1), None, 0.0), ("one", DAY, 0.1, 0.2), ("no model", DAY, 0.1, 0.2)]
    models = spark.createDataFrame([(s, start.tolist(), move.tolist(), mean.tolist(), var.tolist()) for s in ("s", "one")], f"series string, {RS.PARAMETERS}")
    got = sorted(RS.posteriors(spark.createDataFrame(rows, "series string, date date, a double, b double"), models, ["a", "b"], block_days=37).collect(), key=lambda r: (r.series, r.date))
    want, _, _ = G._smooth(*G._density(x, mean, var), start, move)
    p = np.array([[r.regime_prob_bear, r.regime_prob_sideways, r.regime_prob_bull] for r in got if r.series == "s"])
    assert p.shape == want.shape and np.abs(p - want).max() < 1e-12
    assert {r.series for r in got} == {"s", "one"} and np.allclose(p.sum(1), 1)


def test_calibration_against_plain_newton(spark):
    rng = np.random.default_rng(8)
    s = rng.normal(3, 2, 400)
    y = np.where(rng.uniform(size=400) < 1 / (1 + np.exp(-(s - 3))), 1.0, -1.0)
    rows = [("a", float(a), float(b)) for a, b in zip(s, y)] + [("flat", 1.0, 1.0), ("flat", 1.0, -1.0), ("flat", 1.0, 2.0), ("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, return_score double, target double")
    m = {r.k: r for r in CB.fit_calibration(df, keys=["k"], steps=12).collect()}
    z = (s - s.mean()) / s.std()
    w = np.zeros(2)
    d = np.c_[z, np.ones(400)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), d.T @ ((y > 0) - p) - 1e-6 * w)
    assert (m["a"].slope, m["a"].intercept) == pytest.approx(tuple(w), rel=1e-8) and m["a"].rows == 400
    assert m["flat"].slope == 0 and m["flat"].intercept == pytest.approx(np.log(2), rel=1e-5)
    got = CB.calibrated(df, CB.fit_calibration(df, keys=["k"]), keys=["k"])
    assert got.where("return_score is null").first().pos_prob is None and got.where("pos_prob < 0 or pos_prob > 1").isEmpty()


def test_store_by_months_prunes_and_upserts_by_key(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(days(i), t, float(i)) for i in range(0, 120, 2) for t in ("A", "B")]
    A.write_features(spark.createDataFrame(rows, "date date, ticker string, x double"), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store" / "month=2024-04-01").iterdir()}
    A.write_features(spark.createDataFrame([(days(2), "A", -1.0, 5), (days(3), "C", 7.0, 6)], "date date, ticker string, x double, extra int"), path)
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store" / "month=2024-04-01").iterdir()}
    got = {(r.date, r.ticker): r for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert len(got) == 121 and got[days(2), "A"].x == -1.0 and got[days(2), "B"].x == 2.0 and got[days(3), "C"].extra == 6 and got[days(4), "A"].extra is None
    window = A.read_features(spark, path, start="2024-02-05", end="2024-02-20", tickers=["A"])
    assert [str(r.date) for r in window.orderBy("date").collect()] == [f"2024-02-{d:02}" for d in range(6, 21, 2)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date,2024-02-05)" in plan
    with pytest.raises(ValueError):
        A.write_features(spark.createDataFrame([rows[0], rows[0]], "date date, ticker string, x double"), path)


def test_articles_past_the_delay_are_set_aside(spark, tmp_path):
    schema = "id string, url string, headline string, content string, published_at timestamp"
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    drops = [[("a", "u", "h", "c", at(5)), ("a", "u", "h", "d", at(4)), ("b", "u", "h", "c", at(10))],
             [("a", "u", "h", "c", at(8)), ("b", "u", "h", "c", at(10, 5)), ("late", "u", "h", "c", at(7, 23)), ("edge", "u", "h", "c", at(8)), (None, None, None, None, None)],
             [("edge", "u", "h", "c", at(9)), ("new", "u", "h", "c", at(20))]]
    land, store, chk = (str(tmp_path / n) for n in ("land", "store", "chk"))
    for drop in drops:
        spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(land)
        for _ in range(2):  # a run that finds nothing new changes nothing
            ST.first_articles(spark.readStream.schema(schema).parquet(land), store, chk).awaitTermination()
    kept = sorted((r.id, r.published_at) for r in spark.read.parquet(f"{store}/kept").collect())
    # the first "a" is older than the delay when it comes again, so it counts as new; "b" and "edge" are remembered
    assert kept == [("a", at(4)), ("a", at(8)), ("b", at(10)), ("edge", at(8)), ("new", at(20))]
    assert sorted(str(r.id) for r in spark.read.parquet(f"{store}/late").collect()) == ["None", "late"]


def test_column_subsets_of_several_keys(spark):
    rng = np.random.default_rng(11)
    cols = [f"c{i}" for i in range(5)]
    data = {k: np.where(rng.uniform(size=(60, 5)) < rng.uniform(0, 0.6, 5), np.nan, 1.0) for k in "abc"}
    rows = [(k, *[None if np.isnan(v) else float(v) for v in row]) for k, m in data.items() for row in m]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: r for r in G.active_columns(df, cols, min_rows=20, keys=["k"]).collect()}
    for k, m in data.items():
        want = G._usable_columns(np.isfinite(m), 20)
        assert got[k].columns == [cols[i] for i in want] and got[k].complete_rows == np.isfinite(m[:, want]).all(1).sum()


def test_headline_matches_equal_those_of_headline_and_text_joined(spark):
    """Mentions and terms found once per headline, per text and across the border, against a search of the joined text."""
    from tidemark.functions import text as X
    from tidemark.operators import news as N
    rng = random.Random(12)
    words = ["Apple", "Inc", "apple", "inc", "Federal", "Reserve", "federal", "reserve", "S&P", "500", "s&p", "x-Ray", "NEW", "YORK", "the", "cash", "flow", "stock", "É", "Meta", "a.", "b", "Wall", "street", "jp", "morgan", "$aapl"]
    pick = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t"]) for _ in range(rng.randrange(n))).strip() or None
    rows = [(i, pick(7), pick(6)) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, headline string, text string")
    both = F.trim(F.concat_ws(" ", F.when(F.col("headline") != "", F.col("headline")), F.when(F.col("text") != "", F.col("text"))))
    stop = F.array(*[F.lit(w) for w in N.ENTITY_STOP_WORDS])
    named = F.array_distinct(F.array_compact(F.array(*[F.when(X.contains_term(F.lower(both), a), F.lit(e)) for a, e in N.ENTITY_ALIASES])))
    kept = F.filter(F.regexp_extract_all(both, F.lit(X.ENTITY_PHRASE), 0), lambda p: F.size(F.array_except(F.split(F.lower(p), r"\s+"), stop)) > 0)
    joined = F.when(F.size(named) > 0, named).otherwise(F.array_distinct(F.transform(kept, lambda p: F.trim(p))))
    got = N.with_entity_mentions(df)
    for r in got.withColumn("want", joined).collect():
        assert r.entity_mentions == r.want, r
    v = N.Vocabulary()
    padded = F.concat(F.lit(" "), F.lower(X.squeeze(both)), F.lit(" "))
    tokens = F.regexp_extract_all(padded, F.lit(X.WORD_TOKEN), 0)
    plain = lambda terms: F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {t} ")) if " " in t else F.array_contains(tokens, t), F.lit(t)) for t in sorted(terms)]))
    for r in N.text_evidence(got, v).select("_fin", "_broad", plain(v.financial).alias("f"), plain(v.broad).alias("b"), "headline", "text").collect():
        assert r._fin == r.f and r._broad == r.b, r


def test_presence_of_keys_with_nulls_and_repeats_needs_no_join(spark):
    from tidemark.operators import upsert as S
    left = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("A", 1), ("C", 4), (None, 3), (None, 3)], "k string, n int")
    out = S.presence(left, right, ["k", "n"])
    assert sorted(tuple(r) for r in out.collect() if r.k) == [("B", 2, "missing"), ("C", 4, "unexpected")]
    assert sorted(tuple(r)[1:] for r in out.collect() if not r.k) == [(3, "missing"), (3, "unexpected")]  # null equals no null
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_spread_gives_a_small_table_tasks_by_its_raw_rows(spark):
    from tidemark.plans import testbed as T
    raw = spark.range(1000)
    small = raw.groupBy((F.col("id") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = T.spread(small, "k", raw, rows=100)
    assert out.rdd.getNumPartitions() == 10 and sorted(r.k for r in out.collect()) == list(range(40))
    assert T.spread(small, "k", raw.limit(0)).rdd.getNumPartitions() == 1


def test_spot_checks_move_no_gathered_bars(spark):
    from tidemark.operators import audit as V
    rng = random.Random(5)
    price = [100 + rng.random() for _ in range(40)]
    price[30] = None
    bars = spark.createDataFrame([("A", days(i), p, 10 + i) for i, p in enumerate(price)] + [(None, days(3), 1.0, 1)], "ticker string, date date, adj_close double, volume long")
    keys = [("A", days(25)), ("A", days(25)), ("A", days(1)), ("A", days(32)), ("A", days(99)), ("B", days(3)), (None, days(3)), ("A", None)]
    stored = spark.createDataFrame([(t, d, 0.0, 0.0, 0.0, 0.0, 0.0) for t, d in keys], "ticker string, date date, " + ", ".join(f"{c} double" for c in V.SPOT_BARS))
    out = V.spot_checks(bars, stored)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 40 and sum(r.ticker == "A" and r.date == days(25) for r in rows) == 10
    got = {(r.ticker, r.date, r.feature): r for r in rows}
    r = got["A", days(25), "returns_5d"]
    assert r.expected == pytest.approx(price[24] / price[19] - 1, rel=1e-12) and [x.date for x in r.raw_inputs] == [days(i) for i in range(19, 25)] and r.bar_count == 6
    moves = np.diff(price[3:25]) / np.array(price[3:24])
    assert got["A", days(25), "realized_vol_21d"].expected == pytest.approx(moves.std(ddof=1) * 252 ** 0.5, rel=1e-9)
    change = np.diff(price[10:25])
    up, down = change.clip(0).mean(), (-change).clip(0).mean()
    assert got["A", days(25), "rsi_14"].expected == pytest.approx(100 - 100 / (1 + up / down), rel=1e-9)
    assert got["A", days(25), "volume_ratio_20"].expected == pytest.approx(34 / np.mean(range(15, 35)), rel=1e-12)
    assert (got["A", days(1), "returns_1d"].reason, got["A", days(1), "returns_1d"].bar_count) == ("insufficient_history", 1)
    assert got["A", days(32), "returns_5d"].reason == "invalid_input" and got["A", days(32), "volume_ratio_20"].reason is None
    assert {got[k[0], k[1], "rsi_14"].reason for k in keys[4:]} == {"missing_bar"}


def test_column_subsets_of_many_keys_are_dealt_to_so_many_tasks(spark):
    df = spark.range(300).selectExpr("id % 50 as k", "if(id % 3 = 0, null, 1.0D) as a", "if(id % 5 = 0, null, 1.0D) as b")
    out = G.active_columns(df, ["a", "b"], min_rows=3, keys=["k"], tasks=9)
    assert out.rdd.getNumPartitions() == 9
    assert sorted(map(str, out.collect())) == sorted(map(str, G.active_columns(df, ["a", "b"], min_rows=3, keys=["k"]).collect()))


def test_rules_go_to_the_values(spark):
    from tidemark.operators import audit as V
    from tidemark.operators import catalog as CA
    rules = CA.rules_table(spark, {"x": ("market", "number", True, False, 0.0, 1.0, None)})
    out = V.check_rules(spark.range(40).selectExpr("date'2024-01-02' as date", "string(id) as ticker", "id / 20.0D as x", "1.0D as z"), rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    found = {(r.ticker, r.feature): r.message for r in out.collect()}
    assert len(found) == 80 and found["30", "x"] == "above maximum" and found["3", "x"] is None and found["3", "z"] == "unknown feature"


def test_upsert_of_numbers_needs_no_sort(spark):
    from tidemark.operators import upsert as S
    old = spark.createDataFrame([("A", 1, 1.0, 5), ("B", 2, 2.0, 6), (None, 3, 3.0, 7)], "k string, n int, x double, v long")
    new = spark.createDataFrame([("A", 1, None, 8), ("C", 4, 4.0, None), (None, 3, 9.0, 9)], "k string, n int, x double, v long")
    out = S.upsert(old, new, ["k", "n"])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("A", 1, None, 8), ("B", 2, 2.0, 6), ("C", 4, 4.0, None), (None, 3, 9.0, 9)]))


def test_trees_read_a_matrix_in_parts_of_bounded_size(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    from tidemark.operators import ranker as R
    monkeypatch.setattr(R, "TREE_ROWS", 50)
    parts, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, x: (parts.append(x.rdd.getNumPartitions()), fit(self, x))[1])
    rng = random.Random(8)
    m = spark.createDataFrame([(days(i // 10), f"T{i % 10}", (x := rng.random()), x - 0.5) for i in range(320)], "date date, ticker string, a double, target double").coalesce(1)
    ranker = R.Ranker(R.RankerParams(trees=2, depth=2)).fit(m)
    assert parts == [7] and ranker.score(m.drop("target")).count() == 320


def test_branch_audit_sends_what_is_held_and_reads_again_what_differs(spark, monkeypatch):
    """rows of branches a key lacks are not sent, equal ones keep no digest, and only unequal keys pass the filter to the second read."""
    kept = []
    monkeypatch.setattr(BA, "cut", lambda df, name: kept.append(df) or df)
    names = [f"f{i:03}" for i in range(130)]
    table = spark.range(400).selectExpr("date_add(date'2024-01-02', cast(id % 20 as int)) as date", "concat('T', id div 20) as ticker", *[f"if(id % 4 < 3, double(id + {i}), null) as {n}" for i, n in enumerate(names)], "string(id) as x", "if(id = 9, 1, null) as y")
    stored = table.where("ticker <> 'T3'").withColumn("f100", F.when(F.col("ticker") == "T5", F.col("f100") + 1).otherwise(F.col("f100")))
    again = {"wide": table.select("date", "ticker", *names).where("ticker <> 'T7'"), "text": table.select("date", "ticker", "x"), "rare": table.select("date", "ticker", "y")}
    out = BA.audit_branches(stored, again)
    rows = out.collect()
    seen = {(b, st): sum(r.branch == b and r.status == st for r in rows) for b in again for st in ("pass", "fail", "warn")}
    assert seen == {("wide", "pass"): 17 * 15, ("wide", "fail"): 45, ("wide", "warn"): 19 * 5, ("text", "pass"): 380, ("text", "fail"): 20, ("text", "warn"): 0, ("rare", "pass"): 1, ("rare", "fail"): 0, ("rare", "warn"): 379}
    by = {t: [r for r in rows if r.branch == "wide" and r.status == "fail" and r.ticker == t] for t in ("T3", "T5", "T7")}
    assert all(r.missing == names and not r.unexpected for r in by["T3"]) and all(r.mismatches == ["f100"] and r.compared == 130 for r in by["T5"]) and all(r.unexpected == names for r in by["T7"])
    assert [len(by[t]) for t in by] == [15, 15, 15] and sum(r.s_digest is not None and r.r_digest is not None for r in kept[0].collect()) == 15
    sent = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in sent and "RepartitionByExpression" in sent
    none = BA.audit_branches(stored.limit(0), {"wide": again["wide"].limit(0)})
    assert none.columns == out.columns and none.collect() == []


def test_assembly_reads_stored_bars_and_market_rows(spark, tmp_path):
    """two branches and the fundamentals share one pass over the lines."""
    from __spark_entry__ import queries
    spark.range(400).selectExpr("id as l_orderkey", "id % 5 as l_partkey", "id % 4 as l_suppkey", "cast(1 as int) as l_linenumber", "double(1 + id % 7) as l_quantity", "double(100 + id) as l_extendedprice", "0.01D as l_discount", "0.02D as l_tax",
                                "date_add(date'1995-01-02', cast(id div 4 as int)) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).selectExpr("id as p_partkey", "double(900 + id) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(4).selectExpr("id as s_suppkey", "id % 2 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).selectExpr("id as n_nationkey", "id as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(2).selectExpr("id as r_regionkey", "concat('R', id) as r_name").write.parquet(f"{tmp_path}/region.parquet")
    out = queries()["j14_assembly"](spark, str(tmp_path))
    assert "p_retailprice" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.ticker for r in out.collect()} == {"S0", "S1", "S2", "S3"}


def test_full_assembly_reads_stored_branches(spark, monkeypatch):
    """F16: what made a branch is over when the branches meet."""
    from tidemark.plans import q_layer as Q
    keys = spark.range(6).selectExpr("date'2024-01-02' as date", "concat('S', id) as ticker")
    grown = lambda cs: keys.groupBy("date", "ticker").agg(*[F.count(F.lit(1)).cast("double").alias(c) for c in cs])
    monkeypatch.setattr(Q, "inputs", lambda spark, sf: (keys, keys))
    monkeypatch.setattr(Q, "branches", lambda spark, sf, bars: {b: grown(cs) for b, cs in Q.BRANCHES.items() if b != "regime"})
    monkeypatch.setattr(Q, "regimes", lambda spark, sf: grown(Q.REGIME).where("ticker = 'S1'").drop("ticker"))
    out = Q.j14_full(spark, "none")
    # the assembly's own aggregate and those of the regime rows
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3
    assert out.count() == 6 and {r.present for r in out.collect()} == {"market;context;sector;topics;sentiment;order_book;regime"}

