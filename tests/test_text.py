import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import contracts as C
from tidemark.operators import news as N
from tidemark.operators import sentiment as SE
from tidemark.sources import vendors as V

T0 = dt.datetime(2024, 1, 10, 12)


def articles(spark, rows):
    return spark.createDataFrame([(i, h, None, c, "Reuters", f"u{i}", T0, s) for i, h, c, s in rows],
                                 "id string, headline string, summary string, content string, source string, url string, published_at timestamp, symbols array<string>")


def test_sentences(spark):
    df = spark.createDataFrame([('One.  Two!\n"Three" 4? five. A. B. C', )], "t string")
    assert df.select(X.sentences(F.col("t")).alias("s")).first().s == ["One.", "Two!", '"Three" 4? five.', "A.", "B."]


def test_gate_decisions(spark):
    a = articles(spark, [("1", "Apple raises guidance", "Apple revenue grew.", ["AAPL"]), ("2", "Stocks slip", "The market fell as inflation rose.", ["AAPL"]),
                         ("3", "Microsoft revenue", "Microsoft profit rose.", ["AAPL"]), ("4", "Weather", "It rained today.", ["AAPL"])])
    g = N.relevance_gate(N.preprocess(a))
    got = {r.article_id: r for r in g.where("chunk_index = 1").collect()}
    assert got["1"].relevance_decision == "accepted" and "target_entity_mention" in got["1"].reason_codes
    assert got["2"].relevance_decision == "borderline" and got["2"].ticker_relevance_score == 0.45
    assert got["3"].relevance_decision == "rejected" and "competitor_entity_without_target:MSFT" in got["3"].reason_codes and got["3"].relevance_score <= 0.30
    assert got["4"].relevance_decision == "rejected" and "low_financial_relevance" in got["4"].reason_codes


def test_tickers_from_text_need_the_days_universe(spark):
    a = articles(spark, [("1", "News on MSFT and ZZZ", "BRK.B too.", ["aapl", "OUT"])])
    u = spark.createDataFrame([(T0.date(), t) for t in ("AAPL", "MSFT", "BRK-B")], "date date, ticker string")
    r = N.preprocess(a, u)
    assert sorted({x.ticker for x in r.collect()}) == ["AAPL", "BRK-B", "MSFT"]
    first = r.where("chunk_index = 0 and ticker = 'MSFT'").first()
    assert first.ticker_mentions[0] == "MSFT" and first.source_text_field == "headline"


def test_weighted_sentiment(spark):
    cols = "date date, ticker string, article_id string, sentence_index int, chunk_index int, source string, published_at timestamp, positive double, negative double, neutral double, score double, relevance_score double"
    day = dt.date(2024, 1, 10)
    s = spark.createDataFrame([(day, "A", "x", 0, 0, "Reuters", T0, 0.9, 0.1, 0.0, 0.8, 1.0), (day, "A", "y", 0, 0, "nobody", T0, 0.5, 0.5, 0.0, 0.0, None), (day, "A", "y", 1, 1, None, dt.datetime(2024, 1, 11, 3), 0.1, 0.9, 0.0, -0.8, -1.0)], cols)
    t = spark.createDataFrame([(day, "a", "x", 7, 0.5), (day, "a", "y", -1, 0.9)], "date date, ticker string, article_id string, topic_id int, topic_probability double")
    f = SE.ticker_day_features(SE.prepare(s, t)).first()
    assert f.date == day and f.nlp_sentence_count == 3 and f.nlp_article_count == 2  # 03:00 UTC is still the 10th in New York
    assert f.nlp_sentiment_score == pytest.approx(0.8 * 1.25 / 2.25) and f.nlp_sentiment_dominant_topic_id == 7
    assert {r.article_id for r in SE.contributing_articles(SE.prepare(s, t)).collect()} == {"x", "y"} and "missing_source_default_weight" in f.nlp_semantic_warning_codes


def test_bar_contract_and_payloads(spark):
    p = spark.createDataFrame([('{"bars": {"aapl": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 10, "vw": 1.5}, {"t": "2024-01-03", "o": 5, "h": 2, "l": 1, "c": 2, "v": 10.5}]}}',)], "payload string")
    out = {str(r.date): r for r in C.check_bars(V.nested_bar_rows(p)).collect()}
    assert out["2024-01-02"].reject_reason is None and out["2024-01-02"].dollar_volume == 15.0 and out["2024-01-02"].ticker == "AAPL"
    assert out["2024-01-03"].reject_reason == "volume_not_integral"


def test_observations_and_universe_text(spark):
    o = spark.createDataFrame([(" dgs10", "2024-01-02", "2024-01-03", "2024-01-04", v) for v in (" 4.5", ".", "", "abc", None)], "series_id string, date string, realtime_start string, realtime_end string, value string")
    assert [(r.series_id, r.value, r.is_missing, r.reject_reason) for r in V.observation_rows(o).collect()][0::3] == [("DGS10", 4.5, False, None), ("DGS10", None, True, "value_not_numeric")]
    u = spark.createDataFrame([("2024-01-02", " a", "YES", None, " "), ("2024-01-02", "b", "perhaps", "n", "why")], "date string, ticker string, in_universe string, liquid string, reason string")
    a, b = C.check_universe(u).orderBy("ticker").collect()
    assert a.in_universe and a.liquid and a.tradable and a.reason is None and a.reject_reason is None
    assert b.reject_reason == "in_universe_not_boolean" and not b.liquid


def test_canonical_and_dated_identity(spark):
    s = spark.createDataFrame([("fb", "2015-01-01"), ("UA", "2016-04-07"), ("UA", "2016-04-08"), ("q", "2017-08-29"), (" ", "2017-01-01")], "raw_ticker string, d string").withColumn("date", F.col("d").cast("date"))
    assert [(r.raw_ticker, r.ticker) for r in C.resolve_identity(s).collect()] == [("fb", "META"), ("UA", "UAA"), ("UA", "UA"), ("q", "IQV")]


def test_every_article_of_a_busy_ticker_day_is_listed(spark):
    base = spark.range(10_500).select(
        F.lit("2024-01-10").cast("date").alias("date"), F.lit("A").alias("ticker"), F.col("id").cast("string").alias("article_id"), F.lit(0).alias("sentence_index"), F.lit(0).alias("chunk_index"),
        F.lit("Reuters").alias("source"), F.lit("2024-01-10 15:00:00").cast("timestamp").alias("published_at"), *[F.lit(v).alias(c) for c, v in (("positive", 0.9), ("negative", 0.1), ("neutral", 0.0), ("score", 0.8), ("relevance_score", 1.0))])
    rows = SE.prepare(base, None)
    assert SE.contributing_articles(rows).count() == 10_500 and SE.ticker_day_features(rows).first().nlp_article_count == 10_500


def test_rows_without_an_article_id_are_counted_not_gathered(spark):
    from tidemark.operators import review as RV
    day = dt.date(2024, 1, 10)
    rows = spark.createDataFrame([(day, "a", 0, "x"), (day, "a", 1, "y"), (day, "b", 0, None), (day, None, 0, "p"), (day, None, 1, "q")], "date date, article_id string, sentence_index int, text string")
    got = {r.article_id: (r.rows, r.rows_without_text, r.article_text) for r in RV.text_gaps(rows).collect()}
    assert got == {"a": (2, 0, "x y"), "b": (1, 1, None), None: (2, 0, None)}


def _long_headline(spark):
    """One article whose headline is as long as a text, with a repeated sentence, and a short one."""
    head = " ".join(f"Word{i} Corp said" for i in range(300)) + " Apple"
    text = " ".join(f"Line {i} ends here." for i in range(40)) + " Line 3 ends here. MSFT rose."
    return articles(spark, [("1", head, text, ["AAPL", "MSFT"]), ("2", "Short", "Apple rose. $msft fell.", ["MSFT"])])


def test_sentences_do_not_carry_the_headline(spark):
    """Gate evidence of a row is small however long the headline; the gate decides as without it."""
    a = _long_headline(spark)
    rows = N.preprocess(a, vocabulary=N.Vocabulary())
    assert set(N.EVIDENCE) <= set(rows.columns)
    assert rows.select(F.max(F.length(F.to_json(F.struct(*N.EVIDENCE))))).first()[0] < 500
    key = lambda g: sorted((r.article_id, r.ticker, r.chunk_index, r.relevance_decision, r.relevance_score, *r.reason_codes) for r in g.collect())
    got = key(N.relevance_gate(rows))
    assert got == key(N.relevance_gate(N.preprocess(a))) and len(got) == 2 * (1 + 42) + 2
    plan = N.relevance_gate(rows).select("article_id", "relevance_score")._jdf.queryExecution().optimizedPlan().toString()
    assert "provenance" not in plan and "entity_mentions" not in plan


def test_article_documents_group_by_a_digest_of_the_headline(spark):
    from tidemark.operators import topics as TP
    rows = N.preprocess(_long_headline(spark))
    docs = TP.article_documents(rows)
    got = {r.article_id: r for r in docs.collect()}
    assert got["2"].text == "Short Apple rose. $msft fell." and got["2"].tickers == ["MSFT"] and got["2"].article_sentence_count == 2
    one = got["1"]
    assert one.article_sentence_count == 1 + 40 + 1 and one.tickers == ["AAPL", "MSFT"]
    assert one.text.startswith("Word0 Corp said") and one.text.endswith("Line 38 ends here. Line 39 ends here. MSFT rose.")
    # nothing is grouped or joined by the headline itself, whose copies made the shuffle grow with its length
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    heads = [line for line in plan.splitlines() if "Aggregate [" in line and "chunk" in line.split("]")[0]]
    assert heads and all("normalized_headline" not in line.split("]")[0] for line in heads)


def test_universe_grown_from_days_is_not_broadcast(spark):
    """Few measured days become many (date, ticker) rows; these stay out of the driver."""
    articles = spark.range(600).select(
        F.concat(F.lit("a"), "id").alias("article_id"), F.date_add(F.lit("2000-01-03").cast("date"), (F.col("id") / 2).cast("int")).alias("date"), F.lit("Up S3. S999 The S7").alias("headline"),
        F.lit(None).cast("string").alias("summary"), F.lit("No S12x").alias("content"), F.array(F.lit("s1"), F.lit("S500")).alias("symbols"))
    days = articles.repartition(2).select("date").distinct()
    universe = days.select("date", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).select("date", F.concat(F.lit("S"), "k").alias("ticker"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        found = N.article_tickers(articles, universe)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 600 and {tuple(r.article_tickers) for r in rows} == {("S1", "S3", "S7")}
    assert {frozenset(k.token for k in r.known_tokens) for r in rows} == {frozenset({"S3", "S7"})}
    assert "BroadcastHashJoin [date" not in plan and "SortMergeJoin [date" in plan
