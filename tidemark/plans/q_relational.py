"""Contracts, vendor formats, set operations, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import rounded
from tidemark.operators import contracts as C
from tidemark.operators import market as M
from tidemark.operators import upsert as S
from tidemark.plans import testbed as T
from tidemark.registry import query, view
from tidemark.sources import archive as A
from tidemark.sources import vendors as V

# ---- contracts ------------------------------------------------------------------


def raw_bars(spark, sf):
    """Bars as text/number rows, some of them broken, by volume."""
    b = T.bars(spark, sf)
    v = F.col("volume")
    return b.select(
        F.when(v % 97 == 1, F.date_format("date", "yyyy/MM/dd")).otherwise(F.concat(F.lit(" "), F.col("date").cast("string"))).alias("date"),
        F.when(v % 97 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("ticker"))).alias("ticker"),
        F.when(v % 97 == 3, F.col("high") + 1).when(v % 97 == 4, F.lit(float("nan"))).otherwise(F.col("open")).alias("open"),
        F.when(v % 97 == 5, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low",
        F.when(v % 97 == 6, F.col("low") - 1).when(v % 97 == 7, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(v % 97 == 8, v + 0.5).when(v % 97 == 9, -v).otherwise(v).cast("double").alias("volume"),
        F.when(v % 97 == 10, F.lit(None)).otherwise(F.col("adj_close")).alias("adj_close"),
        F.when(v % 97 == 11, -F.col("dollar_volume")).otherwise(F.col("dollar_volume")).alias("dollar_volume"))


@query("f1_bar_contract", """
SELECT CASE WHEN volume % 97 = 1 THEN NULL ELSE date END AS date, CASE WHEN volume % 97 = 2 THEN NULL ELSE ticker END AS ticker, round(close, 6) AS close,
 CASE volume % 97 WHEN 1 THEN 'bad_date' WHEN 2 THEN 'empty_ticker' WHEN 3 THEN 'open_outside_range' WHEN 4 THEN 'open_not_finite' WHEN 5 THEN 'high_below_low' WHEN 6 THEN 'close_outside_range'
  WHEN 7 THEN 'close_not_positive' WHEN 8 THEN 'volume_not_integral' WHEN 9 THEN 'volume_negative' WHEN 10 THEN 'missing:adj_close' WHEN 11 THEN 'dollar_volume_negative' END AS reject_reason
FROM (SELECT * REPLACE (CASE volume % 97 WHEN 6 THEN low - 1 WHEN 7 THEN -close ELSE close END AS close) FROM v_bars)""")
def f1(spark, sf):
    return rounded(C.check_bars(raw_bars(spark, sf)).select("date", "ticker", "close", "reject_reason"))


def raw_universe(spark, sf):
    c = T.table(spark, sf, "customer")
    k = F.col("c_custkey")
    word = lambda p: F.when(k % p == 0, " No ").when(k % p == 1, "f").when(k % p == 2, "TRUE").when(k % p == 3, "1").when(k % p == 4, F.lit(None)).otherwise("y")
    return c.select(
        F.when(k % 53 == 0, "1998-13-01").otherwise("1998-01-05").alias("date"), F.concat(F.lit(" c"), k).alias("ticker"),
        F.when(k % 47 == 0, "maybe").when(k % 47 == 1, F.lit(None)).otherwise("t").alias("in_universe"),
        word(7).alias("tradable"), word(11).alias("liquid"), F.when(k % 5 == 0, "yes").otherwise("0").alias("halted"), word(13).alias("data_quality_ok"),
        F.when(k % 3 == 0, "   ").when(k % 3 == 1, " manual ").alias("reason"))


view("v_universe", """
SELECT c_custkey, CASE WHEN k % 53 = 0 THEN NULL ELSE DATE '1998-01-05' END AS date, 'C' || k AS ticker, CASE WHEN k % 47 < 2 THEN NULL ELSE true END AS in_universe,
       k % 7 NOT IN (0, 1) AS tradable, k % 11 NOT IN (0, 1) AS liquid, k % 5 = 0 AS halted, k % 13 NOT IN (0, 1) AS data_quality_ok, CASE WHEN k % 3 = 1 THEN 'manual' END AS reason,
       CASE WHEN k % 47 = 1 THEN 'missing_field' WHEN k % 53 = 0 THEN 'bad_date' WHEN k % 47 = 0 THEN 'in_universe_not_boolean' END AS reject_reason
FROM (SELECT *, c_custkey AS k FROM customer)""")


@query("f2_universe_contract", "SELECT * EXCLUDE (c_custkey) FROM v_universe")
def f2(spark, sf):
    return C.check_universe(raw_universe(spark, sf))


@query("f3_eligible", "SELECT ticker, coalesce(in_universe, false) AND tradable AND liquid AND data_quality_ok AND NOT halted AS eligible FROM v_universe")
def f3(spark, sf):
    return C.check_universe(raw_universe(spark, sf)).select("ticker", C.eligible().alias("eligible"))


def _symbols(spark, sf):
    """Index-change symbols spelled in several ways."""
    e = T.table(spark, sf, "events")
    k = F.col("user_id") % 9
    names = [" brk.b ", "bf.b", "FB", "wltw", "UA", "q", "ua", "abc.x", " "]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    return e.select("event_id", raw.alias("raw_ticker"), F.date_add(F.lit("2016-04-01").cast("date"), (F.col("event_id") % 600).cast("int")).alias("date"))


view("v_symbols", """
SELECT event_id, trim(upper(replace(s, '.', '-'))) AS n, DATE '2016-04-01' + CAST(event_id % 600 AS INTEGER) AS date
FROM (SELECT event_id, [' brk.b ', 'bf.b', 'FB', 'wltw', 'UA', 'q', 'ua', 'abc.x', ' '][user_id % 9 + 1] AS s FROM events)""")


@query("f4_canonical_ticker", "SELECT event_id, CASE n WHEN 'FB' THEN 'META' WHEN 'WLTW' THEN 'WTW' ELSE n END AS ticker FROM v_symbols")
def f4(spark, sf):
    return _symbols(spark, sf).select("event_id", C.canonical_ticker("raw_ticker").alias("ticker"))


@query("f5_dated_identity", """
SELECT event_id, CASE WHEN n = 'UA' AND date < '2016-04-08' THEN 'UAA' WHEN n = 'Q' AND date >= '2017-08-29' THEN 'IQV' WHEN n = 'FB' THEN 'META' WHEN n = 'WLTW' THEN 'WTW' ELSE n END AS ticker,
 CASE WHEN n = 'UA' AND date < '2016-04-08' THEN 'pre_2016_under_armour_class_a_alias' WHEN n = 'Q' AND date >= '2017-08-29' THEN 'post_2017_iqvia_alias'
      WHEN n IN ('FB', 'WLTW') THEN 'conflict_free_current_symbol_alias' ELSE 'identity_preserved' END AS reason_code
FROM v_symbols WHERE n <> ''""")
def f5(spark, sf):
    return C.resolve_identity(_symbols(spark, sf)).select("event_id", "ticker", "reason_code")


@query("f14_scope", "SELECT ticker, date FROM v_bars WHERE ticker IN (SELECT ticker FROM v_ticker_sectors WHERE sector = 'ASIA')")
def f14(spark, sf):
    return C.in_scope(T.bars(spark, sf), T.ticker_sectors(spark, sf).where("sector = 'ASIA'"), ["ticker"]).select("ticker", "date")


@query("f15_drop_warmup", "SELECT ticker, date FROM v_market_guarded WHERE coalesce(returns_5d, returns_21d, realized_vol_5d) IS NOT NULL")
def f15(spark, sf):
    f = M.market_features(T.bars(spark, sf)).select("ticker", "date", "returns_5d", "returns_21d", "realized_vol_5d")
    return C.drop_warmup(f, ["returns_5d", "returns_21d", "realized_vol_5d"]).select("ticker", "date")


# ---- vendor formats ----------------------------------------------------------------


@query("f6_adjusted_prices", """
SELECT date, ticker, round(CASE WHEN volume % 3 = 0 THEN adj_close ELSE open END, 6) AS open, round(adj_close, 6) AS close, round(adj_close * volume, 4) AS dollar_volume,
       CASE WHEN NOT (CASE WHEN volume % 3 = 0 THEN adj_close ELSE open END BETWEEN low AND greatest(high, adj_close)) THEN 'open_outside_range' WHEN adj_close < low THEN 'close_outside_range' END AS reject_reason FROM v_bars""")
def f6(spark, sf):
    b = T.bars(spark, sf)
    raw = b.select(F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "ticker", F.col("adj_close").alias("adjClose"),
                   F.when(F.col("volume") % 3 == 0, F.col("adj_close")).alias("adjOpen"), F.lit(None).cast("double").alias("adjHigh"), F.lit(None).cast("double").alias("adjLow"),
                   "open", F.greatest("high", "adj_close").alias("high"), "low", "volume")
    return rounded(C.check_bars(V.adjusted_price_rows(raw)).select("date", "ticker", "open", "close", "dollar_volume", "reject_reason"), dollar_volume=4)


def bar_payloads(spark, sf):
    b = T.bars(spark, sf)
    row = F.struct(F.concat(F.col("date").cast("string"), F.lit("T05:00:00Z")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                   F.col("close").alias("c"), F.col("volume").alias("v"), F.when(F.col("volume") % 2 == 0, F.col("close") + 0.25).alias("vw"))
    rows = F.when(F.col("volume") % 100 == 0, F.array(row, row)).otherwise(F.array(row))
    return b.select(F.to_json(F.struct(F.create_map(F.lower("ticker"), rows).alias("bars"), F.lit(None).cast("string").alias("next_page_token"))).alias("payload"))


@query("f7_nested_bars", """
SELECT date, ticker, round(close, 6) AS close, volume, round(CASE WHEN volume % 2 = 0 THEN close + 0.25::DOUBLE ELSE close END * volume, 5) AS dollar_volume FROM v_bars, (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR volume % 100 = 0""")
def f7(spark, sf):
    return rounded(C.valid_bars(V.nested_bar_rows(bar_payloads(spark, sf))).select("date", "ticker", "close", "volume", "dollar_volume"), dollar_volume=5)


@query("f7_duplicate_bars", "SELECT date, ticker, 2 AS copies FROM v_bars WHERE volume % 100 = 0")
def f7b(spark, sf):
    return V.duplicate_keys(C.valid_bars(V.nested_bar_rows(bar_payloads(spark, sf))), ["date", "ticker"])


def raw_observations(spark, sf):
    m = T.macro(spark, sf)
    k = F.col("retrieved_at")
    return m.select(
        F.concat(F.lit(" "), F.lower("series_id"), F.lit(" ")).alias("series_id"), F.col("observation_date").cast("string").alias("date"), F.col("realtime_start").cast("string").alias("realtime_start"),
        F.when(k % 31 == 0, "soon").otherwise(F.col("realtime_end").cast("string")).alias("realtime_end"),
        F.when(k % 7 == 0, " . ").when(k % 7 == 1, "").when(k % 29 == 0, "n/a").when(k % 23 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("value"), k.alias("k"))


@query("f8_observations", """
SELECT series_id, observation_date, realtime_start, CASE WHEN k % 31 = 0 THEN NULL ELSE realtime_end END AS realtime_end, CASE WHEN ok THEN value END AS value, NOT ok AS is_missing,
 CASE WHEN k % 7 > 1 AND k % 29 <> 0 AND k % 23 = 0 THEN 'missing_value' WHEN k % 7 > 1 AND k % 29 = 0 THEN 'value_not_numeric' WHEN k % 31 = 0 THEN 'bad_date' END AS reject_reason
FROM (SELECT *, retrieved_at AS k, retrieved_at % 7 > 1 AND retrieved_at % 29 <> 0 AND retrieved_at % 23 <> 0 AS ok FROM v_macro)""")
def f8(spark, sf):
    return V.observation_rows(raw_observations(spark, sf))


def filing_payloads(spark, sf):
    f = T.filings_flat(spark, sf)
    text = lambda c: F.col(c).cast("string")
    cols = F.array(*[F.lit(x) for x in ("Report Date", "Publish Date", "Fiscal Year", "Fiscal Period", "Revenue")])
    row = F.array(text("report_date"), F.when(F.col("fiscal_period") != "Q3", F.concat(text("availability_date"), F.lit("T00:00:00"))), text("fiscal_year"), F.col("fiscal_period"), text("revenue"))
    broken = F.when(F.col("fiscal_period") == "Q4", F.array(row, F.array(F.lit("only one")))).otherwise(F.array(row))
    company = F.struct(F.lower("ticker").alias("ticker"), F.lit("USD").alias("currency"), F.array(F.struct(F.lit("PL").alias("statement"), cols.alias("columns"), broken.alias("data"))).alias("statements"))
    plain = F.struct(F.concat(F.array(F.lit("ticker")), cols).alias("columns"), F.array(F.concat(F.array(F.col("ticker")), row)).alias("data"))
    return f.select(F.to_json(F.array(company)).alias("nested"), F.to_json(plain).alias("compact"))


@query("f9_compact_rows", "SELECT ticker, report_date, revenue, 6 AS fields FROM v_filings")
def f9(spark, sf):
    r = V.compact_rows(filing_payloads(spark, sf), "compact")
    return r.select(F.col("raw")["ticker"].alias("ticker"), F.col("raw")["Report Date"].cast("date").alias("report_date"), F.col("raw")["Revenue"].cast("double").alias("revenue"), F.size("raw").alias("fields"))


@query("f9_nested_rows", "SELECT lower(ticker) AS ticker, 'USD' AS currency, 'pl' AS statement, report_date, revenue FROM v_filings")
def f9b(spark, sf):
    r = V.nested_company_rows(filing_payloads(spark, sf), "nested")
    m = F.col("raw")
    return r.select(m["ticker"].alias("ticker"), m["currency"].alias("currency"), m["statement"].alias("statement"), m["Report Date"].cast("date").alias("report_date"), m["Revenue"].cast("double").alias("revenue"))


@query("f10_filing_rows", """
SELECT ticker, report_date, CASE WHEN fiscal_period = 'Q3' THEN report_date ELSE availability_date END AS availability_date, 'pl' AS statement, fiscal_year, fiscal_period, 'USD' AS currency, CAST(NULL AS VARCHAR) AS reject_reason FROM v_filings""")
def f10(spark, sf):
    r = V.filing_rows(V.nested_company_rows(filing_payloads(spark, sf), "nested"))
    return r.select("ticker", "report_date", "availability_date", "statement", "fiscal_year", "fiscal_period", "currency", "reject_reason")


def fact_payloads(spark, sf):
    f = T.filings_flat(spark, sf)
    def fact(val, filed, form):
        return F.struct(val.alias("val"), F.col("report_date").cast("string").alias("end"), filed.cast("string").alias("filed"), form.alias("form"), F.col("fiscal_year").alias("fy"),
                        F.col("fiscal_period").alias("fp"), F.concat(F.lit("a-"), F.col("ticker"), F.lit("-"), F.col("report_date").cast("string")).alias("accn"))
    form = F.when(F.col("fiscal_period") == "Q4", "10-K").when(F.col("fiscal_period") == "Q2", "8-K").otherwise(" 10-q ")
    av = F.col("availability_date")
    unit = lambda u, *facts: F.struct(F.create_map(F.lit(u), F.array(*facts)).alias("units"))
    gaap = F.create_map(
        F.lit("SalesRevenueNet"), unit("USD", fact(F.col("revenue") * 2, av, form)),
        F.lit("Revenues"), F.when(F.col("fiscal_period") == "Q1", unit("EUR", fact(F.col("revenue"), av, form))).otherwise(unit("USD", fact(F.col("revenue"), av, form), fact(F.col("revenue") + 1, av, form))),
        F.lit("EarningsPerShareBasic"), unit("USD/shares", fact(F.col("eps"), av, form)), F.lit("Ignored"), unit("USD", fact(F.col("eps"), av, form)))
    dei = F.create_map(F.lit("EntityCommonStockSharesOutstanding"), unit("shares", fact(F.col("shares"), av, form)))
    return f.select("ticker", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), gaap, F.lit("dei"), dei).alias("facts"))).alias("payload"))


@query("f11_company_facts", """
SELECT ticker, availability_date, report_date, 'a-' || ticker || '-' || report_date AS accession, fiscal_period, fiscal_year, CASE WHEN fiscal_period = 'Q1' THEN revenue * 2 ELSE revenue END AS revenue, eps, shares, 3 AS fields
FROM v_filings WHERE fiscal_period <> 'Q2' AND availability_date BETWEEN '1996-01-01' AND '2000-12-31'""")
def f11(spark, sf):
    r = V.company_fact_rows(fact_payloads(spark, sf), "1996-01-01", "2000-12-31")
    return r.select("ticker", "availability_date", "report_date", "accession", "fiscal_period", "fiscal_year", F.col("fields")["Revenue"].alias("revenue"),
                    F.col("fields")["epsBasic"].alias("eps"), F.col("fields")["sharesBasic"].alias("shares"), F.size("fields").alias("fields"))


@query("f12_rewrite_alias", """
SELECT CASE ticker WHEN 'S3' THEN 'S30' WHEN 'S4' THEN 'S40' ELSE ticker END AS ticker, report_date, CASE ticker WHEN 'S3' THEN 'S30' WHEN 'S4' THEN 'S40' ELSE ticker END AS raw_symbol, revenue FROM v_filings""")
def f12(spark, sf):
    f = T.filings_flat(spark, sf).withColumn("raw_json", F.to_json(F.struct(F.col("ticker").alias("Symbol"), F.col("revenue"))))
    r = V.rewrite_alias_rows(f.select("ticker", "report_date", "raw_json"), {"S3": "S30", "S4": "S40"})
    return r.select("ticker", "report_date", F.get_json_object("raw_json", "$.Symbol").alias("raw_symbol"), F.get_json_object("raw_json", "$.revenue").cast("double").alias("revenue"))


# ---- set operations ---------------------------------------------------------------------


def _old_new(spark, sf):
    b = T.bars(spark, sf).select("ticker", "date", F.round("close", 6).alias("close"), "volume")
    old = b.where(F.col("date") < F.lit("1999-01-01").cast("date"))
    new = b.where(F.col("date") >= F.lit("1998-06-01").cast("date")).withColumn("close", F.when(F.col("volume") % 2 == 0, F.col("close")).otherwise(F.col("close") + 1))
    return old, new


view("v_old", "SELECT ticker, date, round(close, 6) AS close, volume FROM v_bars WHERE date < '1999-01-01'")
view("v_new", "SELECT ticker, date, CASE WHEN volume % 2 = 0 THEN round(close, 6) ELSE round(close, 6) + 1 END AS close, volume FROM v_bars WHERE date >= '1998-06-01'")


@query("s1_union", "SELECT ticker, count(*) AS n, count(extra) AS extras FROM (SELECT ticker, close, NULL AS extra FROM v_old UNION ALL SELECT ticker, close, 1 FROM v_new) GROUP BY 1")
def s1(spark, sf):
    old, new = _old_new(spark, sf)
    return S.union_all(old, new.withColumn("extra", F.lit(1))).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extras"))


@query("s2_missing_unexpected", """
SELECT ticker, date, 'missing' AS status FROM (SELECT ticker, date FROM v_old EXCEPT SELECT ticker, date FROM v_new) UNION ALL SELECT ticker, date, 'unexpected' FROM (SELECT ticker, date FROM v_new EXCEPT SELECT ticker, date FROM v_old)""")
def s2(spark, sf):
    old, new = _old_new(spark, sf)
    return S.presence(old, new, ["ticker", "date"])


@query("j16_expected_actual", """
SELECT ticker, date, 'missing' AS status FROM (SELECT ticker, date FROM v_qpanel EXCEPT SELECT ticker, date FROM v_bars) UNION ALL SELECT ticker, date, 'unexpected' FROM (SELECT ticker, date FROM v_bars EXCEPT SELECT ticker, date FROM v_qpanel)""")
def j16(spark, sf):
    from tidemark.plans.q_pit import quality_panel
    return S.presence(quality_panel(spark, sf), T.bars(spark, sf), ["ticker", "date"])


@query("s3_mismatches", "SELECT o.ticker, o.date, round(o.close, 4) AS left_value, round(n.close, 4) AS right_value FROM v_old o JOIN v_new n ON o.ticker = n.ticker AND o.date = n.date WHERE o.close IS DISTINCT FROM n.close")
def s3(spark, sf):
    old, new = _old_new(spark, sf)
    return rounded(S.mismatches(old, new, ["ticker", "date"], "close"), 4)


@query("s4_bars_upsert", "SELECT ticker, date, round(close, 4) AS close, volume FROM (SELECT * FROM v_new UNION ALL SELECT * FROM v_old o WHERE NOT EXISTS (SELECT 1 FROM v_new n WHERE n.ticker = o.ticker AND n.date = o.date))")
def s4(spark, sf):
    old, new = _old_new(spark, sf)
    return rounded(S.upsert(old, new, ["ticker", "date"]), 4)


@query("s4_unchanged_histories", "SELECT ticker, NOT bool_or(ticker IN ('S1', 'S5') AND date >= '2000-01-01') AS unchanged FROM v_bars GROUP BY 1")
def s4b(spark, sf):
    b = T.bars(spark, sf).select("ticker", "date", "close", "volume")
    changed = b.withColumn("volume", F.when(F.col("ticker").isin("S1", "S5") & (F.col("date") >= F.lit("2000-01-01").cast("date")), F.col("volume") + 1).otherwise(F.col("volume")))
    return S.unchanged_keys(b, changed, "ticker")


@query("s5_feature_upsert", """
SELECT ticker, date, round(CASE WHEN date >= '1999-01-01' THEN returns_1d ELSE returns_5d END, 6) AS value FROM v_market_guarded""")
def s5(spark, sf):
    f = M.market_features(T.spread(T.bars(spark, sf), "ticker", T.table(spark, sf, "lineitem"))).select("ticker", "date", "returns_1d", "returns_5d")
    new = f.where(F.col("date") >= F.lit("1999-01-01").cast("date")).select("ticker", "date", F.col("returns_1d").alias("value"))
    return rounded(S.upsert(f.select("ticker", "date", F.col("returns_5d").alias("value")), new, ["date", "ticker"]).select("ticker", "date", "value"))


MACRO_ID = ["series_id", "observation_date", "realtime_start", "realtime_end"]


@query("s6_macro_upsert", """
SELECT series_id, observation_date, realtime_start, realtime_end, arg_max(value, row(retrieved_at % 2, retrieved_at)) AS value, count(*)::BIGINT AS n FROM v_macro GROUP BY 1, 2, 3, 4""".replace(", count(*)::BIGINT AS n", ""))
def s6(spark, sf):
    m = T.macro(spark, sf)
    old, new = m.where(F.col("retrieved_at") % 2 == 0), m.where(F.col("retrieved_at") % 2 == 1)
    return S.upsert(old, new, MACRO_ID, [F.col("retrieved_at")]).select(*MACRO_ID, "value")


@query("s7_article_dedupe", """
SELECT coalesce(id, url) AS article_key, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN NULL ELSE 'd' || (doc_id % 300) END AS id, 'u' || (doc_id % 40) AS url FROM documents) GROUP BY 1""")
def s7(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 12 == 5, F.lit(None)).otherwise(F.concat(F.lit("d"), F.col("doc_id") % 300)).alias("id"),
                                               F.concat(F.lit("u"), F.col("doc_id") % 40).alias("url"), F.lit("h").alias("headline"), F.lit("c").alias("content"), F.lit(0).alias("published_at"))
    return S.dedupe_articles(d, [F.col("doc_id")]).select("article_key", F.col("doc_id").alias("first_doc"))


@query("s8_payload_dedupe", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang, text")
def s8(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return S.dedupe_payloads(d, ["source", "lang"], "text", [F.col("doc_id")]).select("source", "lang", "doc_id")


@query("s9_merge_layouts", "SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS copies, count(DISTINCT o_orderstatus) AS payloads, min(o_orderstatus) AS payload, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1, 2")
def s9(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("payload"))
    return S.merge_layouts(o, ["ticker", "date"], "payload")


@query("s10_duplicate_archive", """
WITH l AS (SELECT ticker, date FROM v_bars WHERE date BETWEEN '1997-01-01' AND '1999-12-31'), c AS (SELECT ticker, date FROM l WHERE ticker <> 'S9' AND NOT (ticker IN ('S2', 'S8') AND month(date) = 3))
SELECT ticker, count(*) AS legacy_rows, count(c.date) AS current_rows, count(*) - count(c.date) AS missing_dates, min(CASE WHEN c.date IS NULL THEN l.date END) AS first_missing,
       CASE WHEN count(c.date) = 0 THEN 'missing' WHEN count(*) > count(c.date) THEN 'insufficient' ELSE 'verified' END AS status FROM l LEFT JOIN c USING (ticker, date) GROUP BY ticker""")
def s10(spark, sf):
    b = T.bars(spark, sf).select("ticker", "date")
    cur = b.where((F.col("ticker") != "S9") & ~(F.col("ticker").isin("S2", "S8") & (F.month("date") == 3)))
    return S.reconcile_duplicates(b, cur, "1997-01-01", "1999-12-31")


@query("s11_security_identities", """
SELECT DISTINCT CASE WHEN security_id % 3 = 0 THEN 'P-' || security_id ELSE ticker || '_' || coalesce(CAST(start_date AS VARCHAR), 'UNKNOWN-START') || '_' || coalesce(CAST(end_date AS VARCHAR), 'ACTIVE') END AS stable_id, ticker, start_date, end_date
FROM v_securities WHERE ticker IN ('BUILDING', 'MACHINERY')""")
def s11(spark, sf):
    m = T.security_master(spark, sf).withColumn("perma_ticker", F.when(F.col("security_id") % 3 == 0, F.concat(F.lit(" p "), F.col("security_id"))))
    return S.security_identities(m, T.table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_mktsegment").alias("ticker")))


# ---- scans and sinks ------------------------------------------------------------------------


@query("sc1_bars_scan", "SELECT ticker, date, round(close, 6) AS close, volume FROM v_bars WHERE date BETWEEN '1996-01-01' AND '1996-12-31'")
def sc1(spark, sf):
    path = A.scratch(spark, "bars")
    b = T.bars(spark, sf)
    b.unionByName(b.where(F.col("volume") % 5 == 0)).write.mode("overwrite").parquet(path)
    return rounded(A.scan_bars(spark, path, start="1996-01-01", end="1996-12-31").select("ticker", "date", "close", "volume"))


@query("sc2_filings_scan", "SELECT ticker, report_date, availability_date, statement FROM v_filings, (SELECT unnest(['pl', 'bs']) AS statement) WHERE ticker IN ('S1', 'S2')")
def sc2(spark, sf):
    path = A.scratch(spark, "filings")
    T.filings(spark, sf).write.mode("overwrite").parquet(path)
    return A.scan_filings(spark, path, tickers=["S1", "S2"]).select("ticker", "report_date", "availability_date", "statement")


@query("sc3_macro_scan", """
SELECT series_id, observation_date, realtime_start, realtime_end, max(retrieved_at) AS retrieved_at, arg_max(CASE WHEN retrieved_at % 2 = 0 THEN observation_date + 1 ELSE observation_date END, retrieved_at) AS snapshot_date
FROM v_macro WHERE observation_date BETWEEN '1997-01-01' AND '1998-12-31' GROUP BY 1, 2, 3, 4""")
def sc3(spark, sf):
    path = A.scratch(spark, "macro")
    m = T.macro(spark, sf).withColumn("shard_date", F.trunc("observation_date", "month")).withColumn("snapshot_date", F.when(F.col("retrieved_at") % 2 == 0, F.date_add("observation_date", 1)).otherwise(F.col("observation_date")))
    m.write.mode("overwrite").partitionBy("shard_date").parquet(path)
    df = A.scan_macro(spark, path, start="1997-01-01", end="1998-12-31")
    return df.select(*MACRO_ID, "retrieved_at", "snapshot_date")


@query("sc4_order_book_scan", "SELECT ticker, captured_at, seq FROM v_order_book WHERE date = '2024-01-10' AND seq % 2 = 0")
def sc4(spark, sf):
    path = A.scratch(spark, "book")
    T.order_book(spark, sf).withColumn("provider", F.when(F.col("seq") % 2 == 0, "alpha").otherwise("beta")).write.mode("overwrite").partitionBy("provider", "date").parquet(path)
    return A.scan_order_book(spark, path, provider="alpha", date="2024-01-10").select("ticker", "captured_at", "seq")


@query("sc5_news_scan", "SELECT url, id, source, sym_a || ';' || sym_b AS symbols, length(content) AS chars FROM v_articles")
def sc5(spark, sf):
    path = A.scratch(spark, "news")
    T.articles(spark, sf).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("overwrite").json(path)
    return A.scan_articles(spark, path).select("url", "id", "source", F.array_join("symbols", ";").alias("symbols"), F.length("content").alias("chars"))


view("v_mask", "SELECT date, ticker, in_universe, tradable, liquid, halted, data_quality_ok, reason FROM v_universe WHERE reject_reason IS NULL")


@query("sc6_universe_scan", "SELECT date, ticker FROM v_mask WHERE tradable AND liquid AND data_quality_ok AND NOT halted")
def sc6(spark, sf):
    path = A.scratch(spark, "universe")
    u = C.check_universe(raw_universe(spark, sf)).where(F.col("reject_reason").isNull()).drop("reject_reason")
    A.write_universe_masks(u, path)
    return C.check_universe(A.scan_universe(spark, path)).where(C.eligible()).select("date", "ticker")


FEATS = ["returns_1d", "returns_5d", "atr_14"]


def _store(spark, sf):
    path = A.scratch(spark, "features")
    f = M.market_features(T.bars(spark, sf))
    A.write_features(f.select("date", "ticker", *FEATS), path)
    return path, f


@query("sc7_feature_read", "SELECT date, ticker, round(returns_1d, 6) AS returns_1d FROM v_market_guarded WHERE ticker IN ('S1', 'S2', 'S3') AND date BETWEEN '1998-01-15' AND '1998-02-10'")
def sc7(spark, sf):
    path, _ = _store(spark, sf)
    return rounded(A.read_features(spark, path, tickers=["S1", "S2", "S3"], start="1998-01-15", end="1998-02-10").select("date", "ticker", "returns_1d"))


@query("sc7_missing_tickers", "SELECT ticker FROM v_ticker_sectors WHERE ticker NOT IN (SELECT ticker FROM v_bars WHERE date = '1998-01-15')")
def sc7b(spark, sf):
    path, _ = _store(spark, sf)
    return A.missing_tickers(A.read_features(spark, path, start="1998-01-15", end="1998-01-15"), T.ticker_sectors(spark, sf))


def _evidence(spark, sf):
    """Order rows as artifacts: most dates under the run itself, some under a dated run, some missing or empty."""
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey")
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    rows = o.where(day % 10 != 0).select("date", F.when(day % 3 == 0, F.concat(F.lit("run-"), F.col("date").cast("string"))).otherwise("run").alias("run_id"), F.col("o_orderkey").alias("key"))
    extra = o.where(day % 7 == 0).where(day % 10 != 0).select("date", F.concat(F.lit("run-"), F.col("date").cast("string")).alias("run_id"), (-F.col("o_orderkey")).alias("key"))
    rows = rows.unionByName(extra)
    empty = o.where(day % 20 == 0).select("date", F.lit("run").alias("run_id"), F.lit(0).alias("n_rows")).distinct()
    listing = rows.groupBy("date", "run_id").agg(F.count(F.lit(1)).alias("n_rows")).unionByName(empty)
    return A.evidence_with_fallback(rows, listing, "run", o)


view("v_ev", """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS key, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS day FROM orders""")


@query("sc8_evidence_rows", """
SELECT date, CASE WHEN day % 3 = 0 THEN 'run-' || date ELSE 'run' END AS source_run, key FROM v_ev WHERE day % 10 <> 0
UNION ALL SELECT date, 'run-' || date, -key FROM v_ev WHERE day % 10 <> 0 AND day % 7 = 0 AND day % 3 = 0""")
def sc8(spark, sf):
    return _evidence(spark, sf)[0].select("date", "source_run", "key")


@query("sc8_evidence_problems", "SELECT DISTINCT date, CASE WHEN day % 20 = 0 THEN 'empty' ELSE 'missing' END AS problem FROM v_ev WHERE day % 10 = 0")
def sc8b(spark, sf):
    return _evidence(spark, sf)[1]


@query("sk1_feature_store", """
SELECT date, ticker, round(CASE WHEN date >= '1998-02-10' AND CAST(substring(ticker, 2) AS INTEGER) % 3 = 1 THEN -1.0::DOUBLE ELSE returns_1d END, 6) AS returns_1d, CASE WHEN date >= '1998-02-10' AND CAST(substring(ticker, 2) AS INTEGER) % 3 = 1 THEN 2 END AS revision FROM v_market_guarded""")
def sk1(spark, sf):
    """The whole feature table; a second write replaces a third of the tickers from one day on and adds a column."""
    path, f = _store(spark, sf)
    part = f.where((F.col("date") >= F.lit("1998-02-10").cast("date")) & (F.substring("ticker", 2, 9).cast("int") % 3 == 1))
    A.write_features(part.select("date", "ticker", F.lit(-1.0).alias("returns_1d"), "returns_5d", "atr_14", F.lit(2).alias("revision")), path)
    # the first months were written without the column
    return rounded(spark.read.option("mergeSchema", True).parquet(path).select("date", "ticker", "returns_1d", "revision"))


@query("sk2_json_round_trip", "SELECT date, ticker, round(returns_1d, 6) AS returns_1d, round(atr_14, 6) AS atr_14, '{\"atr_14\":' AS head FROM v_market_guarded")
def sk2(spark, sf):
    f = M.market_features(T.bars(spark, sf)).select("date", "ticker", "returns_1d", "atr_14")
    j = A.to_json_rows(f, ["date", "ticker"])
    back = A.from_json_rows(j.withColumn("head", F.substring("features_json", 1, 10)), ["date", "ticker", "head"], "returns_1d double, atr_14 double")
    return rounded(back.select("date", "ticker", "returns_1d", "atr_14", "head"))


@query("sk3_label_store", "SELECT date, ticker, round(forward_return_5d, 6) AS forward_return_5d FROM v_labels")
def sk3(spark, sf):
    from tidemark.operators.labels import forward_return_labels
    path = A.scratch(spark, "labels")
    A.write_labels(forward_return_labels(T.bars(spark, sf)), path)
    return rounded(A.read_features(spark, path).select("date", "ticker", "forward_return_5d"))


@query("sk4_universe_masks", "SELECT * FROM v_mask")
def sk4(spark, sf):
    path = A.scratch(spark, "masks")
    u = C.check_universe(raw_universe(spark, sf)).where(F.col("reject_reason").isNull()).drop("reject_reason")
    A.write_universe_masks(u, path)
    back = C.check_universe(A.scan_universe(spark, path)).drop("reject_reason")
    # nothing changed, so a second write has nothing to do
    return back.unionByName(A.changed_masks(u, back))


@query("sk5_news_archive", "SELECT CAST(published_at AS DATE) AS date, coalesce(id, url) AS article_id, length(content) AS chars FROM v_articles")
def sk5(spark, sf):
    path = A.scratch(spark, "archive")
    A.write_articles(T.articles(spark, sf).withColumn("article_id", F.coalesce("id", "url")), path)
    back = spark.read.schema("date date, article_id string, content string, published_at string").json(path)
    return back.select("date", "article_id", F.length("content").alias("chars"))


@query("sk6_reports", "SELECT sector, count(*) AS tickers FROM v_ticker_sectors GROUP BY 1")
def sk6(spark, sf):
    report = T.ticker_sectors(spark, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("tickers"))
    j, c = A.scratch(spark, "report-json"), A.scratch(spark, "report-csv")
    A.write_report(report, j)
    A.write_report(report, c, "csv")
    as_json = spark.read.schema("sector string, tickers bigint").json(j)
    as_csv = spark.read.schema("sector string, tickers bigint").option("header", True).csv(c)
    return as_json.join(as_csv, ["sector", "tickers"])
