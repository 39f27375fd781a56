"""Market-shaped tables derived from the supplied test tables.

Every function is a lazy DataFrame over whole tables; `VIEWS` in `registry`
holds the same derivation as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import view

N_NEWS_TICKERS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, of: DataFrame, rows: int = 250_000) -> DataFrame:
    """Deal `df` out by `key`, to one task for so many rows of `of`, the raw table it was reduced from.

    For a small table that a next step makes large again: adaptive execution sees its few bytes only, and would give
    all of them to one task. Counting a stored table reads the footers of its files.
    """
    return df.repartition(tasks(of, rows), key)


def tasks(of: DataFrame, rows: int = 250_000) -> int:
    return max(1, -(-of.count() // rows))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One traded line: ticker, date, price, adjusted price, quantity, tie-break key."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
    )
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
        F.col("p_retailprice").alias("adj"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"),
    )


view("v_lines", """
SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_suppkey,
       p_retailprice * (1 - l_discount) AS price, p_retailprice AS adj, l_quantity AS qty,
       l_orderkey, l_linenumber, l_partkey,
       row(l_orderkey, l_linenumber, l_partkey) AS k
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return (
        lines(spark, sf)
        .groupBy("ticker", "date")
        .agg(
            F.min_by("price", "k").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "k").alias("close"),
            F.sum("qty").cast("bigint").alias("volume"),
            F.max_by("adj", "k").alias("adj_close"),
            F.sum(F.col("price") * F.col("qty")).alias("dollar_volume"),
        )
    )


view("v_bars", """
SELECT ticker, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, k) AS close, CAST(sum(qty) AS BIGINT) AS volume,
       arg_max(adj, k) AS adj_close, sum(price * qty) AS dollar_volume
FROM v_lines GROUP BY ticker, date""")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """One market-wide bar per date."""
    return (
        lines(spark, sf)
        .groupBy("date")
        .agg(F.try_divide(F.sum(F.col("price") * F.col("qty")), F.sum("qty")).alias("adj_close"))
    )


view("v_benchmark", "SELECT date, sum(price * qty) / nullif(sum(qty), 0) AS adj_close FROM v_lines GROUP BY date")


def ticker_sectors(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("r_name").alias("sector"))
    )


view("v_ticker_sectors", """
SELECT 'S' || s_suppkey AS ticker, r_name AS sector FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def sector_bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per (sector, date); the sector name is its fund ticker."""
    per_ticker = lines(spark, sf).groupBy("ticker", "date").agg(
        F.sum(F.col("price") * F.col("qty")).alias("v"), F.sum("qty").alias("q")
    )
    return (
        per_ticker.join(ticker_sectors(spark, sf), "ticker")
        .groupBy(F.col("sector").alias("etf"), "date")
        .agg(F.try_divide(F.sum("v"), F.sum("q")).alias("adj_close"))
    )


view("v_sector_bars", """
SELECT sector AS etf, date, sum(price * qty) / nullif(sum(qty), 0) AS adj_close
FROM v_lines JOIN v_ticker_sectors USING (ticker) GROUP BY sector, date""")


def filings_flat(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity", "l_tax"
    )
    quarter_end = F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1)
    q = li.groupBy("l_suppkey", quarter_end.alias("report_date")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        F.round(F.sum(F.col("l_extendedprice") * (F.lit(0.12) - F.col("l_discount") - F.col("l_tax"))), 4).alias("net_income"),
        F.round(F.sum("l_extendedprice"), 2).alias("gross"),
        F.sum("l_quantity").alias("shares"),
    )
    avail = F.date_add("report_date", (F.lit(20) + F.col("l_suppkey") % 40).cast("int"))
    return (
        q.join(ticker_sectors(spark, sf), F.concat(F.lit("S"), F.col("l_suppkey")) == F.col("ticker"))
        .select(
            "ticker",
            "report_date",
            avail.alias("availability_date"),
            F.year("report_date").alias("fiscal_year"),
            F.concat(F.lit("Q"), F.quarter("report_date")).alias("fiscal_period"),
            F.date_sub(avail, 1).alias("earnings_date"),
            "revenue",
            "net_income",
            (F.col("gross") * 2).alias("total_assets"),
            (F.col("gross") * F.lit(0.5) + F.col("revenue") * F.lit(0.25)).alias("total_liabilities"),
            "shares",
            F.round(F.col("net_income") / F.col("shares"), 6).alias("eps"),
            "sector",
        )
    )


view("v_filings", """
SELECT ticker, report_date, availability_date,
       CAST(year(report_date) AS INTEGER) AS fiscal_year, 'Q' || quarter(report_date) AS fiscal_period,
       availability_date - 1 AS earnings_date, revenue, net_income, gross * 2 AS total_assets,
       gross * 0.5::DOUBLE + revenue * 0.25::DOUBLE AS total_liabilities, shares,
       round(net_income / shares, 6) AS eps, sector
FROM (SELECT *, report_date + CAST(20 + l_suppkey % 40 AS INTEGER) AS availability_date
      FROM (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date,
             round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
             round(sum(l_extendedprice * (0.12::DOUBLE - l_discount - l_tax)), 4) AS net_income,
             round(sum(l_extendedprice), 2) AS gross, sum(l_quantity) AS shares
      FROM lineitem GROUP BY 1, 2))
JOIN v_ticker_sectors ON ticker = 'S' || l_suppkey""")


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Two statement rows per fiscal period, values inside `raw_json`; their readers make a row of each value."""
    flat = spread(filings_flat(spark, sf), "ticker", table(spark, sf, "lineitem"))
    head = ["ticker", "report_date", "availability_date", "fiscal_year", "fiscal_period", "earnings_date"]
    income = F.to_json(
        F.struct(F.col("revenue"), F.col("net_income").alias("netIncome"), F.col("eps"), F.col("sector"))
    )
    balance = F.to_json(
        F.struct(
            F.col("total_assets").alias("totalAssets"),
            F.col("total_liabilities").alias("totalLiabilities"),
            F.col("shares"),
        )
    )
    statements = F.explode(
        F.array(
            F.struct(F.lit("pl").alias("statement"), F.lit(0).alias("seq"), income.alias("raw_json")),
            F.struct(F.lit("bs").alias("statement"), F.lit(1).alias("seq"), balance.alias("raw_json")),
        )
    )
    return flat.select(*head, statements.alias("s")).select(*head, "s.*")


def macro(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rt = F.date_add(F.to_date("o_orderdate"), (1 + F.col("o_orderkey") % 30).cast("int"))
    return o.select(
        F.col("o_orderpriority").alias("series_id"),
        F.to_date("o_orderdate").alias("observation_date"),
        rt.alias("realtime_start"),
        F.date_add(rt, 30).alias("realtime_end"),
        F.col("o_orderkey").alias("retrieved_at"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_orderstatus") == "P").alias("is_missing"),
    )


view("v_macro", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date,
       CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 30 AS INTEGER) AS realtime_start,
       CAST(o_orderdate AS DATE) + CAST(31 + o_orderkey % 30 AS INTEGER) AS realtime_end,
       o_orderkey AS retrieved_at, o_totalprice AS value, o_orderstatus = 'P' AS is_missing
FROM orders""")


def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    return e.select(
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type") == "signup", "added").otherwise("removed").alias("action"),
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
    )


def current_members(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events").where(F.col("user_id") % 2 == 0)
        .select(F.concat(F.lit("U"), F.col("user_id")).alias("ticker")).distinct()
    )


view("v_changes", """
SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'signup' THEN 'added' ELSE 'removed' END AS action,
       'U' || user_id AS ticker
FROM events WHERE event_type IN ('signup', 'error')""")
view("v_members", "SELECT DISTINCT 'U' || user_id AS ticker FROM events WHERE user_id % 2 = 0")


def order_book(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("date"),
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("captured_at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("bid_price"),
        (F.col("value") + (F.pmod(k, F.lit(7)) - 1) / F.lit(10.0)).alias("ask_price"),
        k.cast("double").alias("bid_size"),
        (F.col("event_id") % 50).cast("double").alias("ask_size"),
    )


view("v_order_book", """
SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS ticker, ts AS captured_at, event_id AS seq, value AS bid_price,
       value + (k % 7 - 1) / 10.0::DOUBLE AS ask_price, CAST(k AS DOUBLE) AS bid_size, CAST(event_id % 50 AS DOUBLE) AS ask_size
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")


def security_master(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date")
    )
    return c.join(o, c.c_custkey == o.o_custkey).select(
        F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("security_id"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("start_date")).alias("start_date"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("end_date")).alias("end_date"),
    )


view("v_securities", """
SELECT c_mktsegment AS ticker, c_custkey AS security_id,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE a END AS start_date,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE b END AS end_date
FROM customer JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b
                    FROM orders GROUP BY 1) ON c_custkey = o_custkey""")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Landed articles; about one in twelve lacks an id, and one in nine a source."""
    d = table(spark, sf, "documents")
    sym = F.array(
        F.concat(F.lit("S"), F.col("doc_id") % N_NEWS_TICKERS),
        F.concat(F.lit("S"), (F.col("doc_id") * 7) % N_NEWS_TICKERS),
    )
    return d.select(
        F.when(F.col("doc_id") % 12 == 5, F.lit(None)).otherwise(F.concat(F.lit("d"), F.col("doc_id"))).alias("id"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.lit(None).cast("string").alias("summary"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 9 == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id")).alias("url"),
        F.timestamp_seconds(F.lit(946857600) + F.col("doc_id") * 3600).alias("published_at"),
        sym.alias("symbols"),
    )


view("v_articles", f"""
SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN NULL ELSE 'd' || doc_id END AS id, split_part(text, chr(10), 1) AS headline,
       text AS content, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE source END AS source,
       'https://example.com/' || doc_id AS url, TIMESTAMP '2000-01-03 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS published_at,
       'S' || (doc_id % {N_NEWS_TICKERS}) AS sym_a, 'S' || ((doc_id * 7) % {N_NEWS_TICKERS}) AS sym_b
FROM documents""")


def _published() -> Column:
    """Hour of a conversation: 25 of them a day, so days grow with the table."""
    c = F.col("conv_id")
    return F.timestamp_seconds(F.lit(946857600) + (F.floor(c / 25) * 24 + c % 24) * 3600)


def _news_ticker(letter: str) -> Column:
    """Five tickers for every thousand conversations."""
    return F.concat(F.lit(letter), F.col("conv_id") % 5 + F.floor(F.col("conv_id") / 1000) * 5)


def scored_news(spark: SparkSession, sf: str) -> DataFrame:
    """Scored sentence rows from conversation turns: turn = sentence, conversation = article.

    Probabilities come from exact ratios of integer ids, so both engines see equal inputs.
    """
    c = table(spark, sf, "conversations")
    n = F.length("text")
    a, b = n % 17, n % 13
    total = (a + b + 4).cast("double")
    return c.select(
        F.to_date(_published()).alias("date"),
        _news_ticker("S").alias("ticker"),
        F.when(F.col("conv_id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("conv_id"))).alias("article_id"),
        F.col("turn").cast("int").alias("sentence_index"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.when(F.col("conv_id") % 8 == 3, F.lit(None))
        .when(F.col("conv_id") % 8 == 5, F.lit("  Dow   Jones "))
        .when(F.col("conv_id") % 8 == 6, F.lit("Reuters"))
        .otherwise(F.lit("SEC")).alias("source"),
        _published().alias("published_at"),
        "text",
        (a / total).alias("positive"),
        (b / total).alias("negative"),
        (4 / total).alias("neutral"),
        (a / total - b / total).alias("score"),
        F.when(n % 7 == 0, F.lit(None)).otherwise((n % 11 - 1) / F.lit(10.0)).alias("relevance_score"),
    )


view("v_scored", """
SELECT CAST(published_at AS DATE) AS date, 'S' || (conv_id % 5 + conv_id // 1000 * 5) AS ticker,
       CASE WHEN conv_id % 10 = 7 THEN NULL ELSE 'c' || conv_id END AS article_id,
       CAST(turn AS INTEGER) AS sentence_index, CAST(turn AS INTEGER) AS chunk_index,
       CASE WHEN conv_id % 8 = 3 THEN NULL WHEN conv_id % 8 = 5 THEN '  Dow   Jones ' WHEN conv_id % 8 = 6 THEN 'Reuters' ELSE 'SEC' END AS source,
       published_at, text, a / total AS positive, b / total AS negative, 4 / total AS neutral, a / total - b / total AS score,
       CASE WHEN n % 7 = 0 THEN NULL ELSE (n % 11 - 1) / 10.0::DOUBLE END AS relevance_score
FROM (SELECT *, n % 17 AS a, n % 13 AS b, CAST(n % 17 + n % 13 + 4 AS DOUBLE) AS total,
             TIMESTAMP '2000-01-03 00:00:00' + to_hours(CAST(conv_id // 25 * 24 + conv_id % 24 AS INTEGER)) AS published_at
      FROM (SELECT *, length(text) AS n FROM conversations))""")


def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Topic label per scored article; one label row per distinct (date, ticker, article), outlier -1."""
    c = table(spark, sf, "conversations").where((F.col("conv_id") % 10 != 7) & (F.col("conv_id") % 4 != 1)).select("conv_id").distinct()
    label = F.col("conv_id") % 6
    return c.select(
        F.to_date(_published()).alias("date"),
        _news_ticker("s").alias("ticker"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("article_id"),
        F.when(label == 0, -1).otherwise(label).cast("int").alias("topic_id"),
        ((F.col("conv_id") % 9 + 1) / F.lit(10.0)).alias("topic_probability"),
    )


view("v_topics", """
SELECT CAST(TIMESTAMP '2000-01-03 00:00:00' + to_hours(CAST(conv_id // 25 * 24 + conv_id % 24 AS INTEGER)) AS DATE) AS date,
       'S' || (conv_id % 5 + conv_id // 1000 * 5) AS ticker, 'c' || conv_id AS article_id,
       CAST(CASE WHEN conv_id % 6 = 0 THEN -1 ELSE conv_id % 6 END AS INTEGER) AS topic_id,
       (conv_id % 9 + 1) / 10.0::DOUBLE AS topic_probability
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 7 AND conv_id % 4 <> 1)""")


def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate decision per scored sentence, missing for some; some sentences carry two rows."""
    c = table(spark, sf, "conversations").where((F.col("conv_id") % 10 != 7) & (F.length("text") % 5 != 2))
    n = F.length("text")
    return c.select(
        F.to_date(_published()).alias("date"),
        _news_ticker("S").alias("ticker"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("article_id"),
        F.col("turn").cast("int").alias("sentence_index"),
        F.when(F.col("turn") % 3 == 2, F.lit(None)).otherwise(F.col("turn").cast("int")).alias("chunk_index"),
        F.when(n % 3 == 0, "accepted").when(n % 3 == 1, "borderline").otherwise("rejected").alias("relevance_decision"),
        F.array(
            F.when(n % 2 == 0, "direct_ticker_mention").otherwise("source_ticker_tag_only"),
            F.when(n % 3 == 2, "rejected_by_relevance_gate").otherwise("topic_probability_supported"),
        ).alias("reason_codes"),
        n.alias("seq"),
    )


view("v_gate", """
SELECT CAST(TIMESTAMP '2000-01-03 00:00:00' + to_hours(CAST(conv_id // 25 * 24 + conv_id % 24 AS INTEGER)) AS DATE) AS date,
       'S' || (conv_id % 5 + conv_id // 1000 * 5) AS ticker, 'c' || conv_id AS article_id, CAST(turn AS INTEGER) AS sentence_index,
       CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(turn AS INTEGER) END AS chunk_index,
       CASE WHEN n % 3 = 0 THEN 'accepted' WHEN n % 3 = 1 THEN 'borderline' ELSE 'rejected' END AS relevance_decision,
       [CASE WHEN n % 2 = 0 THEN 'direct_ticker_mention' ELSE 'source_ticker_tag_only' END,
        CASE WHEN n % 3 = 2 THEN 'rejected_by_relevance_gate' ELSE 'topic_probability_supported' END] AS reason_codes, n AS seq
FROM (SELECT *, length(text) AS n FROM conversations) WHERE conv_id % 10 <> 7 AND n % 5 <> 2""")


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as position proposals of a customer's portfolio."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("portfolio"),
        F.col("o_orderkey").alias("proposal_id"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") / 100).alias("target_dollars"),
        ((F.col("o_totalprice") - 250000) / 100).alias("change_dollars"),
        F.col("o_orderpriority").alias("sector"),
        (F.col("c_acctbal") * 10).alias("equity"),
        F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise((F.col("o_orderkey") % 500) * 1000.0).alias("adv_dollars"),
    )


view("v_proposals", """
SELECT o_custkey AS portfolio, o_orderkey AS proposal_id, CAST(o_orderdate AS DATE) AS date, o_totalprice / 100 AS target_dollars,
       (o_totalprice - 250000) / 100 AS change_dollars, o_orderpriority AS sector, c_acctbal * 10 AS equity,
       CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 500) * 1000.0::DOUBLE END AS adv_dollars
FROM orders JOIN customer ON o_custkey = c_custkey""")
