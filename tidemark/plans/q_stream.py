"""Streaming jobs drained over landed copies of the test tables; results equal the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import rounded
from tidemark.plans import testbed as T
from tidemark.registry import query
from tidemark.session import scratch
from tidemark.streaming import daily as ST


@query("st1_bars_upsert", "SELECT ticker, date, round(CASE WHEN date >= '2000-01-01' THEN close + 1 ELSE close END, 6) AS close FROM v_bars")
def st1(spark, sf):
    """Two landed drops: all bars, then corrected ones from 2000 on."""
    land, store, chk = scratch(spark, "land"), scratch(spark, "store"), scratch(spark, "chk")
    b = T.bars(spark, sf).select("ticker", "date", "close", F.lit(1).alias("arrival"))
    fix = b.where(F.col("date") >= F.lit("2000-01-01").cast("date")).select("ticker", "date", (F.col("close") + 1).alias("close"), F.lit(2).alias("arrival"))
    b.unionByName(fix).write.mode("append").parquet(land)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1000).parquet(land)
    ST.upsert_bars(stream, store, chk, grain="month").awaitTermination()
    return rounded(spark.read.schema(b.schema).parquet(store).select("ticker", "date", "close"))


@query("st2_news_dedupe", "SELECT DISTINCT CASE WHEN doc_id % 12 = 5 THEN 'u' || doc_id ELSE 'd' || doc_id END AS article_key FROM documents")
def st2(spark, sf):
    """Every article lands twice, within the remembered span."""
    land, out, chk = scratch(spark, "land"), scratch(spark, "out"), scratch(spark, "chk")
    a = T.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 12 != 5, F.concat(F.lit("d"), F.col("doc_id"))).alias("id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("source").alias("headline"),
                                               F.col("text").alias("content"), F.timestamp_seconds(F.lit(946857600) + F.col("doc_id") % 24 * 3600).alias("published_at"))
    a.unionByName(a).write.parquet(land)
    stream = spark.readStream.schema(a.schema).parquet(land)
    ST.append_to(ST.dedupe_articles_stream(stream).select("article_key"), out, chk).awaitTermination()
    return spark.read.schema("article_key string").parquet(out)


def _drops(spark, sf):
    """Two landings of articles: days 0 to 9, then days 8 to 12 with copies of earlier ones and rows from before."""
    day = F.col("doc_id") % 10
    d = T.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("source").alias("headline"), F.lit("").alias("content"),
                                               F.timestamp_seconds(F.lit(946857600) + day * 86400).alias("published_at"))
    again = d.where(day >= 8)
    late = d.where(F.col("doc_id") % 10 == 3).withColumn("id", F.concat("id", F.lit("-late")))
    later = d.where(F.col("doc_id") % 4 == 1).withColumn("id", F.concat("id", F.lit("-new"))).withColumn("published_at", F.timestamp_seconds(F.lit(946857600) + (10 + F.col("doc_id") % 3) * 86400))
    return d.drop("doc_id"), again.unionByName(late).unionByName(later).drop("doc_id")


def _landed(spark, sf):
    land, store, chk = (scratch(spark, n) for n in ("land", "articles", "chk"))
    for drop in _drops(spark, sf):
        drop.write.mode("append").parquet(land)
        stream = spark.readStream.schema(drop.schema).parquet(land)
        ST.first_articles(stream, store, chk).awaitTermination()
    return store


@query("st2_first_articles", """
SELECT 'd' || doc_id AS article_key, DATE '2000-01-03' + CAST(doc_id % 10 AS INTEGER) AS day FROM documents
UNION ALL SELECT 'd' || doc_id || '-new', DATE '2000-01-13' + CAST(doc_id % 3 AS INTEGER) FROM documents WHERE doc_id % 4 = 1""")
def st2_kept(spark, sf):
    """Copies inside the delay are dropped, rows past it set aside, new ones kept."""
    return spark.read.parquet(f"{_landed(spark, sf)}/kept").select("article_key", "day")


@query("st2_late_rows", "SELECT 'd' || doc_id || '-late' AS article_key, TIMESTAMP '2000-01-06 00:00:00' AS published_at FROM documents WHERE doc_id % 10 = 3")
def st2_late(spark, sf):
    return spark.read.parquet(f"{_landed(spark, sf)}/late").select("article_key", "published_at")


@query("st3_order_book", """
SELECT date, ticker, round(l2_bid_ask_spread, 6) AS l2_bid_ask_spread, round(l2_quoted_spread_bps, 6) AS l2_quoted_spread_bps, round(l2_book_imbalance, 6) AS l2_book_imbalance, l2_snapshot_count FROM v_book_features WHERE l2_snapshot_count > 0""")
def st3(spark, sf):
    """A last row far in the future closes every real day."""
    land, out, chk = scratch(spark, "land"), scratch(spark, "out"), scratch(spark, "chk")
    b = T.order_book(spark, sf)
    last = b.agg(F.max("date").alias("m")).select(F.date_add("m", 30).alias("date"))
    end = last.select("date", F.lit("END").alias("ticker"), F.col("date").cast("timestamp").alias("captured_at"), F.lit(0).cast("bigint").alias("seq"), *[F.lit(1.0).alias(c) for c in ("bid_price", "ask_price", "bid_size", "ask_size")])
    b.unionByName(end).write.parquet(land)
    stream = spark.readStream.schema(b.schema).parquet(land)
    ST.append_to(ST.order_book_stream(stream), out, chk).awaitTermination()
    schema = "date date, ticker string, l2_bid_ask_spread double, l2_quoted_spread_bps double, l2_book_imbalance double, l2_snapshot_count bigint"
    return rounded(spark.read.schema(schema).parquet(out).where("ticker <> 'END'"))
