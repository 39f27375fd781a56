"""Daily ingest as Structured Streaming jobs, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.maths import first_per_key
from tidemark.operators.orderbook import spread_columns, valid_preopen
from tidemark.operators.upsert import article_key, upsert
from tidemark.session import cut, path_exists


def upsert_bars(stream: DataFrame, store: str, checkpoint: str, *, grain: str = "day") -> StreamingQuery:
    """ST1: landed bar files replace stored bars of the same (ticker, date).

    A batch touches only the partitions of the dates it brings: those are read,
    merged and rewritten. `grain` sets the partition width: day for a large
    universe, month or quarter for a small one. Replaying a batch after a failure gives the same store. Within
    a batch the row with the largest `arrival` wins.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        part = F.col("date") if grain == "day" else F.trunc("date", grain)
        new = batch.withColumn("date", F.col("date").cast("date")).withColumn("part", part)
        if path_exists(spark, store):
            # the parts of a batch, which the calendar bounds, as a list: the scan then reads their folders only
            parts = [r["part"] for r in new.select("part").distinct().collect()]
            old = spark.read.schema(new.schema).parquet(store).where(F.col("part").isin(parts))
        else:
            old = new.limit(0)
        merged = cut(upsert(old.select(*new.columns), new, ["ticker", "date"], [F.col("arrival")]).select(*new.columns), "merge")
        (merged.hint("rebalance", "part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_articles_stream(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """ST2: first arrival per article key, remembered for `delay` of event time."""
    return stream.withColumn("article_key", article_key()).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["article_key"])


def first_articles(stream: DataFrame, store: str, checkpoint: str, *, delay_days: int = 2) -> StreamingQuery:
    """ST2: first arrival per article key into `store`/kept, rows later than the watermark into `store`/late.

    The watermark of a batch is the latest publication of all earlier batches less the delay. Late rows are kept aside
    whole, so they can be counted and looked at, and don't enter the deduplication. A key is remembered for as long as its
    publication day can still be on time: a batch joins the kept keys of those days only, so what it reads is bounded by
    the delay, not by the archive. Every batch has folders of its own, reads those of smaller numbers and replaces its
    own when it runs again. Rows without a publication time have no place in the order and count as late; of one key's
    rows in a batch the earliest stays, then the smallest values.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn("article_key", article_key()).withColumn("day", F.to_date("published_at")), "arrived")
        mark = None
        if path_exists(spark, f"{store}/marks"):
            mark = spark.read.parquet(f"{store}/marks").where(F.col("batch") < number).agg(F.max("high")).first()[0]
        limit = F.lit(mark).cast("timestamp") - F.make_dt_interval(F.lit(delay_days))
        late = F.col("published_at").isNull() | F.coalesce(F.col("published_at") < limit, F.lit(False))
        values = [c for c in rows.columns if c != "article_key"]
        new = first_per_key(rows.where(~late), ["article_key"], [F.col("published_at"), *[F.col(c).cast("string") for c in values]])
        if path_exists(spark, f"{store}/kept"):
            known = spark.read.parquet(f"{store}/kept").where(F.col("batch") < number)
            known = known if mark is None else known.where(F.col("day") >= F.to_date(limit))
            new = new.join(known.select("article_key"), "article_key", "left_anti")
        for name, part in (("late", rows.where(late).drop("day")), ("kept", new)):
            by = ["batch", "day"] if name == "kept" else ["batch"]
            part.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{store}/{name}")
        # last: a batch counts as read once its mark is there
        rows.agg(F.max("published_at").alias("high")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/marks")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def order_book_stream(stream: DataFrame, delay: str = "1 hour", **open_kw: str) -> DataFrame:
    """ST3: latest pre-open snapshot and row count per (date, ticker), emitted once a day is closed."""
    v = valid_preopen(stream, **open_kw).withWatermark("captured_at", delay)
    g = v.groupBy(F.window("captured_at", "1 day"), "ticker").agg(
        F.max_by(F.struct("bid_price", "ask_price", "bid_size", "ask_size"), F.struct("captured_at", "seq")).alias("q"), F.count(F.lit(1)).alias("l2_snapshot_count"))
    flat = g.select(F.to_date("window.start").alias("date"), "ticker", "q.*", "l2_snapshot_count")
    return flat.select("date", "ticker", *spread_columns(), "l2_snapshot_count")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what has landed into Parquet."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
