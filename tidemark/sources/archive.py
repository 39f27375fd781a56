"""Scans and sinks of the dated archive.

Layout: Parquet (or JSON/CSV where noted) partitioned by date, feature and label
stores by month with files sorted by date, so a date window prunes folders and an
upsert rewrites only those it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.maths import first_per_key, latest_per_key
from tidemark.session import cut, path_exists, scratch  # noqa: F401

MONTH = "month"  # partition column of feature and label stores: the first day of the month

BAR_SCHEMA = ("date date, ticker string, open double, high double, low double, close double, volume bigint, adj_close double, dollar_volume double")
ARTICLE_SCHEMA = ("id string, headline string, summary string, content string, author string, source string, url string, created_at string, updated_at string, "
                  "published_at string, symbols array<string>")
UNIVERSE_SCHEMA = "ticker string, in_universe string, tradable string, liquid string, halted string, data_quality_ok string, reason string, date string"


def _between(start: str | None, end: str | None, column: str = "date") -> Column:
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(column) >= F.lit(start).cast("date"))
    if end:
        cond = cond & (F.col(column) <= F.lit(end).cast("date"))
    return cond


def scan_bars(spark: SparkSession, path: str, *, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """SC1: one row per (ticker, date); of copies the smallest value tuple stays."""
    df = spark.read.parquet(path).where(_between(start, end))
    if tickers:
        df = df.where(F.col("ticker").isin(tickers))
    rest = [c for c in df.columns if c not in ("ticker", "date")]
    return first_per_key(df, ["ticker", "date"], [F.col(c) for c in rest])


def scan_filings(spark: SparkSession, path: str, *, tickers: list[str] | None = None) -> DataFrame:
    """SC2: filings archive, optionally of some tickers; order is given where it matters (availability_date)."""
    df = spark.read.parquet(path)
    return df.where(F.col("ticker").isin(tickers)) if tickers else df


def scan_macro(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """SC3: shards of the window united, snapshot date from the partition where the row has none,
    and one row per identity, the latest retrieval."""
    df = spark.read.parquet(path).where(_between(start, end, "shard_date"))
    own = F.col("snapshot_date") if "snapshot_date" in df.columns else F.lit(None).cast("date")
    df = df.withColumn("snapshot_date", F.coalesce(own, F.col("shard_date"))).drop("shard_date")
    return latest_per_key(df, ["series_id", "observation_date", "realtime_start", "realtime_end"], [F.col("retrieved_at"), F.col("snapshot_date"), F.col("value")])


def scan_order_book(spark: SparkSession, path: str, *, provider: str, date: str) -> DataFrame:
    """SC4: rows of one provider and day; both are partition columns."""
    return spark.read.parquet(path).where((F.col("provider") == provider) & (F.col("date") == F.lit(date).cast("date")))


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """SC5: JSON Lines with a fixed schema; a line that is not an object fails the read."""
    return spark.read.schema(ARTICLE_SCHEMA).option("mode", "FAILFAST").json(path)


def scan_universe(spark: SparkSession, path: str) -> DataFrame:
    """SC6: universe mask text rows; apply the universe contract to type them."""
    return spark.read.schema(UNIVERSE_SCHEMA).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, *, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """SC7: feature rows of the tickers inside the closed date window.

    The window picks month folders; inside them files and row groups are sorted by date, so that their statistics skip
    the other days.
    """
    df = spark.read.parquet(path).where(_between(start, end))
    if start:
        df = df.where(F.col(MONTH) >= F.trunc(F.lit(start).cast("date"), "month"))
    if end:
        df = df.where(F.col(MONTH) <= F.lit(end).cast("date"))
    df = df.drop(MONTH)
    return df.where(F.col("ticker").isin(tickers)) if tickers else df


def missing_tickers(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """SC7: requested tickers with no row."""
    return requested.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")


def evidence_with_fallback(rows: DataFrame, listing: DataFrame, run_id: str, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC8: per date the primary run's rows, else the dated fallback run's; and the dates that fail.

    `listing` has (date, run_id, n_rows) per stored artifact, empty ones included.
    An artifact that exists but is empty still counts as the date's source.
    """
    prio = F.when(F.col("run_id") == run_id, 0).when(F.col("run_id") == F.concat(F.lit(f"{run_id}-"), F.date_format("date", "yyyy-MM-dd")), 1)
    src = listing.withColumn("_p", prio).where(F.col("_p").isNotNull())
    chosen = dates.select("date").distinct().join(src.groupBy("date").agg(F.min_by(F.struct("run_id", "n_rows"), "_p").alias("c")), "date", "left").select(
        "date", F.col("c.run_id").alias("run_id"), F.col("c.n_rows").alias("n_rows"))
    picked = rows.join(chosen.where(F.col("n_rows") > 0).select("date", "run_id"), ["date", "run_id"]).withColumnRenamed("run_id", "source_run")
    problem = F.when(F.col("run_id").isNull(), "missing").when(F.col("n_rows") == 0, "empty")
    return picked, chosen.select("date", problem.alias("problem")).where(F.col("problem").isNotNull())


# ---- sinks ------------------------------------------------------------------


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def write_features(df: DataFrame, path: str) -> None:
    """SK1: upsert by (date, ticker); duplicate keys abort before anything is written.

    The store has a folder a month. Rows are dealt to writers by ranges of dates and sorted, so a month is a few files
    that don't overlap, whatever the number of days; a heavy date is split only between tickers. A write reads and
    rewrites the months it brings and no others; their list, bounded by the calendar, is all that reaches the driver.
    New columns are added to the store, rows without them hold null.
    """
    df = cut(df, "features")
    keys = ["date", "ticker"]
    if not duplicate_rows(df, keys).isEmpty():
        raise ValueError("duplicate (date, ticker) rows")
    new = df.withColumn(MONTH, F.trunc("date", "month"))
    if path_exists(df.sparkSession, path):
        months = [r[0] for r in new.select(MONTH).distinct().collect()]
        old = df.sparkSession.read.parquet(path).where(F.col(MONTH).isin(months))
        # stored before the folders it comes from are replaced
        new = cut(old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True), "merged")
    (new.repartitionByRange("date", "ticker").sortWithinPartitions(MONTH, "date", "ticker").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))


def to_json_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """SK2: feature columns as one JSON text with sorted names; nulls are kept."""
    names = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("features_json"))


def from_json_rows(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """SK2: back to typed columns."""
    return df.select(*keys, F.from_json("features_json", schema).alias("f")).select(*keys, "f.*")


def write_labels(df: DataFrame, path: str) -> None:
    """SK3: label store, same layout and rules as features."""
    write_features(df, path)


def write_universe_masks(df: DataFrame, path: str) -> None:
    """SK4: one CSV folder per date, rows sorted by ticker inside files."""
    cols = ["ticker", "in_universe", "tradable", "liquid", "halted", "data_quality_ok", "reason"]
    (df.select("date", *cols).hint("rebalance", "date").sortWithinPartitions("date", "ticker")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").option("header", True).csv(path))


def changed_masks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """SK4: rows of the dates whose mask differs from the stored one; unchanged dates are skipped."""
    from tidemark.operators.upsert import unchanged_keys
    same = unchanged_keys(stored.select(*new.columns), new, "date").where("unchanged")
    return new.join(same, "date", "left_anti")


def write_articles(df: DataFrame, path: str) -> None:
    """SK5: JSON Lines per publication day, sorted by (published, id) inside files."""
    out = df.withColumn("date", F.to_date("published_at"))
    (out.hint("rebalance", "date").sortWithinPartitions("date", "published_at", "article_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SK6: report rows as JSON Lines or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
