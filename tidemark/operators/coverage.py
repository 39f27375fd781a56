"""Coverage, readiness and run summaries of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import finite, safe_div
from tidemark.operators.regime import REGIME_OUTPUT


def adjusted_close_counts(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose adjusted close equals the close within 1e-9, and whether the counts add up."""
    d = F.abs(F.col("close") - F.col("adj_close"))
    g = bars.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("observed_rows"), F.count_if(d <= 1e-9).alias("equal_rows"), F.count_if(d > 1e-9).alias("different_rows"))
    return g.withColumn("consistent", F.col("observed_rows") == F.col("equal_rows") + F.col("different_rows"))


def feature_quality(checked: DataFrame, rules: DataFrame, features: DataFrame) -> DataFrame:
    """Per owner observations, nulls, finite numbers, required nulls and failures over checked long rows.

    A required rule whose column `features` lacks is a required null of every row, and a failure unless it may be null.
    """
    j = checked.join(F.broadcast(rules.select("feature", "required")), "feature", "left")
    null = F.col("number").isNull() & F.col("text").isNull()
    req = F.coalesce("required", F.lit(False))
    seen = j.groupBy(F.coalesce("owner", F.lit("uncataloged")).alias("family")).agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(null).alias("nulls"), F.count_if(finite("number").isNotNull()).alias("finite_numeric"),
        F.count_if(req).alias("required_observations"), F.count_if(req & null).alias("required_nulls"), F.count_if(req & F.col("message").isNotNull()).alias("failures"))
    absent = rules.where("required").where(~F.col("feature").isin(list(features.columns))).withColumn("_j", F.lit(0))
    rows = features.agg(F.count(F.lit(1)).alias("_n")).withColumn("_j", F.lit(0))
    none = F.lit(0).cast("long")
    lost = absent.join(rows, "_j").select(F.col("owner").alias("family"), none.alias("observations"), none.alias("nulls"), none.alias("finite_numeric"), F.col("_n").alias("required_observations"),
                                          F.col("_n").alias("required_nulls"), F.when(F.col("nullable"), none).otherwise(F.col("_n")).alias("failures"))
    totals = [c for c in seen.columns if c != "family"]
    return seen.unionByName(lost).groupBy("family").agg(*[F.sum(c).alias(c) for c in totals])


def acceptance(quality: DataFrame, best: DataFrame, *, feature_rows: DataFrame, missing_keys: DataFrame, prices: DataFrame, min_rows: int = 1, max_null_rate: float = 0.35,
               min_pairs: int = 3, min_score: float = 0.0) -> DataFrame:
    """Acceptance checks, overall verdict and recommendation as one row."""
    j = lambda df: df.withColumn("_j", F.lit(0))
    q = j(quality.agg(safe_div(F.sum("required_nulls"), F.sum("required_observations")).alias("null_rate"), F.sum("failures").alias("failures")))
    b = j(best.agg(F.max("score").alias("score"), F.max_by("label_pairs", "score").alias("pairs")))
    n = j(feature_rows.agg(F.count(F.lit(1)).alias("rows")))
    m = j(missing_keys.agg(F.count(F.lit(1)).alias("missing")))
    p = j(prices.agg(F.count(F.lit(1)).alias("prices")))
    one = q.join(b, "_j").join(n, "_j").join(m, "_j").join(p, "_j")
    false = F.lit(False)
    checks = {
        "has_raw_price_data": F.col("prices") > 0,
        "has_min_feature_rows": F.col("rows") >= min_rows,
        "has_no_missing_date_first_shards": F.col("missing") == 0,
        "required_feature_null_rate_ok": F.coalesce(F.col("null_rate"), F.lit(1.0)) <= max_null_rate,
        "catalog_validation_ok": F.coalesce("failures", F.lit(0)) == 0,
        "has_min_label_pairs": F.coalesce(F.col("pairs") >= min_pairs, false),
        "best_candidate_correlation_ok": F.coalesce(F.col("score") >= min_score, false),
    }
    df = one.select(*[c.alias(k) for k, c in checks.items()])
    ok = F.lit(True)
    for k in checks:
        ok = ok & F.col(k)
    hard = F.col("has_raw_price_data") & F.col("has_no_missing_date_first_shards") & F.col("catalog_validation_ok")
    return df.withColumn("accepted", ok).withColumn("recommendation", F.when(F.col("accepted"), "proceed").when(~hard, "do_not_proceed").otherwise("needs_human_review"))


def coverage_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per (date, ticker) on either side: how often it is there, and present, missing, unexpected or duplicate."""
    keys = ["date", "ticker"]
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    a = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    j = e.join(a, keys, "full_outer")
    n = F.coalesce("row_count", F.lit(0))
    status = F.when(n == 0, "missing").when(F.col("_e").isNull(), "unexpected").when(n > 1, "duplicate").otherwise("present")
    return j.select(*keys, n.alias("row_count"), status.alias("status"))


def _status_counts(rows: DataFrame, key: str) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return rows.groupBy(key).agg(is_("present", "missing", "duplicate").alias("expected"), is_("present", "duplicate").alias("present"), is_("missing").alias("missing"),
                                 is_("unexpected").alias("unexpected"), is_("duplicate").alias("duplicate"), F.sum("row_count").alias("row_count"))


def coverage_by_date(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected, present, missing, unexpected and duplicate tickers per date, with the number of rows."""
    return _status_counts(coverage_rows(expected, actual), "date")


def coverage_by_ticker(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected, present, missing, unexpected and duplicate dates per ticker, with the number of rows."""
    return _status_counts(coverage_rows(expected, actual), "ticker")


def first_names(rows: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """The first n distinct names per key; the rank limit cuts each map task's share to n first."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(name)
    top = rows.select(*keys, name).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("sample"))


def days_present(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Number of expected days and of those present."""
    j = expected.select("date").distinct().join(present.select("date").distinct().withColumn("_p", F.lit(1)), "date", "left")
    return j.agg(F.count(F.lit(1)).alias("expected"), F.count("_p").alias("present"))


def archive_readiness(*, calendar: DataFrame, weekdays: DataFrame, news: DataFrame, universe: DataFrame, macro: DataFrame, tickers: DataFrame, filings: DataFrame, min_filings: int) -> DataFrame:
    """One row of day and ticker coverage with the final flag."""
    tag = lambda df, n: df.select(F.col("expected").alias(f"{n}_expected"), F.col("present").alias(f"{n}_present"), F.lit(0).alias("_j"))
    thin = filings_coverage(tickers, filings, tickers.limit(0), min_rows=min_filings)
    f = tickers.select("ticker").distinct().agg(F.count(F.lit(1)).alias("tickers")).withColumn("_j", F.lit(0)).join(thin.agg(F.count(F.lit(1)).alias("thin_tickers")).withColumn("_j", F.lit(0)), "_j")
    one = tag(days_present(calendar, news), "news").join(tag(days_present(weekdays, universe), "universe"), "_j").join(tag(days_present(weekdays, macro), "macro"), "_j").join(f, "_j").drop("_j")
    ready = (F.col("news_expected") == F.col("news_present")) & (F.col("universe_expected") == F.col("universe_present")) & (F.col("macro_expected") == F.col("macro_present")) & (F.col("thin_tickers") == 0)
    return one.withColumn("ready", ready)


def filings_coverage(tickers: DataFrame, filings: DataFrame, active: DataFrame, *, min_rows: int) -> DataFrame:
    """Tickers with fewer filing rows than required, whether active, and why."""
    c = filings.groupBy("ticker").agg(F.count(F.lit(1)).alias("row_count"))
    j = tickers.select("ticker").distinct().join(c, "ticker", "left").join(active.select("ticker").distinct().withColumn("active", F.lit(True)), "ticker", "left")
    reason = F.when(F.col("row_count").isNull(), "missing_archive").otherwise("below_min_rows")
    return j.select("ticker", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("active", F.lit(False)).alias("active"), reason.alias("reason")).where(F.col("row_count") < min_rows)


def regime_coverage(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Per date full, null and partial regime rows, label counts, extremes and rates."""
    n = sum([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in REGIME_OUTPUT], F.lit(0))
    total = F.col("regime_prob_bear") + F.col("regime_prob_sideways") + F.col("regime_prob_bull")
    j = expected.select("date", "ticker").distinct().join(rows.withColumn("_h", F.lit(1)), ["date", "ticker"], "left").withColumn("_n", n)
    has = F.col("_h").isNotNull()
    label = lambda x: F.count_if(F.coalesce(F.col("regime_label") == x, F.lit(False))).alias(f"{x}_rows")
    g = j.groupBy("date").agg(
        F.count(F.lit(1)).alias("expected_rows"), F.count("_h").alias("present_rows"), F.count_if(has & (F.col("_n") == 5)).alias("full_rows"),
        F.count_if(has & (F.col("_n") == 0)).alias("null_rows"), F.count_if(has & F.col("_n").between(1, 4)).alias("partial_rows"), label("bear"), label("sideways"), label("bull"),
        F.min("regime_confidence").alias("confidence_min"), F.max("regime_confidence").alias("confidence_max"), F.min(total).alias("probability_sum_min"), F.max(total).alias("probability_sum_max"))
    return g.withColumn("coverage_rate", safe_div("full_rows", "expected_rows")).withColumn("explicit_null_rate", safe_div("null_rows", "expected_rows")).withColumn(
        "missing_or_partial_rate", safe_div(F.col("expected_rows") - F.col("full_rows") - F.col("null_rows"), "expected_rows"))


def latest_completed_runs(runs: DataFrame) -> DataFrame:
    """Per (stage, date) the completed run that finished last."""
    done = runs.where(F.col("status") == "completed")
    end = F.coalesce("finished_at", "started_at")
    return done.groupBy("stage", "date").agg(F.max_by("run_id", F.struct(end, F.col("run_id"))).alias("run_id"), F.max(end).alias("finished_at"))


def choose_regime_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Per date the regime row of the completed run that finished last."""
    j = rows.join(runs.where(F.col("status") == "completed").select("run_id", "finished_at"), "run_id")
    return j.groupBy("date").agg(F.max_by(F.struct("run_id", "regime_label"), F.struct("finished_at", "run_id")).alias("r")).select("date", "r.*")


def regime_row_errors(rows: DataFrame, runs: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows that repeat a date in one run, lie outside the requested dates, or inside the training span."""
    j = rows.join(runs.select("run_id", "train_end"), "run_id").join(dates.select("date").distinct().withColumn("_d", F.lit(True)), "date", "left")
    g = j.groupBy("run_id", "date").agg(F.count(F.lit(1)).alias("c"), F.max("train_end").alias("train_end"), F.bool_or(F.col("_d").isNull()).alias("foreign"))
    err = F.array_compact(F.array(F.when(F.col("c") > 1, "duplicate_row"), F.when(F.col("foreign"), "unexpected_date"), F.when(F.col("date") <= F.col("train_end"), "inside_training_span")))
    return g.select("run_id", "date", F.array_join(err, ";").alias("errors")).where(F.col("errors") != "")
