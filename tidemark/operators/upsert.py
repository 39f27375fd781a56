"""Set operations, de-duplication and upserts.

Keys are combined by min/max aggregates, which reduce map-side; a key with many
copies never gathers in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import first_per_key, latest_per_key


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def presence(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, tagged missing or unexpected.

    Both sides meet in one aggregate. Key lists compress to so few bytes that an anti join of them turns into a broadcast,
    whose rows the driver has to hold.
    """
    sides = expected.select(*keys, F.lit(True).alias("_e"), F.lit(False).alias("_a")).unionByName(actual.select(*keys, F.lit(False).alias("_e"), F.lit(True).alias("_a")))
    seen = sides.groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    # a key with a null equals no other, so each side that has it has it alone
    alone = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    status = [F.when(F.col("_e") & (~F.col("_a") | alone), "missing"), F.when(F.col("_a") & (~F.col("_e") | alone), "unexpected")]
    return seen.select(*keys, F.explode(F.array_compact(F.array(*status))).alias("status"))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """S3: keys on both sides whose `column` differs."""
    l, r = left.select(*keys, F.col(column).alias("left_value")), right.select(*keys, F.col(column).alias("right_value"))
    return l.join(r, keys).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows replace existing ones of the same key; `order` breaks ties inside a side."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_side")]
    if not order:
        # without a struct, numbers are combined by hash; the columns of a row stay together, as one order picks them all
        return both.groupBy(*keys).agg(*[F.max_by(c, "_side").alias(c) for c in values])
    return latest_per_key(both, keys, [F.col("_side"), *(order or [])], keep=values)


def unchanged_keys(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups whose whole history is equal on both sides, compared by row digests."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        cols = sorted(c for c in df.columns if c != group)
        row = F.xxhash64(*[F.col(c) for c in cols])
        # a count and two independent sums identify the row set without ordering it
        other = F.xxhash64(F.lit(7), *[F.col(c) for c in cols])
        mix = lambda h: F.sum(h.cast("decimal(20,0)"))
        return df.groupBy(group).agg(F.struct(F.count(F.lit(1)), mix(row), mix(other)).alias(name))
    j = digest(old, "_a").join(digest(new, "_b"), group, "full")
    return j.select(group, F.col("_a").eqNullSafe(F.col("_b")).alias("unchanged"))


def article_key() -> Column:
    """Id, else url, else the content fields."""
    return F.coalesce("id", "url", F.concat_ws("|", F.coalesce("headline", F.lit("")), F.col("published_at").cast("string"), F.coalesce("content", F.lit(""))))


def dedupe_articles(articles: DataFrame, order: list[Column]) -> DataFrame:
    """First article per key in the given arrival order."""
    return first_per_key(articles.withColumn("article_key", article_key()), ["article_key"], order)


def dedupe_payloads(rows: DataFrame, identity: list[str], payload: str, order: list[Column]) -> DataFrame:
    """First row per identity and raw payload; the payload takes part as a 256-bit digest."""
    return first_per_key(rows.withColumn("_payload", F.sha2(F.col(payload), 256)), [*identity, "_payload"], order).drop("_payload")


def merge_layouts(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Identical duplicates collapse; keys with more than one payload are marked."""
    per = rows.groupBy(*keys, payload).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*keys).agg(F.sum("_c").alias("copies"), F.count(F.lit(1)).alias("payloads"), F.min(payload).alias(payload)).withColumn(
        "conflict", F.col("payloads") > 1)


def reconcile_duplicates(legacy: DataFrame, current: DataFrame, start: str, end: str) -> DataFrame:
    """Per ticker, whether the current archive covers the legacy one inside the range."""
    rng = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    l, c = legacy.where(rng).select("ticker", "date").distinct(), current.where(rng).select("ticker", "date").distinct()
    gone = l.join(c, ["ticker", "date"], "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("missing_dates"), F.min("date").alias("first_missing"))
    counts = l.groupBy("ticker").agg(F.count(F.lit(1)).alias("legacy_rows"))
    have = c.groupBy("ticker").agg(F.count(F.lit(1)).alias("current_rows"))
    df = counts.join(have, "ticker", "left").join(gone, "ticker", "left").na.fill(0, ["current_rows", "missing_dates"])
    status = F.when(F.col("current_rows") == 0, "missing").when(F.col("missing_dates") > 0, "insufficient").otherwise("verified")
    return df.withColumn("status", status)


def security_identities(master: DataFrame, tickers: DataFrame) -> DataFrame:
    """Distinct security rows of the tickers with their stable id."""
    def clean(c: str, blank: str) -> Column:
        return F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(blank)))), r"[^A-Z0-9.-]+", "-"), F.lit("-"))
    perma = F.when(F.trim("perma_ticker") != "", clean("perma_ticker", ""))
    ident = F.coalesce(perma, F.concat_ws("_", clean("ticker", ""), clean("start_date", "unknown-start"), clean("end_date", "active")))
    rows = master.join(tickers.select("ticker").distinct(), "ticker", "left_semi").withColumn("stable_id", ident)
    return rows.select("stable_id", "ticker", "start_date", "end_date").distinct()
