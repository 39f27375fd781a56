"""Vendor payloads as landed rows -> typed rows, one DataFrame step per format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import clean_ticker

# Accepted names per filing field, tried in order.
FILING_NAMES = {
    "ticker": ["ticker", "Ticker", "symbol", "Symbol"],
    "report_date": ["reportDate", "Report Date", "periodEndDate", "period_end_date"],
    "availability_date": ["publishDate", "Publish Date", "filingDate", "Filing Date", "filing_date", "asOfDate", "as_of_date"],
    "statement": ["statement", "Statement"],
    "fiscal_year": ["fiscalYear", "Fiscal Year"],
    "fiscal_period": ["fiscalPeriod", "Fiscal Period"],
    "currency": ["currency", "Currency"],
    "earnings_date": ["earningsDate", "earnings_date"],
    "announcement_date": ["announcementDate", "announcement_date"],
}

# Forms taken from the regulator's facts.
FACT_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F"]
# Fixed values: (field, taxonomy, concept, unit kind); earlier entries win per field.
FACT_CONCEPTS = [
    ("Revenue", "us-gaap", "Revenues", "currency"),
    ("Revenue", "us-gaap", "SalesRevenueNet", "currency"),
    ("Revenue", "us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "currency"),
    ("Net Income", "us-gaap", "NetIncomeLoss", "currency"),
    ("Net Income Available to Common Shareholders", "us-gaap", "NetIncomeLossAvailableToCommonStockholdersBasic", "currency"),
    ("Gross Profit", "us-gaap", "GrossProfit", "currency"),
    ("totalAssets", "us-gaap", "Assets", "currency"),
    ("totalLiabilities", "us-gaap", "Liabilities", "currency"),
    ("stockholdersEquity", "us-gaap", "StockholdersEquity", "currency"),
    ("stockholdersEquity", "us-gaap", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "currency"),
    ("operatingIncome", "us-gaap", "OperatingIncomeLoss", "currency"),
    ("interestExpense", "us-gaap", "InterestExpense", "currency"),
    ("interestExpense", "us-gaap", "InterestExpenseNonoperating", "currency"),
    ("sharesBasic", "dei", "EntityCommonStockSharesOutstanding", "shares"),
    ("sharesBasic", "us-gaap", "CommonStockSharesOutstanding", "shares"),
    ("sharesBasic", "us-gaap", "WeightedAverageNumberOfSharesOutstandingBasic", "shares"),
    ("epsBasic", "us-gaap", "EarningsPerShareBasic", "per_share"),
    ("epsDiluted", "us-gaap", "EarningsPerShareDiluted", "per_share"),
]


def adjusted_price_rows(raw: DataFrame) -> DataFrame:
    """prefer adjusted open/high/low, close = adjusted close; feed the result to the bar contract."""
    adj = F.col("adjClose")
    return raw.select(
        F.substring_index(F.trim("date"), "T", 1).alias("date"), "ticker",
        F.coalesce("adjOpen", "open").alias("open"), F.coalesce("adjHigh", "high").alias("high"), F.coalesce("adjLow", "low").alias("low"),
        adj.alias("close"), F.col("volume").cast("double").alias("volume"), adj.alias("adj_close"), (adj * F.col("volume")).alias("dollar_volume"))


NESTED_BARS = "struct<bars:map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double,n:bigint,vw:double>>>>"


def nested_bar_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{"bars": {symbol: [bar, ...]}} -> flat raw bars, priced by vwap where given."""
    p = payloads.select(F.from_json(column, NESTED_BARS).alias("p"))
    b = p.select(F.explode("p.bars").alias("sym", "rows")).select(clean_ticker("sym").alias("ticker"), F.explode("rows").alias("r"))
    return b.select(
        F.substring_index("r.t", "T", 1).alias("date"), "ticker", F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"),
        F.col("r.c").alias("close"), F.col("r.v").alias("volume"), F.col("r.c").alias("adj_close"),
        (F.coalesce("r.vw", "r.c") * F.col("r.v")).alias("dollar_volume"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def observation_rows(raw: DataFrame) -> DataFrame:
    """F8: text observations; '.' and blank mean missing, other text is rejected."""
    text = F.trim("value")
    value = F.when(~text.isin("", "."), text.try_cast("double"))
    reason = (
        F.when(F.col("value").isNull(), "missing_value")
        .when(~text.isin("", ".") & value.isNull(), "value_not_numeric")
        .when(F.col("date").try_cast("date").isNull() | F.col("realtime_start").try_cast("date").isNull() | F.col("realtime_end").try_cast("date").isNull(), "bad_date")
    )
    return raw.select(
        F.upper(F.trim("series_id")).alias("series_id"), F.col("date").try_cast("date").alias("observation_date"),
        F.col("realtime_start").try_cast("date").alias("realtime_start"), F.col("realtime_end").try_cast("date").alias("realtime_end"),
        value.alias("value"), value.isNull().alias("is_missing"), reason.alias("reject_reason"))


def compact_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{"columns": [...], "data": [[...], ...]} -> one name -> text map per row."""
    p = payloads.select(F.from_json(column, "struct<columns:array<string>,data:array<array<string>>>").alias("p"))
    r = p.select("p.columns", F.explode("p.data").alias("row"))
    return r.where(F.size("row") == F.size("columns")).select(F.map_from_arrays("columns", "row").alias("raw"))


NESTED_COMPANIES = "array<struct<ticker:string,currency:string,statements:array<struct<statement:string,columns:array<string>,data:array<array<string>>>>>>"


def nested_company_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """companies -> statements -> rows, with ticker, currency and statement carried down where absent."""
    c = payloads.select(F.explode(F.from_json(column, NESTED_COMPANIES)).alias("c"))
    s = c.select("c.ticker", "c.currency", F.explode("c.statements").alias("s"))
    r = s.select("ticker", "currency", "s.statement", "s.columns", F.explode("s.data").alias("row")).where(F.size("row") == F.size("columns"))
    raw = F.map_from_arrays("columns", "row")
    carried = F.map_from_entries(F.array_compact(F.array(
        *[F.when(value.isNotNull() & ~F.array_contains("columns", name), F.struct(F.lit(name).alias("key"), value.alias("value")))
          for name, value in (("ticker", F.col("ticker")), ("currency", F.col("currency")), ("statement", F.lower("statement")))])))
    return r.select(F.map_concat(raw, carried).alias("raw"))


def _first(m: str, names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.trim(F.col(m)[n]) != "", F.trim(F.col(m)[n])) for n in names])


def filing_rows(raw: DataFrame, column: str = "raw") -> DataFrame:
    """first present name per field; availability falls back to the report date."""
    f = {k: _first(column, names) for k, names in FILING_NAMES.items()}
    day = lambda c: F.substring_index(c, "T", 1).try_cast("date")
    report = day(f["report_date"])
    return raw.select(
        clean_ticker(f["ticker"]).alias("ticker"), report.alias("report_date"), F.coalesce(day(f["availability_date"]), report).alias("availability_date"),
        f["statement"].alias("statement"), f["fiscal_year"].try_cast("int").alias("fiscal_year"), f["fiscal_period"].alias("fiscal_period"),
        f["currency"].alias("currency"), day(f["earnings_date"]).alias("earnings_date"), day(f["announcement_date"]).alias("announcement_date"),
        F.to_json(column).alias("raw_json"),
        F.when(f["ticker"].isNull(), "missing_ticker").when(report.isNull(), "missing_report_date").alias("reject_reason"))


FACT = "struct<val:double,end:string,filed:string,form:string,fy:string,fp:string,accn:string>"
FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"


def company_fact_rows(payloads: DataFrame, start: str, end: str, column: str = "payload") -> DataFrame:
    """regulator facts -> one filing row per (filed, end, accession, period, year) with its fields.

    The concept list is a literal map, so the facts meet it without a join; per
    field the earliest listed concept wins by a combining min_by.
    """
    spec = F.create_map(*[x for i, (field, tax, concept, kind) in enumerate(FACT_CONCEPTS)
                          for x in (F.lit(f"{tax}|{concept}"), F.struct(F.lit(i).alias("rank"), F.lit(field).alias("field"), F.lit(kind).alias("kind")))])
    d = payloads.select("ticker", F.from_json(column, FACTS).alias("d"))
    d = d.select("ticker", F.explode("d.facts").alias("tax", "concepts")).select("ticker", "tax", F.explode("concepts").alias("concept", "body"))
    d = d.select("ticker", spec[F.concat_ws("|", "tax", "concept")].alias("spec"), F.explode("body.units").alias("unit", "facts")).where(F.col("spec").isNotNull())
    unit = F.lower(F.trim("unit"))
    fits = (
        F.when(F.col("spec.kind") == "currency", unit == "usd").when(F.col("spec.kind") == "shares", unit == "shares")
        .otherwise(F.contains(unit, F.lit("usd")) & F.contains(unit, F.lit("share")))
    )
    d = d.where(fits).select("ticker", "spec", F.posexplode("facts").alias("pos", "f"))
    form = F.upper(F.trim("f.form"))
    d = d.select(
        "ticker", "spec", "pos", F.substring_index("f.filed", "T", 1).try_cast("date").alias("availability_date"),
        F.substring_index("f.end", "T", 1).try_cast("date").alias("report_date"), form.alias("form"), F.col("f.val").alias("val"),
        F.trim("f.fy").try_cast("int").alias("fiscal_year"), F.when(F.trim("f.fp") != "", F.trim("f.fp")).alias("fiscal_period"), F.trim("f.accn").alias("accn"))
    d = d.where(F.col("form").isin(FACT_FORMS) & F.col("availability_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("report_date").isNotNull())
    accession = F.coalesce(F.when(F.col("accn") != "", F.col("accn")), F.concat_ws("-", "ticker", "availability_date", "report_date", "form"))
    key = ["ticker", "availability_date", "report_date", "accession", "fiscal_period", "fiscal_year"]
    d = d.withColumn("accession", accession)
    per_field = d.groupBy(*key, "spec.field").agg(F.min_by("val", F.struct("spec.rank", "pos")).alias("val"))
    return per_field.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "val"))).alias("fields"))


def rewrite_alias_rows(filings: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """move rows of an alias ticker to the canonical one, in the column and inside the raw object."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    target = m[F.col("ticker")]
    raw = F.transform_values(F.from_json("raw_json", "map<string,string>"),
                             lambda k, v: F.when(k.isin(FILING_NAMES["ticker"]) & target.isNotNull(), target).otherwise(v))
    return filings.withColumn("raw_json", F.to_json(raw)).withColumn("ticker", F.coalesce(target, F.col("ticker")))
