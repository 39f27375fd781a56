"""Filings: period merge, ratios as of each day, shares outstanding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import finite, safe_div
from tidemark.operators.asof import Look, asof_join, asof_many

# Accepted names per field, tried in this order.
FIELD_NAMES = {
    "revenue": ["revenue", "Revenue", "sales", "Sales"],
    "net_income": ["netIncome", "NetIncome", "net_income", "Net Income"],
    "gross_profit": ["grossProfit", "GrossProfit", "gross_profit", "Gross Profit"],
    "eps": ["eps", "EPS", "earningsPerShare", "Earnings Per Share", "epsBasic", "epsDiluted"],
    "eps_estimate": ["epsEstimate", "eps_estimate", "estimatedEps", "consensusEps"],
    "total_assets": ["totalAssets", "TotalAssets", "total_assets", "Total Assets"],
    "total_liabilities": ["totalLiabilities", "TotalLiabilities", "total_liabilities", "Total Liabilities"],
    "total_equity": ["totalEquity", "TotalEquity", "total_equity", "shareholdersEquity", "stockholdersEquity"],
    "total_debt": ["totalDebt", "total_debt", "longTermDebt", "long_term_debt"],
    "ebit": ["ebit", "EBIT", "operatingIncome", "operating_income"],
    "interest_expense": ["interestExpense", "interest_expense", "interestExpenseNet"],
    "shares": ["sharesBasic", "sharesDiluted", "commonSharesOutstanding", "shares_outstanding", "shares"],
    "book_value_ps": ["bookValuePerShare", "book_value_per_share"],
}

FUNDAMENTAL_FEATURES = [
    "pe_ratio", "pb_ratio", "ps_ratio", "net_profit_margin", "return_on_equity", "return_on_assets", "gross_margin",
    "debt_to_equity", "interest_coverage", "revenue_growth_yoy", "earnings_surprise", "days_to_next_earnings",
    "pre_earnings_flag", "post_earnings_flag",
]

PRE_EARNINGS_DAYS = 5
POST_EARNINGS_DAYS = 2

# Share-count names, then numerator / per-share pairs in order.
SHARE_NAMES = ["sharesBasic", "sharesDiluted", "commonSharesOutstanding", "Common Shares Outstanding", "shares_outstanding"]
SHARE_RATIO_PAIRS = [
    (["Net Income Available to Common Shareholders", "netIncomeAvailableToCommonShareholders"],
     ["Earnings Per Share, Basic", "earningsPerShareBasic", "epsBasic"]),
    (["Revenue", "revenue"], ["Sales Per Share", "salesPerShare"]),
    (["Free Cash Flow", "freeCashFlow"], ["Free Cash Flow Per Share", "freeCashFlowPerShare"]),
    (["Equity Before Minority Interest", "Total Equity", "totalEquity", "shareholdersEquity", "stockholdersEquity"],
     ["Equity Per Share", "equityPerShare", "bookValuePerShare"]),
]

PERIOD = ["ticker", "fiscal_year", "fiscal_period", "report_date"]


def raw_map(raw: str = "raw_json") -> Column:
    """The stored JSON object as text values; null when it is not an object."""
    return F.from_json(F.col(raw), "map<string,string>")


def number(m: Column | str, names: list[str], *, thousands: bool = False) -> Column:
    """First finite number under any of the names."""
    m = F.col(m) if isinstance(m, str) else m

    def read(name: Column) -> Column:
        text = F.try_element_at(m, name)
        text = F.regexp_replace(text, ",", "") if thousands else text
        return finite(F.trim(text).try_cast("double"))

    found = F.filter(F.transform(F.array(*[F.lit(n) for n in names]), read), lambda v: v.isNotNull())
    return F.get(found, 0)


def fiscal_periods(filings: DataFrame) -> DataFrame:
    """A4: one row per fiscal period with the latest availability and the merged values.

    Later rows win per value name; the union is built from (period, name) pairs,
    so no map is concatenated and the merge combines map-side. A nameless pair per
    filing carries periods that have no values.
    """
    rows = filings.where(F.col("availability_date").isNotNull())
    nameless = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    pairs = F.coalesce(F.concat(F.map_entries(raw_map()), nameless), nameless)
    entries = rows.select(*PERIOD, "availability_date", F.struct("availability_date", "seq").alias("_o"), F.explode(pairs).alias("e"))
    latest = entries.groupBy(*PERIOD, F.col("e.key").alias("name")).agg(F.max_by("e.value", "_o").alias("text"), F.max("availability_date").alias("_a"))
    named = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "text")))
    merged = latest.groupBy(*PERIOD).agg(F.max("_a").alias("availability_date"), named.alias("_n"))
    return merged.select(*PERIOD, "availability_date", F.when(F.size("_n") > 0, F.map_from_entries("_n")).alias("financials"))


def period_ratios(periods: DataFrame) -> DataFrame:
    """Everything of a period that does not depend on the day's price, with its prior year."""
    p = periods.select(*PERIOD, "availability_date", *[number("financials", names).alias(f) for f, names in FIELD_NAMES.items()])
    year = Window.partitionBy("ticker", "fiscal_period").orderBy("fiscal_year").rangeBetween(-1, -1)
    prior = F.min_by("revenue", F.struct("availability_date", "report_date")).over(year)
    p = p.withColumn("prior_revenue", F.when(F.col("fiscal_year").isNotNull(), prior))
    p = p.withColumn("total_equity", F.coalesce("total_equity", F.col("total_assets") - F.col("total_liabilities")))
    p = p.withColumn("book_value_ps", F.coalesce(F.when(F.col("book_value_ps") != 0, F.col("book_value_ps")), safe_div("total_equity", "shares")))
    growth = F.when(F.col("prior_revenue") != 0, safe_div(F.col("revenue") - F.col("prior_revenue"), F.abs("prior_revenue")))
    surprise = F.when(F.col("eps_estimate") != 0, safe_div(F.col("eps") - F.col("eps_estimate"), F.abs("eps_estimate")))
    return p.select(
        *PERIOD, "availability_date", "revenue", "prior_revenue", "eps", "book_value_ps",
        safe_div("revenue", "shares").alias("revenue_ps"),
        safe_div("net_income", "revenue").alias("net_profit_margin"),
        safe_div("net_income", "total_equity").alias("return_on_equity"),
        safe_div("net_income", "total_assets").alias("return_on_assets"),
        safe_div("gross_profit", "revenue").alias("gross_margin"),
        safe_div(F.coalesce("total_debt", "total_liabilities"), "total_equity").alias("debt_to_equity"),
        safe_div("ebit", "interest_expense").alias("interest_coverage"),
        growth.alias("revenue_growth_yoy"), surprise.alias("earnings_surprise"),
    )


def latest_period_asof(panel: DataFrame, periods: DataFrame, take: list[str], *, strict: bool = True) -> DataFrame:
    """The last period made available strictly before each (ticker, date)."""
    return asof_join(panel, periods, on=["ticker"], left_time="date", right_time="availability_date", take=take, strict=strict,
                     tie=[F.col("report_date"), F.col("fiscal_year"), F.col("fiscal_period")])


def earnings_calendar(panel: DataFrame, filings: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Next earnings date on or after the day, last one before it, and the flags; `tasks` as in `asof_many`."""
    return _earnings_flags(asof_many(panel, [_earnings(filings)], on=["ticker"], left_time="date", tasks=tasks), panel.columns)


def _earnings(filings: DataFrame) -> Look:
    return Look(filings.select("ticker", "earnings_date", F.col("earnings_date").alias("day")), "earnings_date", before={"day": "last_earnings"}, after={"day": "next_earnings"}, strict_before=True)


def _earnings_flags(df: DataFrame, keep: list[str]) -> DataFrame:
    days = F.datediff("next_earnings", "date")
    since = F.datediff("date", "last_earnings")
    return df.select(
        *keep, days.alias("days_to_next_earnings"),
        (days <= PRE_EARNINGS_DAYS).cast("int").alias("pre_earnings_flag"),
        (since <= POST_EARNINGS_DAYS).cast("int").alias("post_earnings_flag"),
    )


def fundamental_features(filings: DataFrame, bars: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """14 fundamentals features per (ticker, date), from filings available before the day.

    Periods and earnings days meet the panel in one union, so the panel moves once; `tasks` as in `asof_many`.
    """
    panel = bars.select("ticker", "date", "adj_close")
    ratios = period_ratios(fiscal_periods(filings))
    take = [c for c in ratios.columns if c not in (*PERIOD, "availability_date", "revenue", "prior_revenue")]
    periods = Look(ratios, "availability_date", before={c: c for c in take}, strict_before=True, tie=("report_date", "fiscal_year", "fiscal_period"))
    df = asof_many(panel, [periods, _earnings(filings)], on=["ticker"], left_time="date", tasks=tasks)
    df = _earnings_flags(df, [*panel.columns, *take])
    return df.select(
        "date", "ticker",
        safe_div("adj_close", "eps").alias("pe_ratio"),
        safe_div("adj_close", "book_value_ps").alias("pb_ratio"),
        safe_div("adj_close", "revenue_ps").alias("ps_ratio"),
        *[c for c in FUNDAMENTAL_FEATURES if c not in ("pe_ratio", "pb_ratio", "ps_ratio")],
    )


def shares_outstanding(filings: DataFrame) -> DataFrame:
    """one positive share count per (ticker, availability_date), the latest report winning."""
    p = fiscal_periods(filings.withColumn("report_date", F.coalesce("report_date", "availability_date")))
    explicit = number("financials", SHARE_NAMES, thousands=True)
    derived = []
    for numerators, per_share in SHARE_RATIO_PAIRS:
        ratio = safe_div(number("financials", numerators, thousands=True), number("financials", per_share, thousands=True))
        derived.append(F.when(ratio > 0, ratio))
    s = F.coalesce(F.when(explicit > 0, explicit), *derived)
    p = p.select("ticker", "availability_date", "report_date", "fiscal_year", "fiscal_period", finite(s).alias("shares_outstanding"))
    return p.where(F.col("shares_outstanding") > 0).groupBy("ticker", "availability_date").agg(
        F.max_by("shares_outstanding", F.struct("report_date", "fiscal_year", "fiscal_period")).alias("shares_outstanding"))


def shares_asof(panel: DataFrame, shares: DataFrame) -> DataFrame:
    """Last share count available on or before the day."""
    return asof_join(panel, shares, on=["ticker"], left_time="date", right_time="availability_date", take=["shares_outstanding"])
