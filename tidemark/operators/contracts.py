"""Row contracts: normalise landed rows and split off the ones that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import is_finite

BAR_FIELDS = ["date", "ticker", "open", "high", "low", "close", "volume", "adj_close", "dollar_volume"]

# Accepted spellings of booleans.
TRUE_TEXT = ["1", "true", "t", "yes", "y"]
FALSE_TEXT = ["0", "false", "f", "no", "n"]

# Symbol aliases that never changed meaning.
TICKER_ALIASES = {
    "BRK.B": "BRK-B",
    "BF.B": "BF-B",
    "FB": "META",
    "WLTW": "WTW",
    "RE": "EG",
    "FLT": "CPAY",
    "CDAY": "DAY",
}
# Symbols whose meaning depends on the date: (symbol, before?, date, id, reason).
DATED_IDENTITIES = [
    ("UA", "before", "2016-04-08", "UAA", "pre_2016_under_armour_class_a_alias"),
    ("Q", "from", "2017-08-29", "IQV", "post_2017_iqvia_alias"),
]


def iso_date(c: Column | str) -> Column:
    """A strict YYYY-MM-DD date, else null."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def clean_ticker(c: Column | str) -> Column:
    text = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(text != "", text)


def check_bars(raw: DataFrame) -> DataFrame:
    """typed bar columns plus `reject_reason`, the first rule a row breaks (null when clean)."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in BAR_FIELDS]
    missing_list = F.array_join(F.array_compact(F.array(*missing)), ",")
    r = F.when(missing_list != "", F.concat(F.lit("missing:"), missing_list))
    r = r.when(iso_date("date").isNull(), "bad_date").when(clean_ticker("ticker").isNull(), "empty_ticker")
    for c in ("open", "high", "low", "close", "adj_close"):
        r = r.when(~is_finite(c), f"{c}_not_finite").when(F.col(c) <= 0, f"{c}_not_positive")
    v = F.col("volume").cast("double")
    r = r.when(~is_finite(v) | (v != F.floor(v)), "volume_not_integral").when(v < 0, "volume_negative")
    r = r.when(~is_finite("dollar_volume"), "dollar_volume_not_finite").when(F.col("dollar_volume") < 0, "dollar_volume_negative")
    r = r.when(F.col("high") < F.col("low"), "high_below_low")
    r = r.when(~F.col("open").between(F.col("low"), F.col("high")), "open_outside_range")
    r = r.when(~F.col("close").between(F.col("low"), F.col("high")), "close_outside_range")
    typed = {"date": iso_date("date"), "ticker": clean_ticker("ticker"), "volume": F.when(is_finite(v), v).try_cast("bigint")}
    return raw.select(*[typed.get(c, F.col(c).cast("double")).alias(c) for c in BAR_FIELDS], r.alias("reject_reason"))


def valid_bars(raw: DataFrame) -> DataFrame:
    return check_bars(raw).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_bars(raw: DataFrame) -> DataFrame:
    return check_bars(raw).where(F.col("reject_reason").isNotNull())


def text_bool(c: Column | str) -> Column:
    """Boolean from its text spellings; null when none matches."""
    t = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when(t.isin(TRUE_TEXT), True).when(t.isin(FALSE_TEXT), False)


UNIVERSE_DEFAULTS = {"tradable": True, "liquid": True, "halted": False, "data_quality_ok": True}


def check_universe(raw: DataFrame) -> DataFrame:
    """typed universe rows plus `reject_reason`."""
    r = F.when(F.col("date").isNull() | F.col("ticker").isNull() | F.col("in_universe").isNull(), "missing_field")
    r = r.when(iso_date("date").isNull(), "bad_date").when(clean_ticker("ticker").isNull(), "empty_ticker")
    flags = []
    for c in ["in_universe", *UNIVERSE_DEFAULTS]:
        present = c in raw.columns
        if present:
            r = r.when(F.col(c).isNotNull() & text_bool(c).isNull(), f"{c}_not_boolean")
        value = text_bool(c) if present else F.lit(None).cast("boolean")
        flags.append((value if c == "in_universe" else F.coalesce(value, F.lit(UNIVERSE_DEFAULTS[c]))).alias(c))
    reason = F.trim("reason") if "reason" in raw.columns else F.lit(None).cast("string")
    return raw.select(iso_date("date").alias("date"), clean_ticker("ticker").alias("ticker"), *flags,
                      F.when(reason != "", reason).alias("reason"), r.alias("reject_reason"))


def eligible() -> Column:
    """in the universe, tradable, liquid, clean and not halted; missing flags take defaults."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(UNIVERSE_DEFAULTS[c]))
    return F.coalesce(F.col("in_universe"), F.lit(False)) & flag("tradable") & flag("liquid") & flag("data_quality_ok") & ~flag("halted")


def normalize_symbol(c: Column | str) -> Column:
    return F.translate(F.upper(F.trim(F.col(c) if isinstance(c, str) else c)), ".", "-")


def canonical_ticker(c: Column | str) -> Column:
    """trimmed, upper, dots to dashes, then the alias table."""
    n = normalize_symbol(c)
    m = F.create_map(*[F.lit(x) for kv in TICKER_ALIASES.items() for x in kv])
    return F.coalesce(m[n], n)


def resolve_identity(df: DataFrame, *, symbol: str = "raw_ticker", date: str = "date") -> DataFrame:
    """dated identity of a change-log symbol with the reason it was chosen; blank symbols drop."""
    n = normalize_symbol(symbol)
    ident, reason = None, None
    for sym, side, cut, target, why in DATED_IDENTITIES:
        d = F.lit(cut).cast("date")
        hit = (n == sym) & ((F.col(date) < d) if side == "before" else (F.col(date) >= d))
        ident = F.when(hit, target) if ident is None else ident.when(hit, target)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    canon = canonical_ticker(symbol)
    return df.where(n != "").select(
        "*", ident.otherwise(canon).alias("ticker"),
        reason.when(canon != n, "conflict_free_current_symbol_alias").otherwise("identity_preserved").alias("reason_code"))


def in_scope(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is requested."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def drop_warmup(df: DataFrame, features: list[str]) -> DataFrame:
    """drop rows where every feature is null."""
    return df.na.drop(how="all", subset=features)
