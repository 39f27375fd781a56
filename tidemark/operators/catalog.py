"""Feature rules: owner, kind, required, nullable, bounds, allowed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.fundamentals import FUNDAMENTAL_FEATURES
from tidemark.operators.macro import MACRO_FEATURES
from tidemark.operators.market import MARKET_FEATURES
from tidemark.operators.orderbook import ORDER_BOOK_FEATURES
from tidemark.operators.sector import SECTOR_FEATURES

SCHEMA = "feature string, owner string, kind string, required boolean, nullable boolean, minimum double, maximum double, allowed array<string>"


def _rules(names, owner, required, lo=None, hi=None, kind="number", nullable=True, allowed=None):
    return {n: (owner, kind, required, nullable, lo, hi, allowed) for n in names}


# The rule of every feature; a later line overrides an earlier one.
RULES: dict[str, tuple] = {
    **_rules(MARKET_FEATURES, "market", True),
    **_rules(["realized_vol_5d", "realized_vol_21d", "vol_ratio_5_21", "atr_14", "volume_ratio_20"], "market", True, 0.0),
    **_rules(["golden_cross_50_200"], "market", True, 0.0, 1.0),
    **_rules(["rsi_14"], "market", True, 0.0, 100.0),
    **_rules(SECTOR_FEATURES, "sector", True),
    **_rules(["sector_relative_strength"], "sector", True, 0.0, 1.0),
    **_rules(ORDER_BOOK_FEATURES, "order_book", False, 0.0),
    **_rules(["l2_book_imbalance"], "order_book", False, -1.0, 1.0),
    **_rules(FUNDAMENTAL_FEATURES, "fundamentals", True),
    **_rules(["days_to_next_earnings"], "fundamentals", True, 0.0),
    **_rules(["pre_earnings_flag", "post_earnings_flag"], "fundamentals", True, 0.0, 1.0),
    **_rules(MACRO_FEATURES, "macro", True),
    **_rules(["fed_funds_rate", "treasury_3m", "treasury_2y", "treasury_10y", "vix_level", "dollar_index", "cpi_level", "high_yield_spread"], "macro", True, 0.0),
    **_rules(["nlp_sentence_count"], "nlp", False, 0.0),
    **_rules(["nlp_topic_count"], "topics", False, 0.0),
    **_rules(["nlp_dominant_topic_id"], "topics", False),
    **_rules(["nlp_dominant_topic_probability", "nlp_mean_topic_probability"], "topics", False, 0.0, 1.0),
    **_rules(["nlp_sentiment_positive", "nlp_sentiment_negative", "nlp_sentiment_neutral", "nlp_sentiment_strength"], "sentiment", False, 0.0, 1.0),
    **_rules(["nlp_sentiment_score", "nlp_sentiment_topic_score", "nlp_sentiment_dominant_topic_score"], "sentiment", False, -1.0, 1.0),
    **_rules(["nlp_sentiment_std", "nlp_article_count", "nlp_relevance_score", "nlp_source_weight_mean", "nlp_source_weight_sum", "nlp_effective_weight_sum",
              "nlp_sentiment_topic_count", "nlp_relevance_accepted_count", "nlp_relevance_borderline_count", "nlp_missing_source_count",
              "nlp_missing_topic_count", "nlp_missing_relevance_evidence_count"], "sentiment", False, 0.0),
    **_rules(["nlp_sentiment_dominant_topic_id"], "sentiment", False),
    **_rules(["nlp_sentiment_dominant_topic_probability"], "sentiment", False, 0.0, 1.0),
    **_rules(["nlp_topic_sentiment_summary", "nlp_source_weight_summary", "nlp_relevance_reason_codes",
              "nlp_semantic_warning_codes"], "sentiment", False, kind="string"),
    **_rules(["regime_label"], "regime", True, kind="string", nullable=False, allowed=["bear", "sideways", "bull"]),
    **_rules(["regime_confidence", "regime_prob_bear", "regime_prob_sideways", "regime_prob_bull"], "regime", True, 0.0, 1.0),
}


def rules_table(spark: SparkSession, rules: dict[str, tuple] | None = None) -> DataFrame:
    """The rules as a small table, one row per feature."""
    return spark.createDataFrame([(k, *v) for k, v in (RULES if rules is None else rules).items()], SCHEMA)
