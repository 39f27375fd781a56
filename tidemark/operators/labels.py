"""Forward-return labels and label classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import by, finite, safe_div

HORIZONS = (1, 5, 20)


def forward_return_labels(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Simple and log forward returns with survival flags, one window for all horizons."""
    w = by("ticker", order="date")
    out = []
    for h in horizons:
        ratio = safe_div(F.lead("adj_close", h).over(w), F.col("adj_close"))
        out.append((ratio - 1.0).alias(f"forward_return_{h}d"))
        out.append(F.when(ratio > 0, F.ln(ratio)).alias(f"forward_log_return_{h}d"))
        out.append(F.lead("adj_close", h).over(w).isNotNull().cast("int").alias(f"survives_to_t{h}"))
    return bars.select("date", "ticker", *out)


def return_class(value: Column | str, *, band: float = 0.0025) -> Column:
    """positive above the band, negative below it, else neutral; null when not finite."""
    v = finite(value)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v > band, "positive").when(v < -band, "negative").otherwise("neutral")
    )
