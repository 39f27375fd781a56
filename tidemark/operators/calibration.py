"""Probability of a positive outcome from a raw score, fitted for many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import finite, safe_div
from tidemark.session import cut


def _probability(slope: Column, intercept: Column, x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(slope * x + intercept)))


def fit_calibration(scored: DataFrame, *, keys: list[str], score: str = "return_score", target: str = "target", steps: int = 8, ridge: float = 1e-6) -> DataFrame:
    """M3: (keys, centre, scale, slope, intercept, rows): a logistic curve of target > 0 over the standardised score, per key.

    Newton's method with a fixed number of steps from zero, so that a second engine can repeat it: each step is one
    aggregate of five sums per key, combined map-side, and the solution of two equations. Rows whose score or target is
    null or not finite don't count. A key of equal scores has scale 1 and slope 0; a step whose equations have no solution
    changes nothing.
    """
    rows = scored.select(*keys, finite(score).alias("s"), finite(target).alias("t")).where("s is not null and t is not null").select(*keys, "s", (F.col("t") > 0).cast("double").alias("y"))
    rows = cut(rows, "scores")  # read once a step: keys and two numbers
    spread = F.coalesce(F.stddev_pop("s"), F.lit(0.0))
    model = rows.groupBy(*keys).agg(F.avg("s").alias("centre"), F.when(spread > 0, spread).otherwise(1.0).alias("scale"), F.count(F.lit(1)).alias("rows"))
    model = cut(model.select(*keys, "centre", "scale", F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept"), "rows"), "curves")
    x, y = (F.col("s") - F.col("centre")) / F.col("scale"), F.col("y")
    for _ in range(steps):
        p = _probability(F.col("slope"), F.col("intercept"), x)
        w = p * (1.0 - p)
        sums = rows.join(model.drop("rows"), keys).select(*keys, x.alias("x"), (y - p).alias("e"), w.alias("w")).groupBy(*keys).agg(
            F.sum(F.col("e") * F.col("x")).alias("ex"), F.sum("e").alias("e1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w1"))
        a, b, d = F.col("wxx") + ridge, F.col("wx"), F.col("w1") + ridge
        g, h = F.col("ex") - ridge * F.col("slope"), F.col("e1") - ridge * F.col("intercept")
        det = a * d - b * b
        step = lambda top: F.coalesce(finite(safe_div(top, det)), F.lit(0.0))
        model = cut(model.join(sums, keys).select(*keys, "centre", "scale", (F.col("slope") + step(d * g - b * h)).alias("slope"),
                                                  (F.col("intercept") + step(a * h - b * g)).alias("intercept"), "rows"), "curves")
    return model


def calibrated(scored: DataFrame, model: DataFrame, *, keys: list[str], score: str = "return_score") -> DataFrame:
    """M3: `scored` with `pos_prob`; null without a model for the key or without a finite score."""
    x = (finite(score) - F.col("centre")) / F.col("scale")
    return scored.join(model, keys, "left").select(*scored.columns, _probability(F.col("slope"), F.col("intercept"), x).alias("pos_prob"))
