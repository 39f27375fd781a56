"""Smoothed regime probabilities of stored parameters, for series of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import is_finite
from tidemark.operators.regime import REGIME_LABELS, _density
from tidemark.session import cut

#: What `posteriors` reads of a stored model, beside its series.
PARAMETERS = "start array<double>, move array<array<double>>, mean array<array<double>>, var array<array<double>>"


def _model(row: pd.Series) -> tuple[np.ndarray, ...]:
    return tuple(np.array([np.asarray(v, dtype=float) for v in row[c]], dtype=float) for c in ("start", "move", "mean", "var"))


def _emissions(pdf: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, move, mean, var = _model(pdf.iloc[0])
    return _density(pdf[columns].to_numpy(dtype=float), mean, var)[0], start, move


def posteriors(frame: DataFrame, models: DataFrame, columns: list[str], *, block_days: int = 512) -> DataFrame:
    """R2: (series, date, regime_label, regime_confidence, regime_prob_*) by the forward-backward recursion.

    `models` has one row a series: PARAMETERS of three states, in label order; their density is normal with the given
    diagonal variances over `columns`. Days with an input that is null or not finite, and series without a model, give no
    row; of one series' equal dates the order is that of the inputs.

    The recursion is a product of one 3 x 3 matrix a day, so it is scanned by blocks: every block of days multiplies its
    own matrices (in parallel, whatever series they are of), the blocks' products give the vectors at their borders, and
    every block then smooths its days between its two vectors. A long series is many tasks; what one task gets of all its
    blocks is nine numbers each. Scale is taken out at every product, as only proportions count.
    """
    rows = frame.select("series", "date", *columns)
    for c in columns:
        rows = rows.where(is_finite(c))
    rows = rows.join(models.select("series", "start", "move", "mean", "var"), "series")
    rows = rows.withColumn("block", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / block_days).cast("int"))
    rows = cut(rows, "observations")
    order = ["date", *columns]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b, start, move = _emissions(pdf, columns)
        out = np.diag(b[0])
        for e in b[1:]:
            out = out @ move * e
            out /= out.sum()
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "block": [pdf["block"].iloc[0]], "product": [out.ravel()], "start": [start], "move": [move.ravel()]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = np.asarray(pdf["start"].iloc[0], dtype=float)
        k = len(start)
        move = np.asarray(pdf["move"].iloc[0], dtype=float).reshape(k, k)
        products = [np.asarray(p, dtype=float).reshape(k, k) for p in pdf["product"]]
        enter, leave, row, col = [], [], start, np.ones(k)
        for p in products:
            enter.append(row)
            row = row @ p @ move
            row = row / row.sum()
        for p in reversed(products):
            leave.append(col)
            col = move @ p @ col
            col = col / col.sum()
        return pd.DataFrame({"series": pdf["series"], "block": pdf["block"], "enter": enter, "leave": leave[::-1]})

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b, _, move = _emissions(pdf, columns)
        ahead, back = np.empty_like(b), np.empty_like(b)
        row = np.asarray(pdf["enter"].iloc[0], dtype=float)
        for t, e in enumerate(b):
            ahead[t] = row * e / (row * e).sum()
            row = ahead[t] @ move
        back[-1] = np.asarray(pdf["leave"].iloc[0], dtype=float)
        for t in range(len(b) - 2, -1, -1):
            back[t] = move @ (b[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        p = ahead * back
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        out = pdf[["series", "date"]].copy()
        out["regime_label"] = np.array(REGIME_LABELS, dtype=object)[best]
        out["regime_confidence"] = p[np.arange(len(p)), best]
        for i, label in enumerate(REGIME_LABELS):
            out[f"regime_prob_{label}"] = p[:, i]
        return out

    kind = dict(frame.dtypes)["series"]
    products = rows.groupBy("series", "block").applyInPandas(product, f"series {kind}, block int, product array<double>, start array<double>, move array<double>")
    ends = products.groupBy("series").applyInPandas(borders, f"series {kind}, block int, enter array<double>, leave array<double>")
    labels = ", ".join(f"regime_prob_{x} double" for x in REGIME_LABELS)
    return rows.join(ends, ["series", "block"]).groupBy("series", "block").applyInPandas(smooth, f"series {kind}, date date, regime_label string, regime_confidence double, {labels}")
