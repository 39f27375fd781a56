"""Market regimes: training frame, hidden Markov model per series and fold, checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import is_finite, warnings_array
from tidemark.operators.market import benchmark_regime_inputs

# Model inputs in column order, labels in order of rising mean return.
REGIME_INPUTS = [
    "spy_log_return_1d", "spy_return_5d", "spy_realized_vol_21d", "spy_realized_vol_63d", "spy_vol_ratio_21_63", "spy_drawdown_63d",
    "vix_level", "vix_change_5d", "yield_curve_slope_10y_2y", "yield_curve_slope_10y_3m", "high_yield_spread",
]
REGIME_LABELS = ["bear", "sideways", "bull"]
REGIME_OUTPUT = ["regime_label", "regime_confidence", "regime_prob_bear", "regime_prob_sideways", "regime_prob_bull"]
RETURN_INPUT = "spy_log_return_1d"


@dataclass(frozen=True)
class RegimeParams:
    states: int = 3
    max_iterations: int = 100
    tolerance: float = 1e-4
    variance_floor: float = 1e-4
    smoothing: float = 1e-2
    min_training_rows: int = 30


def training_frame(benchmark: DataFrame, macro_features: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Benchmark inputs beside the macro row of the date, with a completeness flag."""
    df = benchmark_regime_inputs(benchmark, keys=keys).join(macro_features, "date", "left")
    complete = F.lit(True)
    for c in REGIME_INPUTS:
        complete = complete & is_finite(c)
    return df.select(*(keys or []), "date", *REGIME_INPUTS, complete.alias("is_complete"))


def complete_matrix(frame: DataFrame) -> DataFrame:
    return frame.where("is_complete").drop("is_complete")


def null_mask(columns: list[str]) -> Column:
    """Bit per column that is missing; the first column is the highest bit."""
    k = len(columns)
    out = F.lit(0)
    for i, c in enumerate(columns):
        out = out + F.when(is_finite(c), 0).otherwise(2 ** (k - 1 - i))
    return out


def active_columns(rows: DataFrame, columns: list[str], *, min_rows: int, keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The largest column subset with enough complete rows, by most rows, then column order.

    Rows shrink to counts per missing-value pattern first. Then sums over the lattice of patterns: one pass a column adds
    to each pattern with that column missing the count of the one without, after which a pattern holds the rows that miss
    nothing outside it, that is, those complete in all other columns. That is k passes over at most 2**k counters per
    key, all in one stage, as keys are dealt once: to `tasks`, where many keys make the few patterns many counters. Falls back to the subset with the most rows (the first usable column
    on a tie with it).
    """
    keys = keys or []
    k = len(columns)
    every = 2**k - 1
    dealt = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    sums = rows.groupBy(*dealt, null_mask(columns).alias("mask")).agg(F.count(F.lit(1)).alias("n")).repartition(*[tasks] if tasks else [], *dealt)
    for i in range(k):
        bit = 1 << i
        both = F.when(F.col("mask").bitwiseAND(bit) == 0, F.array("mask", F.col("mask").bitwiseOR(bit))).otherwise(F.array("mask"))
        sums = sums.select(*dealt, F.explode(both).alias("mask"), "n").groupBy(*dealt, "mask").agg(F.sum("n").alias("n"))
    ok = sums.select(*dealt, (F.lit(every) - F.col("mask")).alias("subset"), F.col("n").alias("complete_rows")).where("subset > 0")
    size = F.bit_count("subset")
    # columns without any value never appear in a complete pattern, hence not in `ok`
    best = ok.groupBy(*dealt).agg(
        F.max_by(F.struct("subset", "complete_rows"), F.when(F.col("complete_rows") >= min_rows, F.struct(size.alias("s"), "complete_rows", "subset"))).alias("good"),
        F.max_by(F.struct("subset", "complete_rows"), F.struct("complete_rows", size.alias("s"), "subset")).alias("most"),
        F.max_by(F.struct("subset", "complete_rows"), F.when(size == 1, F.col("subset"))).alias("first"),
    )
    fallback = F.when(F.col("first.complete_rows") == F.col("most.complete_rows"), F.col("first")).otherwise(F.col("most"))
    pick = F.coalesce(F.when(F.col("good.complete_rows") >= min_rows, F.col("good")), fallback)
    names = F.array_compact(F.array(*[F.when(F.col("p.subset").bitwiseAND(F.lit(2 ** (k - 1 - i))) != 0, F.lit(c)) for i, c in enumerate(columns)]))
    return best.select(*keys, pick.alias("p")).select(*keys, names.alias("columns"), F.col("p.complete_rows").alias("complete_rows"))


def readiness(frame: DataFrame, train_end: str, *, train_start: str | None = None, min_rows: int = 30, columns: list[str] | None = None) -> DataFrame:
    """One row per training window: rows, complete rows, kept and dropped columns."""
    columns = columns or REGIME_INPUTS
    rows = frame.where(F.col("date") < F.lit(train_end).cast("date"))
    if train_start:
        rows = rows.where(F.col("date") >= F.lit(train_start).cast("date"))
    a = active_columns(rows, columns, min_rows=min_rows).withColumn("_j", F.lit(0))
    n = rows.agg(F.count(F.lit(1)).alias("training_rows")).withColumn("_j", F.lit(0))
    return n.join(a, "_j", "left").select("training_rows", F.coalesce("complete_rows", F.lit(0)).alias("complete_rows"), "columns",
                                          F.array_except(F.array(*[F.lit(c) for c in columns]), F.coalesce("columns", F.array().cast("array<string>"))).alias("dropped"),
                                          (F.coalesce("complete_rows", F.lit(0)) >= min_rows).alias("ready"))


def inference_gaps(frame: DataFrame, train_end: str, columns: list[str]) -> DataFrame:
    """Missing columns per date after the window."""
    gaps = F.array_compact(F.array(*[F.when(~is_finite(c), F.lit(c)) for c in columns]))
    out = frame.where(F.col("date") > F.lit(train_end).cast("date")).select("date", gaps.alias("missing_columns"))
    return out.withColumn("reason", F.when(F.size("missing_columns") > 0, "incomplete_inputs"))


# ---- model: numpy inside one (series, fold) group --------------------------------


def _members(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means as a 0/1 matrix (rows x clusters), seeded at evenly spaced ranks of the first column.

    Squared distances are compared without the rows' own norms, which are the same for every centre.
    """
    n = len(x)
    by_rank = x[:, 0].argsort()
    centres = x[by_rank[[i * (n - 1) // max(k - 1, 1) for i in range(k)]]]
    chosen = None
    for _ in range(rounds):
        gap = np.square(centres).sum(1) - 2 * x @ centres.T
        one = np.eye(k)[gap.argmin(1)]
        if chosen is not None and (one == chosen).all():
            break
        chosen, size = one, one.sum(0)[:, None]
        centres = np.where(size > 0, one.T @ x / np.maximum(size, 1), centres)
    return chosen


def _density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-row state densities scaled by the row's best state, and the log of that scale."""
    v = np.maximum(var, 1e-12)
    logp = -0.5 * (np.log(2 * np.pi * v).sum(1) + (np.square(x[:, None, :] - mean) / v).sum(2))
    top = logp.max(1)
    return np.exp(logp - top[:, None]), top


def _smooth(b: np.ndarray, top: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Scaled forward-backward: state posteriors, expected moves and the log likelihood."""
    n, k = b.shape
    a, c, z = np.empty((n, k)), np.empty(n), np.empty((n, k))
    row = start * b[0]
    for t in range(n):
        if t:
            row = (a[t - 1] @ move) * b[t]
        c[t] = row.sum()
        a[t] = row / c[t]
    z[-1] = 1.0
    for t in range(n - 2, -1, -1):
        z[t] = move @ (b[t + 1] * z[t + 1]) / c[t + 1]
    moves = move * (a[:-1].T @ (b[1:] * z[1:] / c[1:, None]))
    g = a * z
    return g / g.sum(1, keepdims=True), moves, float(np.log(c).sum() + top.sum())


def _maximise(x: np.ndarray, g: np.ndarray, moves: np.ndarray, mean: np.ndarray, var: np.ndarray, p: RegimeParams) -> tuple[np.ndarray, ...]:
    """Chain parameters from state weights `g` and expected moves; a state without weight keeps its mean and variance."""
    start, move = g[0] + p.smoothing, moves + p.smoothing
    weight = g.sum(0)
    live = (weight > p.variance_floor)[:, None]
    share = g / np.where(live.T, weight, 1.0)
    mean = np.where(live, share.T @ x, mean)
    spread = np.einsum("ns,nsd->sd", share, np.square(x[:, None, :] - mean))
    var = np.where(live, np.maximum(spread, p.variance_floor), var)
    return start / start.sum(), move / move.sum(1, keepdims=True), mean, var


def fit_hmm(x: np.ndarray, p: RegimeParams = RegimeParams()) -> dict:
    """Diagonal-Gaussian chain by expectation maximisation; the k-means clusters are its first, hard expectation."""
    g = _members(x, p.states)
    whole = np.ones((p.states, 1))
    model = _maximise(x, g, g[:-1].T @ g[1:], whole * x.mean(0), whole * (x.var(0) + p.variance_floor), p)
    last = -np.inf
    for _ in range(p.max_iterations):
        start, move, mean, var = model
        g, moves, ll = _smooth(*_density(x, mean, var), start, move)
        model = _maximise(x, g, moves, mean, var, p)
        if abs(ll - last) <= p.tolerance:
            break
        last = ll
    return dict(zip(("start", "move", "mean", "var"), model), log_likelihood=ll)


def _usable_columns(ok: np.ndarray, min_rows: int) -> list[int]:
    """Column choice of A30 on one group's finite-value matrix, by missing-value patterns."""
    k = ok.shape[1]
    bits = 1 << np.arange(k - 1, -1, -1)
    masks, counts = np.unique((~ok) @ bits, return_counts=True)
    subset = np.arange(1, 1 << k)
    rows = np.zeros(len(subset), dtype=int)
    for m, c in zip(masks, counts):
        rows += np.where(subset & m == 0, c, 0)
    size = np.array([int(s).bit_count() for s in subset])
    good = rows >= max(min_rows, 1)
    if good.any():
        pick = max(np.flatnonzero(good), key=lambda i: (size[i], rows[i], subset[i]))
    else:
        usable = [i for i in range(len(subset)) if rows[i] > 0]
        if not usable:
            return []
        first = max((i for i in usable if size[i] == 1), key=lambda i: subset[i])
        most = max(usable, key=lambda i: (rows[i], size[i], subset[i]))
        pick = first if rows[first] == rows[most] else most
    return [i for i in range(k) if subset[pick] >> (k - 1 - i) & 1]


def regime_features(frame: DataFrame, folds: DataFrame, *, params: RegimeParams = RegimeParams(), columns: list[str] | None = None) -> DataFrame:
    """R2: fit and emit per (series, fold): train on dates before train_end, infer on dates after it.

    `frame` has (series, date, inputs); `folds` has (series, fold, train_end). Each
    group is one series' rows, at most one per trading date, so groups are bounded
    by the calendar and many of them run in parallel. Rows without complete inputs
    get nulls, and so does a group that cannot be trained.
    """
    columns = columns or REGIME_INPUTS
    joined = frame.join(folds, "series")
    schema = "series string, fold int, date date, regime_label string, regime_confidence double, regime_prob_bear double, regime_prob_sideways double, regime_prob_bull double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        end = pdf["train_end"].iloc[0]
        x = pdf[columns].to_numpy(dtype=float)
        ok = np.isfinite(x)
        train, infer = (pdf["date"] < end).to_numpy(), (pdf["date"] > end).to_numpy()
        out = pdf.loc[infer, ["series", "fold", "date"]].copy()
        out["regime_label"] = None
        for c in REGIME_OUTPUT[1:]:
            out[c] = np.nan
        cols = _usable_columns(ok[train], params.min_training_rows)
        fit_rows = train & ok[:, cols].all(1)
        use_rows = infer & ok[:, cols].all(1)
        if columns.index(RETURN_INPUT) not in cols or fit_rows.sum() < params.min_training_rows or not use_rows.any():
            return out
        raw = x[fit_rows][:, cols]
        centre, scale = raw.mean(0), raw.std(0)
        scale = np.where(scale <= 0, 1.0, scale)
        m = fit_hmm((raw - centre) / scale, params)
        post, _, _ = _smooth(*_density((x[use_rows][:, cols] - centre) / scale, m["mean"], m["var"]), m["start"], m["move"])
        by_label = post[:, np.argsort(m["mean"][:, cols.index(columns.index(RETURN_INPUT))])]
        at = out.index[ok[infer][:, cols].all(1)]
        best = by_label.argmax(1)
        out.loc[at, "regime_label"] = np.array(REGIME_LABELS, dtype=object)[best]
        out.loc[at, "regime_confidence"] = by_label[np.arange(len(best)), best]
        for i, label in enumerate(REGIME_LABELS):
            out.loc[at, f"regime_prob_{label}"] = by_label[:, i]
        return out

    return joined.groupBy("series", "fold").applyInPandas(run, schema)


def regime_errors(rows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Error codes per regime row; empty for clean and for wholly null rows."""
    p = [F.col(c) for c in REGIME_OUTPUT[2:]]
    label, conf = F.col("regime_label"), F.col("regime_confidence")
    present = sum([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in REGIME_OUTPUT], F.lit(0))
    known = label.isin(REGIME_LABELS)
    own = F.when(label == "bear", p[0]).when(label == "sideways", p[1]).otherwise(p[2])
    top = F.when((p[0] >= p[1]) & (p[0] >= p[2]), "bear").when(p[1] >= p[2], "sideways").otherwise("bull")
    full = warnings_array(
        ((conf < 0) | (conf > 1), "confidence_out_of_range"),
        ((F.least(*p) < 0) | (F.greatest(*p) > 1), "probability_out_of_range"),
        (F.abs(p[0] + p[1] + p[2] - 1.0) > tolerance, "probabilities_do_not_sum_to_one"),
        (label != top, "label_is_not_most_probable"),
        (F.abs(conf - own) > tolerance, "confidence_differs_from_label_probability"))
    none = F.array().cast("array<string>")
    errors = F.when(present == 0, none).when(present != len(REGIME_OUTPUT), F.array(F.lit("partially_populated"))).when(~known, F.array(F.lit("invalid_label"))).otherwise(full)
    return rows.withColumn("errors", errors)


def pad_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Requested dates without a regime row appear with nulls."""
    return dates.select("date").distinct().join(rows, "date", "left")
