"""Column helpers: null-not-NaN arithmetic and full-window rolling aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS_PER_YEAR = 252


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    # NaN sorts above infinity, so one comparison rules out both
    return F.coalesce(F.abs(col(x).cast("double")) < F.lit(float("inf")), F.lit(False))


def finite(x: Column | str) -> Column:
    """NaN and infinities become null."""
    x = col(x).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is zero or either side is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rows(spec: WindowSpec, n: int) -> WindowSpec:
    """The last n rows including the current one."""
    return spec.rowsBetween(-(n - 1), 0)


def full(agg: Column, guard: Column | str, spec: WindowSpec, n: int) -> Column:
    """Windowed `agg` only where the frame holds n non-null values of `guard`."""
    frame = rows(spec, n)
    return F.when(F.count(col(guard)).over(frame) == n, agg.over(frame))


def pct_change(x: Column | str, n: int, spec: WindowSpec) -> Column:
    return safe_div(col(x), F.lag(col(x), n).over(spec)) - F.lit(1.0)


def rolling_corr(x: Column | str, y: Column | str, spec: WindowSpec, n: int) -> Column:
    """Sample correlation over n complete pairs; null on a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    frame = rows(spec, n)
    cov = F.covar_samp(px, py).over(frame)
    sd = F.stddev_samp(px).over(frame) * F.stddev_samp(py).over(frame)
    return F.when(F.count(px).over(frame) == n, safe_div(cov, sd))


def by(*keys: str, order: str | list[str] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    if order is None:
        return spec
    return spec.orderBy(*([order] if isinstance(order, str) else order))


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round every double column, so that sums in another order compare equal."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            r = F.round(F.col(f"`{name}`"), overrides.get(name, digits))
            # no negative zero in results
            out.append(F.when(r == 0.0, F.lit(0.0)).otherwise(r).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the largest `order` tuple.

    max_by combines map-side, so a key that holds a third of the rows costs one
    partial row per input task and never a sorted group.
    """
    values = keep or [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the smallest `order` tuple (partial aggregation as above)."""
    values = keep or [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def warnings_array(*pairs: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))
