"""Exact ranks inside groups.

`with_ranks(..., bounded=True)` is for groups that the calendar or the universe bounds (one date, one sector of a
date): a plain window. Groups without such a bound take the default way, which no single task has to sort: equal
values are counted first (a hot value becomes one row), the counted values are range partitioned by (group, value) and
stored, each range is summed on its own, and ranges are offset by their predecessors. The caller says which it is; the
results are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def value_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per distinct (keys, value): `_n` equal rows, `_less` smaller rows, `_total` rows of the group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # stored with its range number: a range that is computed again must be the same range
    b = cut(counted.repartitionByRange(*keys, value).withColumn("_b", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    # one row per group and range: as many as there are partitions
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_range = b.groupBy(*keys, "_b").agg(F.sum("_n").alias("_rn"))
    offsets = per_range.select(*keys, "_b", F.coalesce(F.sum("_rn").over(outer), F.lit(0)).alias("_off"), F.sum("_rn").over(Window.partitionBy(*keys)).alias("_total"))
    return b.join(offsets, [*keys, "_b"]).select(*keys, value, "_n", (F.col("_in") + F.col("_off")).alias("_less"), "_total")


def _outputs() -> dict[str, Column]:
    return {
        "midrank": F.col("_less") + (F.col("_n") - 1) / 2.0,
        "pct": (F.col("_less") + 1 + (F.col("_n") - 1) / 2.0) / F.col("_total"),
        "ordinal": F.col("_less").cast("bigint"),
        "count": F.col("_total").cast("bigint"),
    }


def with_ranks(df: DataFrame, keys: list[str], value: str, *, bounded: bool = False, **outputs: str) -> DataFrame:
    """Attach ranks by name: midrank (0-based, average ties), pct (average ties / count), ordinal (0-based), count."""
    if bounded:
        # nulls sort last and so don't move the ranks of values
        group = Window.partitionBy(*keys)
        has = F.col(value).isNotNull()
        ranked = df.select("*", F.when(has, F.rank().over(group.orderBy(F.col(value).asc_nulls_last())) - 1).alias("_less"),
                           F.when(has, F.count(F.lit(1)).over(Window.partitionBy(*keys, value))).alias("_n"), F.when(has, F.count(F.col(value)).over(group)).alias("_total"))
    else:
        ranked = df.join(value_positions(df, keys, value), [*keys, value], "left")
    return ranked.select(*df.columns, *[_outputs()[kind].alias(name) for name, kind in outputs.items()])
