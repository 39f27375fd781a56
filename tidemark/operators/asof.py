"""As-of and interval-validity joins built from unions, windows and equi-joins.

The right side is first reduced to one row per (key, day) by a combining
aggregate. After that both sides hold at most one row per key and day, so a hot
key's window is bounded by the calendar whatever the raw row count was.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: list[str],
    left_time: str,
    right_time: str,
    take: list[str],
    strict: bool = False,
    forward: bool = False,
    tie: list[Column] | None = None,
    running_max: list[str] | None = None,
) -> DataFrame:
    """Attach `take` of the nearest right row before (or after) each left row.

    strict       right time < left time instead of <= (forward: > instead of >=)
    tie          order among right rows of one key and time; the largest wins
    running_max  pick the largest tuple of these columns among all visible rows,
                 in place of the row with the latest time

    `left` must hold one row per (on, left_time); reduce it first if it does not.
    """
    if running_max:
        payload = F.struct(*running_max, *[c for c in take if c not in running_max])
        reduced = right.groupBy(*on, right_time).agg(F.max(payload).alias("_p"))
    else:
        payload = F.struct(*take)
        order = F.struct(*(tie or [F.lit(0)]))
        reduced = right.groupBy(*on, right_time).agg(F.max_by(payload, order).alias("_p"))

    # side 0 sorts before side 1 at equal times
    left_side = 0 if strict else 1
    keep = left.columns
    packed = left.select(*on, F.col(left_time).alias("_t"), F.lit(left_side).alias("_s"),
                         F.struct(*[F.col(c) for c in keep]).alias("_l"))
    other = reduced.select(*on, F.col(right_time).alias("_t"), F.lit(1 - left_side).alias("_s"), "_p")
    both = packed.unionByName(other, allowMissingColumns=True)
    order_cols = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_s").asc()]
    w = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    w = w.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max("_p").over(w) if running_max else F.last("_p", ignorenulls=True).over(w)
    return (
        both.select("_l", seen.alias("_p"))
        .where(F.col("_l").isNotNull())
        .select(*[F.col(f"_l.{c}").alias(c) for c in keep], *[F.col(f"_p.{c}").alias(c) for c in take])
    )


@dataclass(frozen=True)
class Look:
    """One right side of `asof_many`: columns (name, output) of its nearest row before or after each left row.

    strict_before / strict_after exclude a row at the same time; of the rows of one key and time the largest `tie` counts.
    """

    right: DataFrame
    time: str
    before: dict[str, str] = field(default_factory=dict)
    after: dict[str, str] = field(default_factory=dict)
    strict_before: bool = False
    strict_after: bool = False
    tie: tuple[str, ...] = ()


def asof_many(left: DataFrame, looks: list[Look], *, on: list[str], left_time: str, tasks: int | None = None) -> DataFrame:
    """Several as-of joins in one pass: all sides meet in one union that is dealt once, by `on`.

    Backward looks share one running window, forward looks another. `left` must hold one row per (on, left_time).
    `tasks` is the number of tasks that the union is dealt to, for a caller who knows how many rows come: adaptive
    execution goes by compressed bytes, and sorted runs of like rows are many to a byte.
    """
    both = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_s"), F.lit(1).alias("_f"), F.struct(*left.columns).alias("_l"))
    for i, k in enumerate(looks):
        names = list(dict.fromkeys([*k.before, *k.after]))
        reduced = k.right.where(F.col(k.time).isNotNull()).groupBy(*on, k.time).agg(F.max_by(F.struct(*names), F.struct(*(k.tie or names))).alias("_p"))
        other = reduced.select(*on, F.col(k.time).alias("_t"), F.lit(2 if k.strict_before else 0).alias("_s"), F.lit(2 if k.strict_after else 0).alias("_f"), F.col("_p").alias(f"_p{i}"))
        both = both.unionByName(other, allowMissingColumns=True)
    if tasks is not None:
        both = both.repartition(tasks, *on)

    def running(*order: Column) -> WindowSpec:
        return Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    back, ahead = running(F.col("_t").asc(), F.col("_s").asc()), running(F.col("_t").desc(), F.col("_f").asc())
    seen = [F.last(f"_p{i}", ignorenulls=True).over(back).alias(f"_b{i}") for i, k in enumerate(looks) if k.before]
    seen += [F.last(f"_p{i}", ignorenulls=True).over(ahead).alias(f"_a{i}") for i, k in enumerate(looks) if k.after]
    out = [F.col(f"_b{i}.{c}").alias(n) for i, k in enumerate(looks) for c, n in k.before.items()] + [F.col(f"_a{i}.{c}").alias(n) for i, k in enumerate(looks) for c, n in k.after.items()]
    return both.select("_l", *seen).where(F.col("_l").isNotNull()).select("_l.*", *out)


_EPOCH = "0001-01-01"
_LEVELS = 22  # 2**22 days hold every date of the type, 0001-01-01 to 9999-12-31


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit(_EPOCH).cast("date"))


def interval_nodes(start: Column, end: Column) -> Column:
    """Dyadic day blocks that exactly tile [start, end]; at most two per level."""
    lo = F.when(start.isNull(), F.lit(0)).otherwise(_day(start))
    hi = F.when(end.isNull(), F.lit(2**_LEVELS - 1)).otherwise(_day(end)) + 1

    def at_level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        a, b = F.ceil(lo / size).cast("int"), F.floor(hi / size).cast("int")
        return F.array(
            F.when((a < b) & (a % 2 == 1), F.struct(k.alias("lvl"), a.alias("blk"))),
            F.when((a < b) & (b % 2 == 1), F.struct(k.alias("lvl"), (b - 1).alias("blk"))),
        )

    return F.array_distinct(F.array_compact(F.flatten(F.transform(_levels(), at_level))))


def _levels() -> Column:
    return F.sequence(F.lit(0), F.lit(_LEVELS))


def date_nodes(d: Column) -> Column:
    """All dyadic blocks that hold the day."""
    day = _day(d)
    return F.transform(_levels(), lambda k: F.struct(k.alias("lvl"), F.floor(day / F.pow(F.lit(2.0), k)).cast("int").alias("blk")))


def active_interval_join(
    left: DataFrame,
    intervals: DataFrame,
    *,
    on: str,
    time: str,
    start: str,
    end: str,
    ident: str,
) -> DataFrame:
    """The interval row active on each date, last by (start, end, ident); else the key's last row.

    Intervals are tiled into dyadic blocks and matched by equality, so a key with
    many intervals costs n log(days), not dates x intervals. Only the largest row
    per block survives the combining aggregate before the join.
    """
    order = F.struct(
        F.coalesce(F.col(start), F.lit("0001-01-01").cast("date")).alias("s"),
        F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("e"),
        F.col(ident).alias("i"),
    )
    iv = intervals.select(on, start, end, order.alias("_o"))
    # of several rows with one start only the longest can win a date it covers
    best = iv.groupBy(on, start).agg(F.max_by(F.struct(end, "_o"), "_o").alias("r")).select(on, start, F.col(f"r.{end}").alias(end), F.col("r._o").alias("_o"))
    blocks = best.select(on, F.explode(interval_nodes(F.col(start), F.col(end))).alias("n"), "_o").groupBy(on, "n").agg(F.max("_o").alias("_o"))
    keys = left.select(on, time).distinct()
    probes = keys.select(on, time, F.explode(date_nodes(F.col(time))).alias("n"))
    hit = probes.join(blocks, [on, "n"]).groupBy(on, time).agg(F.max("_o").alias("_hit"))
    last = iv.groupBy(on).agg(F.max("_o").alias("_last"))
    resolved = keys.join(hit, [on, time], "left").join(last, on, "left").select(
        on, time, F.coalesce(F.col("_hit.i"), F.col("_last.i")).alias(ident), F.col("_hit").isNotNull().alias("active"))
    return left.join(resolved, [on, time], "left")
