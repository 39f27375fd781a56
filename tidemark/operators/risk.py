"""Pre-trade risk rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maths import safe_div


@dataclass(frozen=True)
class RiskLimits:
    max_position_pct: float = 0.10
    min_position_dollars: float = 100.0
    max_gross_exposure: float = 1.0
    max_sector_pct: float = 0.30
    max_adv_participation: float = 0.01


def order_rules(limits: RiskLimits = RiskLimits()) -> Column:
    """K1: names of the per-order rules that fire."""
    size, eq = F.abs("target_dollars"), F.col("equity")
    too_big = F.coalesce(safe_div(size, eq) > limits.max_position_pct, F.lit(False))
    adv = F.coalesce(F.col("adv_dollars"), F.lit(0.0))
    return F.array_compact(F.array(
        F.when(eq <= 0, "no_equity").when(too_big, "max_position_pct"),
        F.when((size > 0) & (size < limits.min_position_dollars), "min_position_dollars"),
        F.when((adv > 0) & (F.abs("change_dollars") > adv * limits.max_adv_participation), "adv_participation_cap")))


def apply_rules(proposals: DataFrame, limits: RiskLimits = RiskLimits(), *, keys: list[str] | None = None, ident: str = "proposal_id") -> DataFrame:
    """K1-K3: one decision per proposal.

    Pass 2 folds each portfolio's survivors of a date from the largest down, because
    an approval changes what fits next. A portfolio proposes a security at most once
    a date, so the universe bounds the array; portfolios and dates run in parallel.
    """
    keys = keys or ["portfolio", "date"]
    p = proposals.withColumn("rules", order_rules(limits))
    rejected = p.where(F.size("rules") > 0)
    alive = p.where(F.size("rules") == 0).drop("rules")
    row = F.struct(F.abs("target_dollars").alias("size"), F.col("equity"), F.when(F.col("sector") != "", F.col("sector")).alias("named"), F.struct(*alive.columns).alias("row"))
    # a group whose whole exposure is below both limits needs no walk: whatever the order, every sum in it is smaller
    share = safe_div(F.sum(F.abs("target_dollars")), F.min("equity"))
    free = (share <= min(limits.max_gross_exposure, limits.max_sector_pct) * (1 - 1e-9)).alias("free")
    ordered = alive.groupBy(*keys).agg(free, F.array_sort(F.collect_list(F.struct((-F.abs("target_dollars")).alias("k"), F.col(ident).alias("i"), row.alias("x")))).alias("l"))

    def step(state: Column, item: Column) -> Column:
        x = item["x"]
        held = F.coalesce(F.try_element_at(state["sectors"], F.coalesce(x["named"], F.lit(""))), F.lit(0.0))
        gross = (state["gross"] + x["size"]) / x["equity"] > limits.max_gross_exposure
        sector = x["named"].isNotNull() & ((held + x["size"]) / x["equity"] > limits.max_sector_pct)
        fired = F.array_compact(F.array(F.when(gross, "max_gross_exposure"), F.when(sector, "max_sector_pct")))
        fits = F.size(fired) == 0
        name = F.coalesce(x["named"], F.lit(""))
        others = F.map_filter(state["sectors"], lambda k, _: k != name)
        return F.struct(
            F.when(fits, state["gross"] + x["size"]).otherwise(state["gross"]).alias("gross"),
            F.when(fits & x["named"].isNotNull(), F.map_concat(others, F.create_map(name, held + x["size"]))).otherwise(state["sectors"]).alias("sectors"),
            F.concat(state["fired"], F.array(fired)).alias("fired"))

    empty = F.struct(F.lit(0.0).alias("gross"), F.create_map().cast("map<string,double>").alias("sectors"), F.array().cast("array<array<string>>").alias("fired"))
    none = F.transform("l", lambda _: F.array().cast("array<string>"))
    fired = F.when(F.col("free"), none).otherwise(F.aggregate("l", empty, step, lambda s: s["fired"]))
    walked = ordered.select(F.explode(F.arrays_zip(F.col("l"), fired.alias("fired"))).alias("z"))
    walked = walked.select("z.l.x.row.*", F.col("z.fired").alias("rules"))
    return with_action(walked.unionByName(rejected))


def with_action(decided: DataFrame) -> DataFrame:
    """K3: approval, action and reason text from the fired rules."""
    ok, ch = F.size("rules") == 0, F.col("change_dollars")
    return decided.select("*", ok.alias("approved"),
                          F.when(~ok, "REJECT").when(ch > 0, "BUY").when(ch < 0, "SELL").otherwise("HOLD").alias("action"),
                          F.when(~ok, F.array_join("rules", "; ")).alias("reason"))


def gross_exposure_exceeded(targets: DataFrame, keys: list[str], limits: RiskLimits = RiskLimits()) -> DataFrame:
    """K4: whether a portfolio's combined exposure breaks the limit; no equity always does."""
    g = targets.groupBy(*keys).agg(F.sum(F.abs("target_dollars")).alias("gross_dollars"), F.max("equity").alias("equity"))
    return g.withColumn("exceeded", (F.col("equity") <= 0) | F.coalesce(safe_div("gross_dollars", "equity") > limits.max_gross_exposure, F.lit(False)))
